"""N-gram Jaccard join by parity sketches, as components of near-equal documents.

A document's set holds the distinct hashes of its word n-grams. Each hash flips one bit of a sketch, so two sketches
differ in no more bits than the sets differ in elements (an even number of flips cancels). For a similarity of t that
difference is at most (a + b) * (1 - t) / (1 + t) for sets of a and b elements. Sizes fall into bands; a document
enters its own band and the next where a partner of its size may lie there. The sketch of a band is cut into
`d + 1 + e + h` blocks, d being the most bits in which partners of that band differ: at least e + h + 1 blocks are equal in
both (pigeonhole). Blocks are kept as one 64-bit hash of the bits that are set, never as bit strings. Empty blocks say
little, so they are no keys as long as a document has at most e of them; documents that have more use them as well. Either
way partners share h + 1 keys, so each document may leave its h most frequent keys of a band aside: the least frequent
key that two partners share is not among them, for either. That keeps documents with a common passage out of large groups.

From keys to links, with no pair of a group as a row: equal sets are one class; each key links its
classes to the smallest and largest among them; these links are verified on the whole sets, for each class one at first
and then those that still lie between two components (all of them only if sizes and sketches leave them open). Under keys
that still have several components, classes are compared by sketches inside the tasks (a key with many classes in chunks,
each pair of chunks a task's work of bounded size), and each class gives the NEAREST other ones that its sketch leaves
open. Classes with more of them than that go through a second round, after what was given has been verified and joined,
and for those that still have more the last round brings the whole sets to the task and gives the verified links of a
spanning forest only. So rows grow with the classes under keys and not with their pairs. The hashes of whole texts never leave the tasks but for classes that have a partner under some key.

Defined results: texts that are null or without words have no set, no links, and are their own component; a row with a
null id is in the component of equal sets, links to no others and is the component of none; rows that repeat an id are joined by their texts alone,
and `one_of_each` keeps all rows that have the smallest id of their component; an empty table gives an empty
one; other columns are carried by `one_of_each` and not read. 64-bit hashes stand for n-grams and sets; two different
ones among k collide with probability k^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, sized, stored, table, unused
from .graph import components

WORDS, THRESHOLD = 5, (8, 10)
#: Fewest bits of the sketches that are compared pair by pair (large sets have 1.25 to 2.5 bits for each element), most classes
#: of a key in one chunk where sketches are compared, and where whole sets are, with the most elements of those.
SKETCH, CHUNK, SET_CHUNK, SET_ELEMENTS = 512, 4000, 500, 1 << 20
#: Open classes that a class gives under a key; rounds over sketches before the one over whole sets; classes of a key from
#: which its members may leave it aside.
NEAREST, ROUNDS, FREQUENT = 4, 2, 32
#: Most rows of 24 bytes that are broadcast to find the members of shared keys, and at once: more go part after part.
SHARED_ROWS, SHARED_AT_ONCE = 2_500_000, 1_000_000
#: Most bytes of sketches that are broadcast.
SKETCH_BYTES = 4 << 20
#: Pairs of one class that are verified together: its set is sent once for so many.
PARTNERS = 100
#: Band edges grow by a half.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 3 // 2))
_EDGES = np.array(EDGES)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; A-Z count as a-z, words end at ASCII white space."""
    split = [(t or "").encode().lower().split() for t in texts]
    flat = [w for ws in split for w in ws]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, _U)
    out, at = [], 0
    for ws in split:
        h, at = hashed[at : at + len(ws)], at + len(ws)
        if not len(ws):
            out.append(h)
            continue
        k = min(words, len(ws))
        acc = np.full(len(ws) - k + 1, k, _U)
        for i in range(k):
            acc = mix(acc + h[i : len(ws) - k + 1 + i])
        out.append(np.unique(acc))
    return out


def band_of(size: int) -> int:
    return int(np.searchsorted(_EDGES, size, "right")) - 1


def band_shape(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(most elements in which partners of the band differ, spare blocks for empty ones, spare blocks for frequent keys)."""
    d = 2 * (EDGES[band + 1] - 1) * (den - num) // (den + num)
    return d, 2 + d // 12, 1 + d // 24


#: The low bits of a key hold its band.
BAND_BITS = 7


def keys(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of one set, for all bands that it enters."""
    n, out = len(h), []
    for band in dict.fromkeys((band_of(n), band_of(n * den // num))) if n else ():
        d, spare, frequent = band_shape(band, num, den)
        if d == 0:  # partners are equal sets, which are one class
            continue
        blocks = d + 1 + spare + frequent
        block = ((h >> _U(32)) * _U(blocks)) >> _U(32)  # rises with h
        bit = mix((block << _U(20)) | (h & _U(0xFFFFF)))
        starts = np.flatnonzero(np.diff(block, prepend=_U(1 << 60)))
        value = np.bitwise_xor.reduceat(bit, starts)
        full = value != 0
        place, value = block[starts][full], value[full]
        if blocks - len(place) > spare:
            empty = np.setdiff1d(np.arange(blocks, dtype=_U), place)
            place, value = np.concatenate([place, empty]), np.concatenate([value, np.zeros(len(empty), _U)])
        out.append(mix(value ^ mix((_U(band) << _U(40)) + place + _U(1))) & ~_U((1 << BAND_BITS) - 1) | _U(band))
    return np.concatenate(out) if out else np.zeros(0, _U)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _node(h: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63 if len(h) else None


def profiles(docs: DataFrame, words: int, num: int, den: int, text: str, id_col: str) -> DataFrame:
    """doc_id, n_shingles, node (the class; null for empty sets), sketch, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                sets = shingles(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([_node(h) for h in sets], pa.int64()), pa.array([sketch(h) for h in sets]), _longs([keys(h, num, den) for h in sets])], names=["doc_id", "n_shingles", "node", "sketch", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary, keys array<long>"), "profiles")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int, text: str, id_col: str) -> DataFrame:
    """node, set of the classes in wanted (node, doc_id: a document of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                sets = shingles(part.column(0).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), _longs(sets)], names=["node", "set"])

    ids = sized(wanted.select(F.col("doc_id").alias("_id")).distinct(), 1_000_000)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("text")).join(ids, "_id", "left_semi").select("text")
    # a repeated id brings rows of other classes along, or of the same class once more
    sets = stored(rows.mapInArrow(run, "node long, set array<long>").join(sized(wanted.select("node")), "node", "left_semi"), "sets")
    n, distinct = sets.agg(F.count("*"), F.count_distinct("node")).first()
    return sets if n == distinct else stored(sets.dropDuplicates(["node"]), "sets")


def sketch(h: np.ndarray) -> bytes:
    """The parity of how many hashes fall on each of SKETCH bits, or of a power of two of bits, more than 5/4 of the hashes."""
    log2 = max((SKETCH - 1).bit_length(), (len(h) * 5 // 4).bit_length())
    return np.packbits((np.bincount((h >> _U(64 - log2)).astype(np.int64), minlength=1 << log2) & 1).astype(bool)).tobytes()


def same_size(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches folded to so many bytes, as rows of 64-bit words: two neighbouring bits become their parity."""
    out = np.empty((len(sketches), size), np.uint8)
    for i, x in enumerate(sketches):
        row = np.frombuffer(x, np.uint8)
        while len(row) > size:
            bits = np.unpackbits(row)
            row = np.packbits(bits[::2] ^ bits[1::2])
        out[i] = row
    return out.view(_U)


def _open(comp, size, bits, one, two, num: int, den: int):
    """For blocks of the rows of `one`: (their rows, those of `two` that sizes and sketches leave open and that are in another component, bits apart)."""
    step = max(1, (1 << 20) // max(1, len(two)))
    words, far = np.ascontiguousarray(bits[two].T), size[two]
    for lo in range(0, len(one), step):
        i = one[lo : lo + step]
        apart = np.zeros((len(i), len(two)), np.int32)
        for w, other in enumerate(words):
            apart += np.bitwise_count(bits[i, w][:, None] ^ other[None])
        r, c = np.nonzero(apart * (num + den) <= (size[i][:, None] + far[None]) * (den - num))
        x, y = i[r], two[c]
        a, b = size[x], size[y]
        near = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (comp[x] != comp[y])
        yield x[near], y[near], apart[r[near], c[near]]


def _nearest_open(comp, size, bits, one, two, num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a row that is open to it, whether there are more than those given) for the `most` nearest of each row; ties go to the smaller place."""
    x = y = d = np.zeros(0, np.int64)
    found = np.zeros(len(comp), np.int64)
    same = len(one) == len(two) and (one == two).all()
    for i, j, apart in _open(comp, size, bits, one, two, num, den):
        if not len(i):
            continue
        # within one chunk each pair comes from both of its ends
        new = ((i, j),) if same else ((i, j), (j, i))
        found += np.bincount(np.concatenate([p for p, _ in new]), minlength=len(comp))
        x, y, d = (np.concatenate(v) for v in zip((x, y, d), *((p, q, apart) for p, q in new), strict=True))
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        x, y, d = x[place < most], y[place < most], d[place < most]
    return x, y, found[x] > most


def _verified_forest(comp, size, bits, sets, one, two, num: int, den: int) -> tuple[list[int], list[int]]:
    """Pairs of rows whose whole sets are similar and that join two components, nearest of each block first."""
    name, number = np.unique(comp, return_inverse=True)
    parent = list(range(len(name)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for i, j, apart in _open(comp, size, bits, one, two, num, den):
        order = np.argsort(apart, kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = find(number[x]), find(number[y])
            if p == q:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both * den >= (len(sets[x]) + len(sets[y]) - both) * num:
                parent[p] = q
                a.append(x)
                b.append(y)
    return a, b


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, first, second), which lie together and are the first three columns."""
    held = []
    for batch in batches:
        key = np.stack([c.to_numpy() for c in batch.columns[:3]], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and (held[-1][0] != key[lo]).any():
                yield pa.Table.from_batches([x for _, x in held])
                held = []
            if hi > lo:
                held.append((key[lo], batch.slice(lo, hi - lo)))
    if held:
        yield pa.Table.from_batches([x for _, x in held])


def _dealt(rows: DataFrame, *carried: str) -> DataFrame:
    """rows (key, node, c, chunks), each class of a key in one chunk, for every pair of chunks that it is in: key, first, second, node, c, chunk, carried."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = rows.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    return dealt.select("key", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "node", "c", "chunk", *carried)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    chunk, first, second = group["chunk"].to_numpy(), group["first"][0].as_py(), group["second"][0].as_py()
    return np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)


def near_under_keys(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, other, more): the NEAREST classes that are open to a class, of other components under the key, and whether it has more of them. rows: key, node, c, size, sketch, chunks."""
    most = NEAREST

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            node, comp, size = (group[c].to_numpy() for c in ("node", "c", "size"))
            sketches = group["sketch"].to_pylist()
            x, y, more = _nearest_open(comp, size, same_size(sketches, min(map(len, sketches))), *_sides(group), num, den, most)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), group["key"][0].as_py())), pa.array(node[x]), pa.array(node[y]), pa.array(more)], names=["key", "node", "other", "more"])

    dealt = _dealt(rows, "size", "sketch")
    return stored(dealt.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second").mapInArrow(compare, "key long, node long, other long, more boolean"), "near")


def links_under_keys(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): verified links between components, for each key and pair of chunks those of a forest. rows: key, node, c, sketch, set, chunks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            node, comp, sketches = group["node"].to_numpy(), group["c"].to_numpy(), group["sketch"].to_pylist()
            sets = [np.array(x.values) for x in (group["set"][i] for i in range(group.num_rows))]
            size = np.array([len(x) for x in sets])
            x, y = _verified_forest(comp, size, same_size(sketches, min(map(len, sketches))), sets, *_sides(group), num, den)
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    dealt = _dealt(rows, "sketch", "set")
    return stored(dealt.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second").mapInArrow(compare, "a long, b long").distinct(), "links")


def open_by_sketch(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            a, b, x, y = (batch.column(c).to_numpy() for c in ("a", "b", "size_a", "size_b"))
            one, two = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
            length, apart = np.array([min(len(p), len(q)) for p, q in zip(one, two, strict=True)]), np.empty(len(a), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                apart[at] = np.bitwise_count(same_size([one[i] for i in at], n) ^ same_size([two[i] for i in at], n)).sum(1, dtype=np.int64)
            near = (apart * (num + den) <= (x + y) * (den - num)) & (np.minimum(x, y) * den >= np.maximum(x, y) * num)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    # sketches grow with their sets, so it is their bytes that decide about a broadcast
    few = (sketches.agg(F.sum(F.octet_length("sketch") + 32)).first()[0] or 0) <= SKETCH_BYTES
    one, two = (sketches.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in ("a", "b"))
    one, two = (F.broadcast(x) if few else x for x in (one, two))
    return stored(pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long"), "open")


def around_hubs(pairs: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """hub, chunk, other: each pair by its end with more pairs, whose others are dealt to chunks of about so many."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "ends")
    one, two = (ends.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
    both = pairs.join(sized(one), "a").join(sized(two), "b")
    first = F.col("n_a") >= F.col("n_b")
    both = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.ceil(F.greatest("n_a", "n_b") / partners).alias("chunks"))
    return both.select("hub", F.pmod(F.xxhash64("other"), F.col("chunks")).alias("chunk"), "other")


def with_sets(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, chunk, other, set: the hub's set once a chunk, with a null other, then those of the others; no class's set is sent once a pair."""
    own = dealt.select("hub", "chunk").distinct().join(sets, F.col("hub") == F.col("node")).select("hub", "chunk", F.lit(None).cast("long").alias("other"), "set")
    return own.unionByName(dealt.join(sets, F.col("other") == F.col("node")).select("hub", "chunk", "other", "set"))


def verified(pairs: DataFrame, samples: DataFrame, docs: DataFrame, words: int, num: int, den: int, text: str, id_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; samples: node, doc_id."""
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = whole_sets(docs, stored(samples.join(nodes, "node", "left_semi"), "wanted"), words, text, id_col)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            a, b = [], []
            for hub, other, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = x.values.to_numpy()
                if other is None:
                    own = x  # the rows of a chunk lie together, the hub's before the others
                    continue
                same = len(np.intersect1d(own, x, assume_unique=True))
                if same * den >= (len(own) + len(x) - same) * num:
                    a.append(min(hub, other))
                    b.append(max(hub, other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = with_sets(stored(around_hubs(pairs), "around-hubs"), sets)
    rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "other")
    return stored(rows.mapInArrow(compare, "a long, b long"), "links")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components."""
    if labels is None:
        return pairs
    of = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return rows.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _members(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, node, lo, hi) of keyed (key, node) for the keys in shared (key, lo, hi), each once."""
    n = shared.count()
    if n > SHARED_ROWS:
        return stored(keyed.join(shared, "key").distinct(), "members")
    parts = max(1, -(-n // SHARED_AT_ONCE))
    of = lambda rows, i: rows.where(F.pmod(F.shiftright("key", 20), F.lit(parts)) == i)
    found = [stored(of(keyed, i).join(F.broadcast(of(shared, i)), "key").distinct(), "members") for i in range(parts)]
    return reduce(DataFrame.unionAll, found)


def _infrequent(members: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node) of members (key, node, n), without the most frequent keys of each class and band, as many as are spare."""
    spare = F.array(*[F.lit(band_shape(band, num, den)[2]) for band in range(min(len(EDGES) - 1, 1 << BAND_BITS))])
    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    frequent = F.col("n") >= FREQUENT
    w = Window.partitionBy("node", band).orderBy(F.desc("n"), "key")
    ranked = members.where(frequent).withColumn("rank", F.row_number().over(w)).where(F.col("rank") > F.element_at(spare, band + 1))
    return members.where(~frequent).select("key", "node").unionAll(ranked.select("key", "node"))


def near_components(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node (class of equal sets), component_id (the smallest id that links lead to)."""
    num, den = threshold
    rows = profiles(docs, words, num, den, text, id_col)
    keyed = rows.where("node is not null and doc_id is not null").select("node", F.explode("keys").alias("key"))
    # keys under which there is more than one class; copies of one class are summed up before the shuffle
    shared = stored(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "shared-keys")
    members = _members(keyed, shared)
    whole, rows = rows, stored(rows.drop("keys"), "classes-of-rows")
    discard(whole)  # the keys have done their work
    near = members.select(F.explode(F.array(F.struct(F.least("node", "lo").alias("a"), F.greatest("node", "lo").alias("b")), F.struct(F.least("node", "hi").alias("a"), F.greatest("node", "hi").alias("b")))).alias("p")).select("p.*").where("a < b")
    nodes = sized(stored(members.select("node").distinct(), "nodes"))
    samples = rows.where("node is not null and doc_id is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"))
    samples = stored(samples.select("node", "x.doc_id", F.col("x.n_shingles").alias("size"), "x.sketch"), "class-samples")
    near = open_by_sketch(near.distinct(), samples, num, den)

    def check(pairs: DataFrame) -> DataFrame:
        return verified(stored(pairs, "pairs"), samples, docs, words, num, den, text, id_col)

    # one link for each class, then the others that could still join two components, then pairs under a key
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = check(first)
    links = links.unionAll(check(_apart(near.join(first, ["a", "b"], "left_anti"), components(links))))
    labels = components(links)
    # of up to three classes under a key, every pair has the smallest or the largest in it and is among the links above
    left = stored(_infrequent(members.join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 3"), "key"), num, den), "left")
    for turn in range(ROUNDS + 1):
        named = left.join(labels.select("node", F.col("component").alias("c")), "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
        named = stored(named.join(samples.select("node", "size"), "node"), "named")
        mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.sum("size").alias("elements")).where("c0 < c1")
        chunks = F.ceil(F.col("n") / CHUNK) if turn < ROUNDS else F.greatest(F.ceil(F.col("n") / SET_CHUNK), F.ceil(F.col("elements") / SET_ELEMENTS))
        mixed = stored(mixed.select("key", chunks.alias("chunks")), "mixed-keys")
        if mixed.isEmpty():
            break
        named = named.join(sized(mixed, 1_000_000), "key").join(samples.select("node", "sketch"), "node")
        if turn < ROUNDS:
            near = near_under_keys(named, num, den)
            links = links.unionAll(check(near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()))
            # a pair that hasn't been verified has two ends that gave only part of what there was
            left = near.where("more").select("key", "node").distinct()
        else:
            wanted = stored(samples.join(named.select("node").distinct(), "node", "left_semi"), "wanted")
            links = links.unionAll(links_under_keys(named.join(whole_sets(docs, wanted, words, text, id_col), "node"), num, den))
        labels = components(links)

    # the smallest id of each class, then of each component
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    classes = classes.join(labels, "node", "left").select("node", "first_id", "n", F.coalesce("component", "node").alias("component"))
    classes = stored(classes, "classes")
    small = classes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("of"))
    alone = stored(classes.join(small, "component").where("of > 1").select("node", "component_id"), "component-ids")
    out = rows.select("doc_id", "n_shingles", "node").join(sized(alone), "node", "left")
    return out.select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with the smallest id of their component, with all their columns; rows without an id or a set stay."""
    found = near_components(docs, words, threshold, text, id_col)
    name = unused(docs, "_gone")
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(sized(gone, 1_000_000), F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), 3, (9, 10)).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
s AS (SELECT DISTINCT doc_id, hash(sh) AS sh FROM u), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM r JOIN both_ways ON a = node WHERE root < b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = d.doc_id
"""
