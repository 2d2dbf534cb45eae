"""Mixture-controlled packing of tokenised documents into sequences of at most 2048 tokens.

Deficit round robin over one queue per source: while tokens are put out, every queue earns its share of each, and what it
has earned and not yet been served is its deficit, which goes on from window to window. The next token is that of the
queue that was first owed half of it, so no deficit grows, and no queue is served ahead of the others. What the queues
have had after T tokens of output is therefore known without going through them: all tokens that are due by then, and at
most one a queue more or less. So any partition can work out the deficits it starts with: they are carried across
partitions without a pass from window to window. When a queue runs dry, the others share its place by weight.

Jobs: (1) tokenise, one pass over the texts, written once to the shared folder as 16-bit ids with each document's place
in its partition's queue; (2) sum tokens per (partition, source) and run those sums over the partitions; (3) cut each
document at the window ends of its queue. Token ids never cross a shuffle where the sums of (2) are small enough to be
broadcast; else they are joined by (partition, source), of which none is larger than an input split.

Windows are cut freely, so all but the last are full; what is left after the last whole window goes to sequences whose
lengths are powers of two. No token is padding.

Defined results: a null or empty text is a document of one token (the end id); the null source is a queue of its own;
null ids are carried; sources without a weight come last; rows that repeat are packed as often as they occur; an empty table gives an empty one; very long
texts are cut like others; columns other than id, text and source are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LENGTH, END_ID = 2048, 1
#: Entries of a worker's table of chunks that have been tokenised.
CHUNKS = 300_000
#: Windows whose counts a worker remembers.
WINDOWS = 50_000
TOKENS = "doc_id long, source string, pid int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"

#: White space other than the space and the line feed; texts that hold any are encoded whole.
OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Encoder:
    """Ids of whole texts by a byte-level BPE in tokenizers' JSON format.

    The merges are done by tiktoken over the vocabulary of that file, which gives the same ids in a third of the time;
    the first texts of each worker are encoded with tokenizers as well, and a difference is an error. A text with single
    spaces falls apart before each of them (no piece of the pattern goes on over one), and its parts are looked up.
    """

    held: dict = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own, which outlives a task with all the parts that it knows."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str, end_id: int = END_ID):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.end, self.checks = Tokenizer.from_file(path), {}, np.array([end_id], "<u2").tobytes(), 20
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids need more than 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level vocabularies write each byte as one printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        ranks = {bytes(byte[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, t: str) -> list[str] | None:
        if "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " " or any(c in t for c in OTHER_SPACE):
            return None
        return t.replace(" ", "\0 ").split("\0") if "\0" not in t else None

    def batch(self, texts: list[str | None]) -> list[bytes]:
        known, merge, out = self.known, self.merge, []
        for t in texts:
            t = t or ""
            if any(s in t for s in self.special):
                ids = np.array(self.whole(t), "<u2").tobytes()
            elif parts := self._parts(t):
                found = list(map(known.get, parts))
                try:
                    ids = b"".join(found)
                except TypeError:  # None: parts that are new
                    for i, x in enumerate(found):
                        if x is None:
                            found[i] = x = array("H", merge(parts[i])).tobytes()
                            if len(known) < CHUNKS and len(parts[i]) < 40:
                                known[parts[i]] = x
                    ids = b"".join(found)
            else:
                ids = array("H", merge(t)).tobytes()
            if self.checks and len(t) < 20_000:
                self.checks -= 1
                if np.frombuffer(ids, np.uint16).tolist() != self.whole(t):
                    raise ValueError("the pattern of this tokenizer is another than public_tokenizers.PATTERN")
            out.append(ids + self.end)
        return out


def tokenised(docs: DataFrame, tokenizer: str, text: str, source: str, id_col: str) -> DataFrame:
    """TOKENS: pid is the partition, before the tokens of the same source that lie before the row in it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, pid, done = Encoder.of(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids, texts, sources = (c.to_pylist() for c in batch.slice(lo, 500).columns)
                got, before = encoder.batch(texts), []
                for s, x in zip(sources, got, strict=True):
                    before.append(done.get(s, 0))
                    done[s] = before[-1] + len(x) // 2
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array([pid] * n, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in got], pa.int64()), pa.array(got, pa.binary())], names=[f.split()[0] for f in TOKENS.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    return stored(rows.mapInArrow(encode, TOKENS), "tokens")


class Schedule:
    """When each queue is served: sizes and weights by queue, in their order in a window.

    Between two moments at which a queue runs dry the proportions stand still. Token m of a queue is due when the queue has
    earned m + 1/2 tokens; tokens are put out in the order of those times, on a tie by queue.
    """

    def __init__(self, sizes: list[int], weights: list[float] | None):
        w = [Fraction(x) for x in (weights or sizes)]
        self.total, self.sizes = sum(sizes), sizes
        had, at = [Fraction(0)] * len(sizes), Fraction(0)
        later = [i for i, s in enumerate(sizes) if s and w[i] <= 0]
        live = [i for i, s in enumerate(sizes) if s and w[i] > 0]
        for i in later:
            w[i] = Fraction(sizes[i])
        phases = []
        while live or later:
            live, later = (live, later) if live else (later, [])
            whole = sum(w[i] for i in live)
            share = [Fraction(0)] * len(sizes)
            for i in live:
                share[i] = w[i] / whole
            until = min((sizes[i] - had[i]) / share[i] for i in live)
            phases.append((at, had, share))
            had, at = [h + s * until for h, s in zip(had, share, strict=True)], at + until
            live = [i for i in live if had[i] < sizes[i]]
        self.phases = len(phases)
        self.start = np.array([float(p[0]) for p in phases])
        self.had, self.share = (np.array([[float(x) for x in p[k]] for p in phases]).reshape(-1, len(sizes)) for k in (1, 2))
        self.upto = np.concatenate([self.had[1:], np.array([sizes], float)]) if phases else np.zeros((0, len(sizes)))
        self.size, self.known = np.array(sizes, np.int64), {}

    def _due(self, m: np.ndarray) -> np.ndarray:
        """When token m[i] of each queue i is due, after so many tokens of output; it goes up with m."""
        x, queue = m + 0.5, np.arange(len(m))
        phase = np.minimum((self.upto < x).sum(0), self.phases - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # what is due at the same time goes by queue, whatever the last bits of the division
            return np.round(self.start[phase] + (x - self.had[phase, queue]) / self.share[phase, queue], 6)

    def counts(self, t: int) -> tuple[list[int], list[int]]:
        """How many of the first t tokens each queue has had, and the queues before each."""
        if (found := self.known.get(t)) is None:
            phase = max(0, int(np.searchsorted(self.start, t, "right")) - 1)
            earned = self.had[phase] + self.share[phase] * (t - self.start[phase])
            n = np.clip(np.floor(earned + 0.5).astype(np.int64), 0, self.size)
            after = lambda: np.where(n < self.size, self._due(n), np.inf)
            before = lambda: np.where(n > 0, self._due(n - 1), -np.inf)
            queue = np.arange(len(n))
            while (short := t - int(n.sum())) > 0:
                due = after()
                n[np.lexsort((queue, due))[: min(short, int(np.isfinite(due).sum()))]] += 1
            while (over := int(n.sum()) - t) > 0:
                due = before()
                n[np.lexsort((queue, due))[::-1][: min(over, int(np.isfinite(due).sum()))]] -= 1
            # the t that are due first: none that is in is due after one that isn't
            while True:
                a, b = after(), before()
                i, j = int(np.lexsort((queue, a))[0]), int(np.lexsort((queue, b))[-1])
                if (a[i], i) >= (b[j], j):
                    break
                n[i] += 1
                n[j] -= 1
            if len(self.known) > WINDOWS:
                self.known = {}
            found = self.known[t] = (n.tolist(), (np.cumsum(n) - n).tolist())
        return found

    def served(self, queue: int, t: int) -> tuple[int, int]:
        """(tokens of the queues before this one, tokens of this one) among the first t that are put out; both go up with t."""
        had, below = self.counts(t)
        return below[queue], had[queue]

    def window_of(self, queue: int, token: int, length: int) -> int:
        """The window in which this token of the queue is put out."""
        lo, hi = 0, -(-self.total // length) - 1
        guess = int(token * self.total / max(1, self.sizes[queue]) / length) if self.phases == 1 else (lo + hi) // 2
        a, b = max(lo, guess - 2), min(hi, guess + 2)
        if a > lo and self.served(queue, a * length)[1] > token or self.served(queue, min(self.total, (b + 1) * length))[1] <= token:
            a, b = lo, hi
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if self.served(queue, min(self.total, (mid + 1) * length))[1] > token else (mid + 1, b)
        return a


def last_cuts(rest: int) -> list[int]:
    """rest as powers of two, the largest first: where each begins, and the end."""
    cuts = [0]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


def cut(batch: dict, plan: Schedule, length: int) -> dict:
    """The pieces of the documents in batch (columns: doc_id, source, queue, first, n, ids)."""
    out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
    full, rest = divmod(plan.total, length)
    cuts = last_cuts(rest)
    for doc_id, source, q, first, n, ids in zip(*(batch[k] for k in ("doc_id", "source", "queue", "first", "n", "ids")), strict=True):
        wide, at = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
        k = plan.window_of(q, first, length)
        below, had = plan.served(q, k * length)
        while at < n:
            t = min(plan.total, (k + 1) * length)
            below_then, had_then = plan.served(q, t)
            take = min(n - at, had_then - (first + at))
            if take > 0:
                # in the window the queues before this one come first
                offset = (below_then - below) + (first + at - had)
                while take:
                    seq, off, size = k, offset, take
                    if k == full:
                        j = next(j for j in range(len(cuts) - 1) if offset < cuts[j + 1])
                        seq, off, size = full + j, offset - cuts[j], min(take, cuts[j + 1] - offset)
                    for name, v in zip(out, (doc_id, at, size, zlib.crc32(wide[4 * at : 4 * (at + size)]), n, seq, off, source), strict=True):
                        out[name].append(v)
                    at, offset, take = at + size, offset + size, take - size
            k, below, had = k + 1, below_then, had_then
    return out


def pack(docs: DataFrame, tokenizer: str, weights: dict | None = None, length: int = LENGTH, text: str = "text", source: str = "source", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """PIECES of all documents (with_ids: and each piece's ids as 16-bit binary).

    weights: the target proportion of each source; sources that they don't name, or with none above 0, come when the others
    have run dry, in proportion to their tokens; without weights the proportions are those of the sources' tokens, so that
    all queues end together and every window has the mixture of the whole.
    """
    rows = tokenised(docs, tokenizer, text, source, id_col)
    sums = rows.groupBy("pid", "source").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))), "queue-sums")
    # one row per source: the queues of the schedule
    queues = sorted(((r["source"], int(r["n"])) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    order = {s: i for i, (s, _) in enumerate(queues)}
    sizes = [n for _, n in queues]
    given = [float(weights.get(s, 0)) for s, _ in queues] if weights else None
    schema = PIECES + ", ids binary" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(sizes, given)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = {k: v for k, v in batch.slice(lo, 1000).to_pydict().items()}
                b["queue"] = [order[s] for s in b["source"]]
                got = cut(b, plan, length)
                if with_ids:
                    flat = iter(zip(got["doc_id"], got["start"], got["length"], strict=True))
                    got["ids"] = [ids[2 * s : 2 * (s + size)] for ids, n in zip(b["ids"], b["n"], strict=True) for s, size in _until(flat, n)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "source" else pa.binary() if k == "ids" else pa.int64()) for k, v in got.items()], names=list(got))

    base = sums.select(F.col("pid").alias("_pid"), F.col("source").alias("_source"), "base")
    base = F.broadcast(base) if base.count() <= 400_000 else base
    joined = rows.join(base, (F.col("pid") == F.col("_pid")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "source", (F.col("base") + F.col("before")).alias("first"), "n", "ids").mapInArrow(pieces, schema)


def _until(flat: Iterator[tuple], n: int) -> Iterator[tuple[int, int]]:
    """The next pieces of flat, up to a document's n tokens."""
    done = 0
    while done < n:
        _, start, size = next(flat)
        done += size
        yield start, size


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
