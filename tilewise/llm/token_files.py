"""Token ids as ORC files in ascending order of document, with row indexes and Bloom filters on the document id.

A row of a file is a document: its ids are a list of integers, which ORC run-length encodes (direct, delta and patched
runs) stripe by stripe; a stripe has statistics of its document ids, and each row group of INDEX_ROWS rows of it has its
own statistics and a Bloom filter. Readers split files at stripes, so all tasks read; a filter on doc_id reaches the files
as a search argument and leaves out stripes and row groups by their metadata, before any id is decoded.

Jobs: (1) documents are dealt to ranges of (id, hash of the text, place in the input), sorted, encoded and written, all in
the tasks of one shuffle; ranges end anywhere, also among rows of one id, so no id is one task's; (2) the index, one row a
file with its first and last id, documents, tokens and the tokens of all files before it, comes from the narrow columns
of those files. A document's place among all tokens is its place in its file plus the file's place.

Encoding is the library's own steps, taken apart: texts are cut at white space, over which no piece of the pattern goes, and
each distinct chunk is encoded once while a worker holds it, many at a time: the pattern in the tokenizer's file cuts it into
pieces, which the model of that file encodes. What has characters on which the pattern engines might differ (anything beyond Latin letters) goes through the whole tokenizer, and so does all text where
the file asks for other steps. A share of the texts drawn by a hash is also encoded whole, and a difference is an error.

Defined results: a null or empty text is the end id alone; null ids come first, and rows of one id in the order of a hash
of their texts; repeated rows are written as often as they occur; an empty table gives an empty one (with files that have
no rows); very long texts are one row like others, and batches are bounded by bytes; columns other than id and text are
not read, so their names don't matter.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, sized, table

END_ID = 1
#: Rows a row group, bytes a stripe, and the share of ids that a Bloom filter lets through by mistake.
INDEX_ROWS, STRIPE_BYTES, FALSE_SHARE = 1000, 16 << 20, 0.01
#: Chunks a worker holds, the longest of them, and bytes of text encoded at a time.
PIECES, PIECE_CHARS, SLICE_BYTES = 500_000, 64, 4 << 20
#: One text in so many is encoded whole as well.
CHECK_EVERY = 500
ENCODED = "doc_id long, pid int, before long, n_tokens int, ids array<int>"


#: White space between chunks that are taken by themselves, and characters that the whole tokenizer should see.
BREAK, ODD = re.compile(r"[ \t\n\r\f\v]+"), re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u0130\u0250-\U0010ffff]")
#: How byte-level vocabularies write each byte.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library."""

    held: dict = {}

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        """The worker's own, which outlives a task."""
        if (path, end_id) not in cls.held:
            cls.held[path, end_id] = cls(path, end_id)
        return cls.held[path, end_id]

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.older, self.end = Tokenizer.from_file(path), {}, {}, np.array([end_id], "<i4").tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        cut = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["use_regex"] and not cut[1]["add_prefix_space"]
        if self.plain:
            self.find = regex.compile(cut[0]["pattern"]["Regex"]).findall
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of plain text; their pieces are words of one text, so that the library goes through them at once."""
        cut = []
        for c in chunks:
            word = c.rstrip(".,!?;:")
            # letters alone are one piece, and so are marks alone
            cut.append([c] if c.isalpha() else [word, c[len(word) :]] if word.isalpha() else self.find(c))
        get, older, ids, new = self.known.get, self.older.get, {}, []
        for p in {p for ps in cut for p in ps}:
            if (x := get(p) or older(p)) is None:
                new.append(p)
            else:
                ids[p] = x
        shown = [p.encode().decode("latin-1").translate(BYTES) for p in new]
        out = self.pieces.encode(" ".join(shown), add_special_tokens=False)
        flat, ends = np.array(out.ids, "<i4").tobytes(), np.searchsorted(np.array(out.word_ids, np.int64), np.arange(len(new)), "right").tolist()
        ids |= zip(new, (flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)), strict=True)
        return [ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps)) for ps in cut]

    def _cut(self, text: str) -> list[str]:
        """The chunks of a text; one that begins with a space is for the whole tokenizer."""
        if not ODD.search(text):
            return text.lower().split()
        return [" " + c if ODD.search(c) else c.lower() for c in BREAK.split(text) if c]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't held, which are held from now on unless they are long."""
        if len(self.known) > PIECES:
            self.older, self.known = self.known, {}  # what goes on occurring is taken up again
        got = {c: self.older[c] for c in chunks & self.older.keys()}
        odd, usual = [c for c in chunks if c[0] == " " and c not in got], [c for c in chunks if c[0] != " " and c not in got]
        got |= zip(odd, self._whole([c[1:] for c in odd]), strict=True)
        got |= zip(usual, self._encoded(usual), strict=True)
        self.known |= {c: x for c, x in got.items() if len(c) <= PIECE_CHARS}
        return got

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and each collection would go through all lists of chunks
        try:
            return self._batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        plain = [self.plain and not any(s in t for s in self.special) for t in (t or "" for t in texts)]
        cut = [self._cut(t or "") if p else [] for t, p in zip(texts, plain, strict=True)]
        found = [list(map(self.known.get, chunks)) for chunks in cut]
        short = [i for i, ids in enumerate(found) if None in ids]
        new = {c for i in short for c, x in zip(cut[i], found[i], strict=True) if x is None}
        if new:
            got = self._learn(new)
            for i in short:
                found[i] = [got[c] if x is None else x for c, x in zip(cut[i], found[i], strict=True)]
        out = [b"".join(ids) if p else self._whole([t or ""])[0] for t, p, ids in zip(texts, plain, found, strict=True)]
        for t, x in zip(texts, out, strict=True):
            if t and zlib.crc32(t.encode()) % CHECK_EVERY == 0 and self._whole([t])[0] != x:
                raise ValueError("the pieces of a text have other ids than the text")
        return [x + self.end for x in out]


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts have about so many bytes; a longer text is a part of its own."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(n) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID, partitions: int | None = None, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> DataFrame:
    """Writes path/ids and path/index, and returns the index."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, pid, done = Encoder.of(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder.batch(part.column(1).to_pylist())
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = done + np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), pid), pa.int32()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int32()), lists], names=["doc_id", "pid", "before", "n_tokens", "ids"])
                done = int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("hash"), F.col("place")]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_SHARE, "orc.row.index.stride": index_rows, "orc.stripe.size": stripe_bytes, "compression": "zstd"}
    ranged.select("doc_id", "text").mapInArrow(encode, ENCODED).write.options(**options).orc(f"{path}/ids")
    files = docs.sparkSession.read.schema(ENCODED).orc(f"{path}/ids").groupBy("pid").agg(F.first("_metadata.file_name").alias("file"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.orc(f"{path}/index")
    return index(docs.sparkSession, path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pid int, file string, first_id long, last_id long, documents long, tokens long, start long").orc(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; a filter on doc_id prunes files' stripes and row groups by their metadata."""
    starts = sized(index(spark, path).select("pid", F.col("start").alias("_start")))
    rows = spark.read.schema(ENCODED).orc(f"{path}/ids").join(starts, "pid")
    return rows.select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() gives; both come from the lists of ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digests(read(spark, path))
