"""Token files: a brute-force version, the round trip, and what metadata leaves out."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from tilewise.llm import token_files
from tilewise.llm.common import new_path
from tilewise.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# names that the operator uses itself
DOCS = "doc_id long, text string, pid int, before long, n_tokens int, ids string, hash long, place long, start long, _start long"


def expected(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text), in their order, each text encoded whole."""
    tokenizer, at, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_whole_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(sorted(map(tuple, rows)))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioustrñéΣ̈0123'-") for _ in range(rng.randrange(1, 9)))
    texts = [None, "", " ", "\n\n", "a  b\t\x0bc\x1cd e　f\x85g", "don't  STOP it's 2024", "<|endoftext|> <|startoftext|>x", "é é Å ΑΣ Σ", "x" * 5000, " ".join(word() for _ in range(60_000)), "\U0001f600 \x00 y"]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id"), (None, None), (7, "another text"), (3, "\n\n"), (3, "\n\n")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, 5, 6, 7) for i, t in rows], DOCS)


def test_odd_texts_repeats_and_nulls(spark, odd, monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 500)  # the table of pieces is emptied many times
    rows, docs = odd
    path = new_path(spark, "odd")
    index = token_files.write(docs, path, VOCABULARY, partitions=5).collect()
    got = sorted(token_files.digests(token_files.read(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in got] == [True] * 2 + [False] * (len(rows) - 2)
    ids = [r["doc_id"] for r in got[2:]]
    assert ids == sorted(ids) and len(got) == len(rows)
    # rows of one id may come in any defined order, so contents are compared by id and places by the sums of lengths
    want = expected(rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), n, c) for i, _, n, c in want)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    assert sum(r["documents"] for r in index) == len(rows) and sum(r["tokens"] for r in index) == sum(w[2] for w in want)
    again = new_path(spark, "odd")
    token_files.write(docs.repartition(3), again, VOCABULARY, partitions=2)
    assert sorted(map(str, token_files.digests(token_files.read(spark, again)).collect())) == sorted(map(str, got))


def test_chunks_that_are_held_are_not_cut_again(monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 40)
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"W{i}'s, the" for i in range(k, k + 30)) + "\t\nİ é ß  日本 x" * (k % 2) for k in range(0, 300, 15)] + ["", None, " \n", "a" * 100 + "'S", "so, it.s a..b ,c d,.e f_.g, h.,", "no,runs.here, 's. 1,2.3 ²,½."]
    want = [encoder._whole([t or ""])[0] + encoder.end for t in texts]
    assert [x for t in texts for x in encoder.batch([t])] == want == encoder.batch(texts)
    held = []
    find, encoder.find = encoder.find, lambda t: held.append(t) or find(t)
    assert encoder.batch([texts[0]] * 3) == want[:1] * 3
    held.clear()
    assert encoder.batch([texts[0]] * 3) == want[:1] * 3 and not held


def test_one_id_is_dealt_to_several_files(spark):
    docs = spark.range(400).selectExpr("cast(5 as long) as doc_id", "concat('text ', id) as text")
    index = token_files.write(docs, new_path(spark, "one"), VOCABULARY, partitions=4).collect()
    assert len(index) == 4 and max(r["documents"] for r in index) < 200


def test_empty_table(spark):
    path = new_path(spark, "none")
    token_files.write(spark.createDataFrame([], DOCS), path, VOCABULARY)
    assert token_files.read(spark, path).count() == token_files.digests(token_files.read(spark, path)).count() == 0


def rows_read(df) -> int:
    """Rows that come out of the scan of the files, after the reader has pruned."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan orc"):
            rows += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_stripes_row_groups_and_bloom_filters(spark):
    n = 60_000
    docs = spark.range(n).selectExpr("id * 10 as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> substring(md5(concat(id, i)), 1, 5))) as text")
    path = new_path(spark, "pruned")
    token_files.write(docs, path, VOCABULARY, partitions=1, stripe_bytes=1 << 20)
    file = next(Path(path.removeprefix("file:"), "ids").glob("*.orc"))
    stripes = orc.ORCFile(str(file)).nstripes
    assert stripes > 3
    ids = spark.read.schema(token_files.ENCODED).orc(f"{path}/ids").select("doc_id", "ids")
    assert rows_read(ids) == n
    one = ids.where("doc_id = 300000")
    assert one.count() == 1 and rows_read(one) <= 2 * token_files.INDEX_ROWS  # a row group
    between = ids.where("doc_id = 300005")  # inside the statistics of a row group; its Bloom filter knows better
    assert between.count() == 0 and rows_read(between) == 0
    assert rows_read(ids.where("doc_id between 100 and 50000")) < n / 3
