from collections import Counter

import corpus_pipeline
from tests.llm.test_parity_join import sets_of
from tilewise.llm.common import stored
from tilewise.llm.mixing import with_copies


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, sf_dir), f"test-{i}")
        rows = out.collect()
        if i < 4:
            assert out.columns == columns
            assert not Counter(map(tuple, rows)) - Counter(tuple(r) for r in before for _ in range(2 if i == 3 else 1)), name
        if i == 0:
            assert all(any(map(str.isalpha, r["text"])) for r in rows)
            clean = [r for r in before if sum(map(str.isalpha, r["text"] or "")) > 0.6 * len(r["text"] or "")]
            assert {r["doc_id"] for r in clean} <= {r["doc_id"] for r in rows}
        if i == 1:
            want: dict = {}
            for r in before:
                want[r["text"]] = max(want.get(r["text"], r["doc_id"]), r["doc_id"])
            assert {(r["text"], r["doc_id"]) for r in rows} == set(want.items())
        if i == 2:
            sets, ids = sets_of([r["text"] for r in before], 5), [r["doc_id"] for r in before]
            low = list(range(len(ids)))

            def find(x, low=low):
                while low[x] != x:
                    x = low[x]
                return x

            for a in range(len(ids)):
                for b in range(a):
                    if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                        low[find(a)] = find(b)
            first: dict = {}
            for a, doc_id in enumerate(ids):
                first[find(a)] = min(first.get(find(a), doc_id), doc_id)
            assert {r["doc_id"] for r in rows} == set(first.values())
        if i == 3:
            copies = {r["doc_id"]: r["copies"] for r in with_copies(docs).select("_row.doc_id", "copies").collect()}
            assert Counter(r["doc_id"] for r in rows) == Counter({k: v for k, v in copies.items() if v})
        if i == 4:
            assert sum(r["length"] for r in rows if r["start"] == 0) > 0
            tokens = Counter()
            for r in rows:
                tokens[r["doc_id"]] += r["length"]
            size = {r["doc_id"]: r["doc_tokens"] for r in rows}
            assert tokens == Counter({k: n * size[k] for k, n in Counter(r["doc_id"] for r in before).items()})
            ends = Counter()
            for r in rows:
                ends[r["sequence_id"]] += r["length"]
            assert all(n == 2048 or n & (n - 1) == 0 for n in ends.values())
        docs, before = out, rows


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, node long, component_id long, copies int, text_key long"


def test_run_on_empty_null_and_clashing_tables(spark, tmp_path):
    words = "the river runs over stones and under the old bridge to the quiet sea".split()
    text = lambda i: " ".join(words[(i * 7 + j * (i + 3)) % len(words)] + "abcdefgh"[(i + j) % 8] for j in range(40))
    some = [(i, text(i), "en", f"s{i % 3}", 1, "r", 2, 3, 4, 5) for i in range(12)]
    some += [(100, None, None, None, None, None, None, None, None, None), (None, None, None, "s0", None, None, None, None, None, None), (101, "", "en", "s1", 0, "", 0, 0, 0, 0), (102, text(1), "en", None, 1, "r", 2, 3, 4, 5), (103, text(1), "en", None, 1, "r", 2, 3, 4, 5)]
    for name, rows in (("empty", []), ("null", some[12:14]), ("clash", some)):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if name != "clash":
            assert got == []
        else:  # copies of one text are one document; what has no letters goes
            assert {r["doc_id"] for r in got} <= {*range(12), 103} - {1} and {r["doc_id"] for r in got} & set(range(12))
