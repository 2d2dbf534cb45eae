"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.llm import exact_dedup, html_text, language_id, mixing, packing, recurrent_lm, vp_search, warc

# names that the operators use themselves
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, _len int, node long, id long, copies int, _source string, text_key long, map map<string,int>"
PACK = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    en = lambda n: " ".join(rng.choice("the of and quick brown house river stone water light with".split()) for _ in range(n))
    es = lambda n: " ".join(rng.choice("el la de que ñandú corazón niño agua piedra señora según".split()) for _ in range(n))
    rows = [(i, en(rng.randrange(1, 60)) if i % 3 else es(rng.randrange(1, 60)), "en" if i % 3 else "es", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, "12 345 !!", None, "s1"), (103, en(40_000), "en", "s1"), (None, "of the river", "en", None), (None, None, None, None)]
    rows += [(200 + i, "copy of one text", "en", "s0") for i in range(30)] + [(300, "twice", "en", "s2")] * 2 + [(301, "a  b\n c\t<|endoftext|> ", "en", "s2"), (302, "é x\U0001f600 \x00y", "es", "s2")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "r", "t", 1, 2, 3, 4, "z", 5, {"a": 1}) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    rows = docs.collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    got = exact_dedup.exact_dedup(docs).collect()
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r["doc_id"], top[r["text"] or ""], len(groups[r["text"] or ""]), r["doc_id"] == top[r["text"] or ""], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows)
    assert Counter(map(tuple, got)) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((top[t], t) for t in groups)
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_exact_dedup_prefix_and_length_collisions(spark):
    texts = ["a" * 200 + "b", "a" * 200 + "c", "a" * 200 + "b", "zz", "yy", "é", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {0: 2, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}


def water_level(sizes, weights, budget, cap):
    """Targets by sharing again and again what is over the caps."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), budget * sum(sizes.values())
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] > cap * sizes[s]}
        if not over:
            target |= {s: share * weights[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(docs, empty):
    got = mixing.with_copies(docs).select(F.col("_row.doc_id").alias("d"), F.col("_row.source").alias("s"), F.col("_row.text").alias("t"), "size", "source_size", "target", "copies").collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["t"] or ""))
        sizes[r["s"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    assert all(r["source_size"] == sizes[r["s"]] and math.isclose(r["target"], target[r["s"]], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    rate = {s: target[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    assert all(math.floor(rate[r["s"]] + 1e-12) <= r["copies"] <= math.ceil(rate[r["s"]] - 1e-12) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_mixing_comes_near_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(1, 30), f"s{int(rng.random() ** 3 * 7)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_copies(df, seed=seed).groupBy("_row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("size")).alias("ss")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 4 * math.sqrt(r["ss"]) / 2 for r in got)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(PACK)
    tok, rows = Tokenizer.from_file(path), docs.collect()
    for weights in (None, {"s0": 3.0, "s1": 1.0, "s2": 1.0, None: 0.5}):
        got = packing.pack(docs, path, weights, with_ids=True).collect()
        want = Counter((r["doc_id"], np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u2").tobytes()) for r in rows)
        pieces: dict = {}
        for r in got:
            assert r["length"] * 2 == len(r["ids"]) and zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"]
            pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        total = Counter()
        for (d, _), parts in pieces.items():
            same = [i for (x, i), n in want.items() for _ in range(n) if x == d]
            whole = sum(len(i) for _, i in parts)
            total[d] += whole
            for start, ids in parts:
                assert any(x[2 * start : 2 * start + len(ids)] == ids for x in same)
        assert total == Counter({d: sum(len(i) * n for (x, i), n in want.items() if x == d) for d in total})
        seqs: dict = {}
        for r in got:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["source"]))
        for v in seqs.values():
            at = 0
            for off, n, _ in sorted(v, key=lambda x: x[:2]):
                assert off == at
                at += n
            assert at == 2048 or at & (at - 1) == 0
        if weights is None:  # each full window has the mixture of the whole
            share = Counter()
            for r in got:
                share[r["source"]] += r["length"]
            for v in seqs.values():
                if sum(n for _, n, _ in v) == 2048:
                    here = Counter()
                    for _, n, s in v:
                        here[s] += n
                    assert all(abs(here[s] - 2048 * share[s] / sum(share.values())) < 2 for s in share)
    assert packing.pack(empty, path).count() == 0


def test_packing_sources_without_a_weight_come_last():
    plan = packing.Schedule([300, 200, 0, 500], [3.0, 0.0, 1.0, 0.0])
    assert [plan.served(q, 300)[1] for q in range(4)] == [300, 0, 0, 0]
    assert [plan.served(q, 1000)[1] for q in range(4)] == [300, 200, 0, 500]
    half = [plan.served(q, 650)[1] for q in range(4)]
    assert half[0] == 300 and abs(half[1] - 100) <= 1 and abs(half[3] - 250) <= 1 and sum(half) == 650


def test_language_id(docs, empty, spark):
    model = language_id.fit(docs.where("lang is not null"), min_count=2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    truth = {r["doc_id"]: r["lang"] for r in docs.where("doc_id < 60 and length(text) > 20").collect()}
    assert np.mean([got[k][0] == v for k, v in truth.items()]) > 0.95
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(truth)
    none = language_id.fit(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert language_id.predict(empty.select("doc_id", "text"), model).count() == 0


def test_language_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    masks = np.zeros((1, 1 << 16), np.uint64)
    for s in language_id.slots(h, 16, 2):
        masks[0][s] |= np.uint64(4)
    got = masks[0][language_id.slots(h, 16, 2)[0]] & masks[0][language_id.slots(h, 16, 2)[1]]
    assert (got & np.uint64(4) > 0).all()
    model = language_id.Filter(["a", "b", "c"], masks, 16, 2, (2,))
    assert model.rates[0] == 0 and 0 < model.rates[2] < 0.05


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op8(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_recurrent_lm(docs, empty):
    out = recurrent_lm.score_documents(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    rows = docs.collect()
    count = Counter(w for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    want = Counter((r["doc_id"], len(tokens(r["text"])), sum(count[w] > 0 for w in tokens(r["text"])), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r["text"])), 4)) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in out)
    joined = recurrent_lm.score_documents(docs, most=0).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
    assert np.allclose([r["score"] for r in sorted(out, key=key)], [r["score"] for r in sorted(joined, key=key)])
    assert recurrent_lm.score_documents(empty).count() == 0


def tiny_model(seed=0):
    rng = np.random.default_rng(seed)
    heads = {10: (2, 1, 50), 11: (2, 2, 20), 12: (3, 1, 30)}
    model = recurrent_lm.Model({97: 2, 98: 3}, heads, np.array([0.0, 40, 90, 60]), np.array([0.0, 9, 12, 8]), 10)
    for k in model.p:
        model.p[k] = (model.p[k].astype(np.float64) + rng.standard_normal(model.p[k].shape) * 0.2 * (model.p[k] > -1e8)).astype(np.float64)
    return model


def test_lm_sums_to_one_and_gradients_are_right():
    model, rng = tiny_model(), np.random.default_rng(4)
    h = rng.standard_normal((1, recurrent_lm.HIDDEN))
    total = sum(np.exp(model.output(h, np.array([c]), np.array([i]))[0]) for c in range(model.classes) for i in range(model.items))
    assert total == pytest.approx(1, abs=1e-6)
    cls, item = rng.integers(0, 4, (5, 3)), np.zeros((5, 3), int)
    prev, first = rng.integers(0, model.bos + 1, (5, 3)), rng.random((5, 3)) < 0.3
    start = rng.standard_normal((3, recurrent_lm.HIDDEN)) * 0.1
    _, grads, _ = model._backward(cls, item, prev, first, start)
    for k in ("E", "Wx", "U", "Wc", "Wi", "b", "bc"):
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        keep, losses = model.p[k][at], []
        for d in (1e-3, -1e-3):
            model.p[k][at] = keep + d
            losses.append(model._backward(cls, item, prev, first, start)[0] / 3)
        model.p[k][at] = keep
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[k][at], rel=0.02), k


def test_lm_state_is_carried_across_windows():
    model, rng = tiny_model(1), np.random.default_rng(5)
    n = np.array([5, 0, 130, 64])
    cls, item = rng.integers(1, 4, n.sum()), np.zeros(n.sum(), int)
    whole = model.likelihoods(cls, item, n, steps=1000)
    assert np.allclose(whole, model.likelihoods(cls, item, n, steps=7))
    lo = 0
    for k, total in zip(n, whole, strict=True):
        assert model.likelihoods(cls[lo : lo + k], item[lo : lo + k], np.array([k]))[0] == pytest.approx(total, rel=1e-5)
        lo += k


def test_lm_beats_the_counts_on_held_out_text(spark, sf_dir):
    rows = recurrent_lm.op10(spark, sf_dir).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


PAGES = "page_id long, url string, html string, key string, sha string, refers_to long"


def test_warc(spark):
    rows = [(1, "http://b.example.org/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a.example.org/", None), (4, "http://a.example.org", ""), (None, "bad url\n[", "x\r\n\r\ny"), (None, None, None), (7, "http://b.example.org/x", "long " * 60_000), (8, "HTTP://WWW.B.example.org:80/X?b=2&a=1", "é" * 5), (8, "http://c", "é" * 5), (9, "http://c", "é" * 5)]
    df = spark.createDataFrame([(*r, "k", "s", 0) for r in rows], PAGES)
    for block in (1, 2, 3000):
        got = warc.round_trip(df, block=block, archive_bytes=2000).collect()
        first: dict = {}
        for i, _, h in rows:
            first[h or ""] = min((x for x in (i, first.get(h or "")) if x is not None), default=None)
        want = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in rows)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.round_trip(df.where("page_id > 100")).count() == 0
    assert warc.url_key("HTTP://WWW.B.example.org:80/X?b=2&a=1") == "org,example,b)/x?a=1&b=2"


def test_warc_records_are_gzip_members_and_the_index_finds_one(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"<p>{i}</p>", "", "", 0) for i in range(200)], PAGES)
    lines = warc.write_archives(df, f"file://{tmp_path}/a", archive_bytes=3000)
    files = warc.write_index(lines, f"file://{tmp_path}/i", 10)
    one = warc.lookup(spark.createDataFrame([("org,h3)/73", 73), ("org,none)/", 5)], "key string, page_id long"), files, f"file://{tmp_path}/i")
    assert [r["page_id"] for r in one.collect()] == [73]
    got = warc.read_records(one, f"file://{tmp_path}/a", with_payload=True).collect()
    assert [(r["url"], r["html"]) for r in got] == [("http://h3.org/73", "<p>73</p>")]
    name = next((tmp_path / "a").glob("*.warc.gz"))
    assert gzip.decompress(name.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_vp_search(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((3000, 6)), 1).astype(np.float32)
    x[:900] = x[0]  # a third is one vector
    rows = [(int(i), [float(v) for v in e]) for i, e in enumerate(x)] + [(5, [float(v) for v in x[5]]), (3001, None), (3002, [0.0] * 6), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3004, [float("nan")] * 6), (3005, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (3006, []), (3007, [1.0, 2.0]), (3008, [1.0, 2.5])]
    df = spark.createDataFrame([(i, e, "v") for i, e in rows], "vec_id long, embedding array<float>, v string")
    queries = df.where("vec_id % 100 = 0 or vec_id in (1, 3002, 3007)")
    ok = {}
    for i, e in rows:
        if i is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e):
            ok[i] = np.array(e, np.float32).astype(float)
    for factor, shards in ((1.0, 3), (2.0, 1)):
        got: dict = {}
        for r in vp_search.nearest(df, queries, factor=factor, shards=shards).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        asked = [q for q in ok if q % 100 == 0 or q in (1, 3007)]
        assert set(got) == set(asked)
        hits = 0
        for q in asked:
            near = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:10]
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
            hits += len({i for _, i, _ in mine} & {i for _, i in near}) / len(near)
            if factor == 1.0:
                assert [i for _, i, _ in mine] == [i for _, i in near] and np.allclose([s for *_, s in mine], [d for d, _ in near])
        assert hits / len(asked) >= 0.9
    assert vp_search.nearest(df.where("vec_id < 0"), df).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head&nbsp;line</h1><p>First <b>para</b>graph,  with\n white space &eacute;&#33; and a number of words to read.<p>Second one<br>goes on here, with some more words in it.<!-- no --></article>
<section class="comments"><p>Reader says: nice words here to read.</p></section><form><label>Mail</label><button>Go</button></form><aside class="sidebar"><a href=/x>Related thing</a></aside><footer>&copy; us</footer></body></html>"""


def test_html_text(spark):
    layouts = "page_id long, url string, html string, text string, n_blocks int"
    rows = [(i, f"http://h/{i}", PAGE.replace("First", f"First{i} and more of it") if i % 2 else PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>"), "", 0) for i in range(60)]
    odd = [(100, None, None, "", 0), (None, "u", "", "", 0), (102, "u", "<p><b>unclosed < & &bogus; <![CDATA[x]]> <//p", "", 0), (103, "u", "<article><p>" + "long words here. " * 20_000, "", 0), (104, "u", "<div>" * 3000, "", 0)]
    df = spark.createDataFrame(rows + odd, layouts)
    got = {r["page_id"]: r for r in html_text.main_text(df, html_text.fit(df)).collect()}
    want = "Head line {}paragraph, with white space é! and a number of words to read. Second one goes on here, with some more words in it."
    assert got[0]["text"] == want.format("First ") and got[1]["text"] == want.format("First1 and more of it ")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[100]["text"] == got[None]["text"] == got[104]["text"] == "" and len(got[103]["text"]) > 300_000
    assert html_text.main_text(df.where("page_id < 0"), html_text.fit(df.where("page_id < 0"))).count() == 0


def test_html_labeller_learns_from_context():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("aa bb cc dd ee".split()) for _ in range(30)) + "." for _ in range(50)]
    pages = [html_text.made_up_page(rng, texts, texts) for _ in range(160)]
    x, y = [html_text.vectors(b) for b, _ in pages], [np.array(label, np.float32) for _, label in pages]
    model = html_text.Labeller()
    losses = model.train(x[:120], y[:120], 8)
    right = [((s > 0.5) == t).mean() for s, t in zip(model.scores(x[120:]), y[120:], strict=True)]
    assert losses[-1] < losses[0] / 3 and np.mean(right) > 0.93


def test_lm_scores_each_row_once_in_large_batches(spark):
    df = spark.range(4000).selectExpr("id doc_id", "concat('word', id % 7, ' of ', id) text").coalesce(1)
    got = recurrent_lm.score_documents(df).select("doc_id").collect()
    assert sorted(r[0] for r in got) == list(range(4000))


def test_lm_trains_on_whole_documents_of_any_length(spark, monkeypatch):
    # a word that comes only late in the longest document is learnt from, and so is each token of every shard
    rows = [(i, "aa bb " * 3) for i in range(30)] + [(100, "cc dd " * 60_000 + "zz yy " * 500)]
    df = spark.createDataFrame(rows, "id long, text string")
    model, _ = recurrent_lm.fit(df, shard_tokens=2000)
    rest, _ = recurrent_lm.fit(df.where("id < 100"), shard_tokens=2000)
    word, tail, n = recurrent_lm.words_of(["zz yy " * 40])
    code = model.codes(*model.ids(word, tail), n)
    assert len(code) == 81 and code[-1] == 0 and all(code[:-1])
    late = lambda m: m.likelihoods(*m.ids(word, tail), n)[0] / 80
    assert late(model) > np.log(0.1) > late(rest)
    shards = recurrent_lm._shards(df, model, 7).collect()
    got = np.concatenate([np.frombuffer(r["codes"], np.uint16) for r in shards])
    assert len(got) == sum(len(t.split()) + 1 for _, t in rows) and sum(got == 0) == len(rows)
    seen = []
    monkeypatch.setattr(model, "_backward", lambda c, i, p, f, h: (seen.append(c * model.items + i), (0.0, {}, h))[1])
    for k in (1, 31, 100, 1003):
        seen.clear()
        model.train(got[:k])
        assert sorted(np.concatenate([x.ravel() for x in seen])) == sorted(got[:k])


def test_html_self_closed_icons_hide_nothing():
    read = lambda html: [b.text for b in html_text.Reader().read(html)]
    assert read('<article><svg class="icon"/><p>All of the article.</p><p>Its end.</p></article><p>After</p>') == ["All of the article.", "Its end.", "After"]
    assert read("<article><p>One <math/>two <svg/>three.</p><p>Four</p></article>") == ["One two three.", "Four"]
    # what lies inside closes itself too, with names that are silent elsewhere, and the outer tag still hides it
    assert read("<p>A<svg><g><path/><title/><style/><script/>x</g><circle/>y</svg>B</p>") == ["AB"]
    # elsewhere the slash means nothing, as in browsers
    assert read("<div hidden/>gone</div><p>kept</p>") == ["kept"]
