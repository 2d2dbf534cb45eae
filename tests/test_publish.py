"""Versions, splits, release gates and streaming upserts, with writes that are stopped between the steps."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tilewise.operators import gates
from tilewise.sources import sinks, versions
from tilewise.streaming import ingest

ROWS = "tile string, score double, city string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("step", ["write_version", "check_version", "_write meta", "_write current"])
def test_a_write_that_fails_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/layer"
    first = spark.createDataFrame([("b", 0.9, None), ("a", 0.8, "x")], ROWS)
    name = versions.publish(first, path, ["tile"], {"cut": 0.7})
    real = getattr(versions, step.split()[0])

    def stop(*a):
        if step.startswith("_write") and (("_meta" in a[1]) != step.endswith("meta")):
            return real(*a)
        if step == "write_version":
            real(*a)
        raise OSError("killed")

    monkeypatch.setattr(versions, step.split()[0], stop)
    with pytest.raises(OSError, match="killed"):
        versions.publish(versions.read(spark, path).withColumn("rank", F.lit(1)), path, ["tile"])
    monkeypatch.undo()
    assert versions.current(spark, path) == name and rows_of(versions.read(spark, path)) == rows_of(first)
    # and the rewrite of what is there goes through afterwards
    again = versions.publish(versions.read(spark, path).withColumn("rank", F.lit(1)), path, ["tile"])
    assert versions.current(spark, path) == again and versions.read(spark, path).columns == ["tile", "score", "city", "rank"]
    assert versions.meta(spark, path)["before"] == name and rows_of(versions.read(spark, path, name)) == rows_of(first)


def test_versions_are_sorted_counted_and_checked(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/layer"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    df = spark.range(5000).select(F.format_string("t%05d", (F.col("id") * 7919) % 5000).alias("tile"), (F.col("id") / 5000).alias("score"), F.lit("c").alias("city"))
    name = versions.publish(df.repartition(5), path, ["tile"], {"cut": 0.85}, "v1")
    lines = [json.loads(x)["tile"] for f in sorted(Path(path, name, "rows").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 5000
    assert versions.meta(spark, path) | {"schema": ""} == {"count": 5000, "cut": 0.85, "before": None, "schema": ""}
    monkeypatch.setattr(versions, "write_version", lambda df, *a: df.count() + 1)  # says more than can be read
    spark.createDataFrame([], ROWS).write.json(f"{path}/v2/rows")
    with pytest.raises(ValueError, match="0 of 1 rows"):
        versions.publish(spark.createDataFrame([], ROWS), path, ["tile"], name="v2")
    assert versions.current(spark, path) == "v1"


def test_split_reads_its_input_once(spark, tmp_path):
    spark.range(1000).selectExpr("id", "case when id % 10 = 3 then null else id % 7 end as share").write.parquet(f"{tmp_path}/in")
    df, keep = spark.read.parquet(f"{tmp_path}/in"), F.col("share") >= 2
    spark.sparkContext.setJobGroup("split", "")
    counts = versions.write_split(df, keep, f"{tmp_path}/out")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("split")) == 1
    spark.sparkContext.setJobGroup("", "")
    kept, skipped = (versions.split_side(spark, f"{tmp_path}/out", "id long, share long", k) for k in (True, False))
    assert counts == {"kept": kept.count(), "skipped": skipped.count()} == versions.planned(df, keep)
    assert rows_of(kept) == rows_of(df.where(keep)) and kept.count() + skipped.count() == 1000
    assert versions.write_split(df.where("id < 0"), keep, f"{tmp_path}/none") == {"kept": 0, "skipped": 0}


def test_release_gate(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gates, "RANGE", 1000)
    files = {"data/a.json": b"x" * 4500, "data/b.json": b"", "cfg.json": b"{}", "deep/er/c.bin": bytes(range(256)) * 9}
    for name, content in files.items():
        for side in ("one", "two"):
            at = tmp_path / side / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(content)
    sums = {r["file"]: (r["length"], r["sha256"]) for r in gates.file_sums(spark, f"{tmp_path}/one").collect()}
    assert sums == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    assert gates.compare_folders(spark, f"{tmp_path}/one", f"{tmp_path}/two").count() == 0
    (tmp_path / "two/cfg.json").write_bytes(b"{ }")
    (tmp_path / "two/data/a.json").unlink()
    (tmp_path / "two/new").write_bytes(b"1")
    assert rows_of(gates.compare_folders(spark, f"{tmp_path}/one", f"{tmp_path}/two")) == [("cfg.json", "different"), ("data/a.json", "missing"), ("new", "extra")]
    expected = spark.createDataFrame([("data/a.json", sums["data/a.json"][1], 4500), ("data/b.json", None, None), ("cfg.json", "0" * 64, None), ("gone", None, None), ("deep/er/c.bin", None, 5000)], "file string, sha256 string, at_least long")
    want = [("cfg.json", "mirror: different"), ("cfg.json", "not as pinned"), ("data/a.json", "mirror: missing"), ("data/b.json", "too short"), ("deep/er/c.bin", "too short"), ("gone", "missing"), ("new", "mirror: extra")]
    assert rows_of(gates.release(spark, f"{tmp_path}/one", expected, f"{tmp_path}/two")) == want


def test_upserts_and_a_batch_that_comes_again(spark, tmp_path):
    source, out, check = tmp_path / "in", f"{tmp_path}/out", tmp_path / "check"
    source.mkdir()

    def arrive(name, *records):
        lines = [json.dumps({"tile_id": t, "score": s, "fetch_ok": True, "ts": f"2026-01-01T00:00:{sec:02d}Z"}) for t, s, sec in records]
        (source / name).write_text("\n".join([*lines, "not json"]))

    def run():
        ingest.upsert_stream(ingest.scan_stream(spark, str(source)), out, str(check), floor=0.5).awaitTermination()
        return {r["tile_id"]: (r["score"], r["batch"]) for r in ingest.upserted(spark, out).collect()}

    arrive("1", ("a", 0.6, 1), ("a", 0.9, 2), ("b", 0.7, 1), ("low", 0.1, 1))
    assert run() == {"a": (0.9, 0), "b": (0.7, 0)}
    arrive("2", ("b", 0.8, 0), ("low", 0.6, 5), ("c", 0.7, 1))  # a later batch counts, whatever its times
    second = run()
    assert second == {"a": (0.9, 0), "b": (0.8, 1), "low": (0.6, 1), "c": (0.7, 1)}
    # the last batch was written, but its commit is lost: it comes again, and half of another attempt is there
    for f in (check / "commits").glob("*1*"):
        f.unlink()
    (Path(out) / "batch=1" / "part-half.parquet").write_bytes(b"half")
    assert run() == second


def test_a_layer_in_one_value_has_a_limit(spark):
    df = spark.createDataFrame([(121.0, 14.5, i) for i in range(5)], "lon double, lat double, n int")
    assert json.loads(sinks.feature_collection(df, {"cut": 1}, most=5).first()[0])["_meta"] == {"cut": 1, "count": 5}
    with pytest.raises(ValueError, match="more than 4 features"):
        sinks.feature_collection(df, {}, most=4)
