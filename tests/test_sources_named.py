"""Names of training sources beyond four digits."""

from pyspark.sql import functions as F

from tilewise.operators import assembly


def test_more_than_9999_sources_have_names_of_their_own(spark):
    rows = spark.range(1, 10_003).select(F.col("id").alias("key"), F.lit(0).alias("y"), F.lit(14.5).alias("lat"), F.lit(121.0).alias("lon"))
    got = {r["key"]: r["src"] for r in assembly.training_sources([("neg", rows)]).select("key", "src").collect()}
    assert len(set(got.values())) == 10_002
    assert (got[1], got[9_999], got[10_000], got[10_002]) == ("neg_0001", "neg_9999", "neg_10000", "neg_10002")
