"""Draws by the least hashes meet their cuts where rows are read."""

from pyspark.sql import functions as F

from helixframe.operators import statistics as Q


def test_rows_outside_of_the_cut_are_not_shuffled(spark):
    d = spark.range(4000).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    rows = d.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Q.smallest_means(d, ["g"], "h", "x", 700)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = {r.g: r.q for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "strategy=broadcast" in plan
    for k in range(3):
        mine = sorted((r.h, r.x) for r in rows if r.g == k)[:700]
        assert abs(got[k] - sum(x for _, x in mine) / 700) < 1e-9
