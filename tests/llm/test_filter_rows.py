"""Bit filters of ids: what they keep, and how much is broadcast."""

from pyspark.sql import functions as F

from helixframe.llm.common import FILTER_BITS, _bits, may_contain, without


def test_a_filter_is_a_few_rows_however_many_ids(spark):
    ids = spark.range(400_000).select((F.col("id") * 7).alias("i"))
    rows = _bits(ids, "i", FILTER_BITS).select(F.octet_length("_bits").alias("n")).collect()
    assert len(rows) <= FILTER_BITS // 8 // 4096 and sum(r.n for r in rows) <= FILTER_BITS // 8


def test_filters_keep_all_ids_and_few_others(spark):
    docs = spark.range(-5000, 20_000).select(F.when(F.col("id") % 1000 == 1, None).otherwise(F.col("id")).alias("d"))
    ids = spark.range(0, 20_000, 3).select(F.col("id").alias("i"))
    kept = {r.d for r in may_contain(docs, "d", ids, "i").collect()}
    want = {r.d for r in docs.collect() if r.d is not None and r.d >= 0 and r.d % 3 == 0}
    assert want <= kept and len(kept - want) < 100
    left = without(docs, "d", ids, "i")
    assert {r.d for r in left.collect()} == {r.d for r in docs.collect()} - want and left.filter("d is null").count() == 20
    assert len({r.d for r in may_contain(docs, "d", ids, "i", 1 << 7).collect()} & want) == len(want)
