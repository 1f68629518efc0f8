"""Operators whose work or rows grew faster than their tables, against plain loops."""

import random

from pyspark.sql import functions as F

from helixframe.operators import joins as J


def test_nearest_hamming_is_the_nearest_in_blocks(spark):
    g = random.Random(5)
    rows = [(k, "".join(g.choice("ACGT") for _ in range(g.choice([6, 6, 6, 9])))) for k in range(240)]
    rows += [(500 + k, "ACGTAC") for k in range(30)] + [(7, "ACGTAA"), (8, None), (None, "AAAAAA"), (9, ""), (700, "äöüß€𝄞"), (701, "äöüßxy")]
    d = spark.createDataFrame(rows, "id long, v string")
    queries = [(k, v) for k, v in rows if k is not None and (k % 7 == 0 or k >= 700)]
    found = J.nearest_hamming(spark.createDataFrame(queries, "id long, v string"), d, "id", "v", 8, 32)
    want = []
    for i, v in set(queries):
        near = [(sum(a != b for a, b in zip(v, w, strict=True)), k) for k, w in rows if v is not None and w is not None and k is not None and k != i and w != v and len(w) == len(v)]
        want += [(i, k, n) for n, k in near if n == min(near)[0]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_hamming_pairs_are_not_rows(spark):
    d = spark.range(3000).select("id", F.translate(F.sha2(F.col("id").cast("string").cast("binary"), 256), "0123456789abcdef", "ACGTACGTACGTACGT").alias("v"))
    plan = J.nearest_hamming(d.filter("id % 50 = 0"), d, "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "explode(_q" not in plan
