"""Graphs deeper than the rounds of one level each; rows of components."""

import random

from helixframe.operators import joins as J
from helixframe.operators import lineage


def test_what_lies_deeper_is_closed_by_doubling(spark, monkeypatch):
    monkeypatch.setattr(lineage, "DEEP", 2)
    edges = [(k, k + 1) for k in range(9)] + [(0, 5), (3, 8), (20, 21), (21, 20), (22, 21), (20, 9), (23, 22)]
    nodes = spark.createDataFrame([(k,) for k in range(24)], "id long")
    got = {r.node: (r.level, r.above, r.fault) for r in lineage.levels(nodes, "id", spark.createDataFrame(edges, "c long, p long"), "c", "p").collect()}
    want = {k: (9 - k, 9 - k, None) for k in range(10)} | {k: (0, 0, None) for k in range(10, 20)}
    want |= {20: (None, None, "cycle"), 21: (None, None, "cycle"), 22: (None, None, "below a cycle"), 23: (None, None, "below a cycle")}
    assert got == want


def test_rows_of_a_task_are_bounded(spark):
    d = J.stored(spark.range(5000))
    assert J.in_parts(d, "id", rows=100).rdd.getNumPartitions() == 50
