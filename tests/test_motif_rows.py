"""Motif features are reduced, or scored in place, before rows are shuffled."""

from pyspark.sql import functions as F

from helixframe.operators import motifs


def test_summaries_and_rows_scored_in_place(spark):
    rows = [(k, "ACGTTGCAAC"[k % 4 :] + "GATTACA", "ACGTTGCAAC"[k % 4 :] + "GATTTCA") for k in range(30)] + [(30, None, None), (31, "", "")]
    d = spark.createDataFrame(rows, "id long, reference string, sequence string")
    drawn = motifs.drawn_matrices(7)
    total = F.aggregate("delta", F.lit(0.0), lambda s, x: s + x)
    short = motifs.motif_deltas(d, drawn, summary={"total": total})
    assert short.columns == ["reference", "sequence", "id", "total"]
    assert {r.id: r.total for r in short.collect()} == {r.id: r.total for r in motifs.motif_deltas(d, drawn).withColumn("total", total).collect()}
    here = motifs.motif_endpoints(d, drawn, once=False)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.potential for r in here.collect()} == {r.id: r.potential for r in motifs.motif_endpoints(d, drawn).collect()}


def test_shuffles_are_those_of_random():
    import random

    from helixframe.operators import simulate

    for n in range(40):
        x, y = list(range(n)), list(range(n))
        random.Random(n).shuffle(x)
        simulate._shuffle(y, random.Random(n).getrandbits)
        assert x == y
