"""Motif features, scans and fits against loops."""

import math

import numpy as np
import pytest
from helixframe.operators import models, motifs, scans, simulate
from helixframe.operators import statistics as Q
from pyspark.sql import functions as F

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def potential(s, m, scale):
    """One motif over one sequence, window by window."""
    total, width = 0.0, m.shape[1]
    for i in range(len(s) - width + 1):
        w = s[i : i + width]
        if set(w) <= set("ACGT"):
            one = sum(m["ACGT".index(c), j] for j, c in enumerate(w))
            two = sum(m["ACGT".index(c), j] for j, c in enumerate(w.translate(COMPLEMENT)[::-1]))
            total += math.log1p(scale * (math.exp(one) + math.exp(two)) / 2) - math.log1p(scale)
    return total


def test_motif_features_match_loops(spark):
    matrices = motifs.drawn_matrices(9, 3)
    r = ["ACGTTGCAACGGTCATTGACCAGT", "ACGTTGCAACGGTCATTGACCAGT", "AAAA", "ACGNTTACGTAACCGGTTAACCGG", "ACGTTGCAACGGTCATTGACCAGT", ""]
    s = ["ACGTTGCAACGATCATTGACCAGT", "ACGTTGCAACGGACATTGACCAGT"[:20], "AAAAA", "ACGNTTACGTAACCGATTAACCGG", "ACGTTGCAACGGTCATTGACCAGT", "A"]
    want = np.array([[potential(b, m, 0.7) - potential(a, m, 0.7) for m in matrices] for a, b in zip(r, s, strict=True)])
    assert np.allclose(motifs.deltas(r, s, motifs.families(matrices), 0.7), want, atol=1e-10)
    assert np.allclose(motifs.endpoints(s, motifs.families(matrices), 0.7), [[potential(x, m, 0.7) for m in matrices] for x in s], atol=1e-10)
    d = spark.createDataFrame([(k, a, b, 1.0) for k, (a, b) in enumerate(zip(r, s, strict=True))] + [(9, None, "A", 2.0)], "id int, reference string, sequence string, delta_of double")
    got = {x.id: x for x in motifs.motif_deltas(d, matrices, 0.7, quadratic=True).collect()}
    for k in range(len(r)):
        both = np.array([potential(r[k], m, 0.7) + potential(s[k], m, 0.7) for m in matrices])
        assert np.allclose(got[k].delta, want[k], atol=1e-10) and np.allclose(got[k].quadratic, want[k] * both, atol=1e-8)
    assert got[9].delta is None


def test_adaptive_steps_are_each_rows_own():
    f = lambda s, rows: np.array([[-1.0], [-40.0], [-0.1]])[rows] * s
    start = np.array([[0.8], [0.9], [0.5]])
    together = simulate.adaptive_rk4(start, f, 2.0, by_row=True)
    for k in range(3):
        alone = simulate.adaptive_rk4(start[k : k + 1], lambda s, rows, k=k: f(s, rows + k), 2.0, by_row=True)
        assert alone[0, 0] == together[k, 0]


def test_networks_and_traces_run_apart(spark):
    jumps = [("a", 1.0, 0, 0.6), ("a", 1.0, 0, 0.6), ("b", 1.0, 0, 1.2), ("b", 3.0, 1, 0.5)]
    pairs = [("b", 0, 1)]
    got = sorted(tuple(r) for r in simulate.network_spikes(spark.createDataFrame(jumps, "network string, time double, cell int, jump double"), spark.createDataFrame(pairs, "network string, source int, target int")).collect())
    want = [("a", t, c) for t, c in simulate.spikes([0], [], [(1.0, 0, 0.6)] * 2)] + [("b", t, c) for t, c in simulate.spikes([0, 1], [(0, 1)], [(1.0, 0, 1.2), (3.0, 1, 0.5)])]
    assert got == want
    e = [(1, 0, "cell", 0, 1, None), (1, 1, "segment", 1, 2, None), (2, 0, "cell", 0, 1, None)]
    d = spark.createDataFrame(e, "trace int, seq int, event string, step int, cell int, target int")
    assert [tuple(r) for r in simulate.trace_faults(d, "trace").collect()] == [(1, "segment of unknown cell 2")]


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = x @ [0.5, -0.2, 3.0] + 0.5 * g.normal(size=400)
    split = np.array(["train", "val", "test"])[g.integers(0, 3, 400)]
    fold = g.integers(0, 4, 400)
    d = spark.createDataFrame([(*map(float, x[k]), float(y[k]), str(split[k]), int(fold[k])) for k in range(400)], "a double, b double, c double, y double, split string, fold int")
    return d, x, y, split, fold


def ridge(x, y, penalty):
    mean, sd = x.mean(0), x.std(0) + 1e-8
    z = (x - mean) / sd
    return np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ y), mean, sd


def test_ridge_sweep(rows):
    d, x, y, split, _ = rows
    tried = []
    for p in (0.1, 10.0, 1000.0):
        b, m, s = ridge(x[split == "train"], y[split == "train"], p)
        v = split == "val"
        tried.append((p, np.corrcoef((x[v] - m) / s @ b, y[v])[0, 1]))
    got = models.ridge_sweep(d, ["a", "b", "c"], "y", "split", [0.1, 10.0, 1000.0])
    assert got["penalty"] == max(tried, key=lambda t: t[1])[0] and np.allclose([r for _, r in got["sweep"]], [r for _, r in tried])
    both = split != "test"
    b, m, s = ridge(x[both], y[both], got["penalty"])
    assert np.allclose(got["coefficients"], b) and math.isclose(got["test_r"], np.corrcoef((x[~both] - m) / s @ b, y[~both])[0, 1], rel_tol=1e-9)


def test_nested_ridge(rows):
    d, x, y, _, fold = rows
    got = models.nested_ridge(d, ["a", "b", "c"], "y", "fold", [0.1, 500.0])
    for held in range(4):
        score = []
        for p in (0.1, 500.0):
            rs = []
            for k in set(range(4)) - {held}:
                rest = (fold != held) & (fold != k)
                b, m, s = ridge(x[rest], y[rest], p)
                rs.append(np.corrcoef((x[fold == k] - m) / s @ b, y[fold == k])[0, 1])
            score.append(np.mean(rs))
        assert got[held]["penalty"] == (0.1, 500.0)[int(np.argmax(score))]
        b, m, s = ridge(x[fold != held], y[fold != held], got[held]["penalty"])
        assert math.isclose(got[held]["held_out_r"], np.corrcoef((x[fold == held] - m) / s @ b, y[fold == held])[0, 1], rel_tol=1e-9)


def test_leave_group_out_and_penalties(rows):
    d, x, y, _, fold = rows
    for r in Q.leave_group_out_ridge(d, "fold", ["a", "b", "c"], "y", 2.0).collect():
        k = fold != r.group
        assert np.allclose(r.coefficients, np.linalg.solve(x[k].T @ x[k] + 2 * np.eye(3), x[k].T @ y[k]))
    assert np.allclose(models.ridge_from_gram(d, ["a", "b", "c"], "y", [1.0, 2.0, 3.0]), np.linalg.solve(x.T @ x + np.diag([1.0, 2.0, 3.0]), x.T @ y))
    q = models.temporal_basis(np.array([0.0, 3, 6, 12, 24, 48, 72]), 3)
    assert np.allclose(q.T @ q, np.eye(3))


def test_conditional_logit_and_trees(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 5, 2))
    z = x @ [1.0, -0.5]
    pick = np.array([g.choice(5, p=np.exp(v) / np.exp(v).sum()) for v in z])
    d = spark.createDataFrame([(k, float(x[k, i, 0]), float(x[k, i, 1]), int(pick[k] == i)) for k in range(60) for i in range(5)], "g int, a double, b double, chosen int")
    b = models.conditional_logit(d, "g", ["a", "b"], "chosen", 0.7)
    p = np.exp(x @ b)
    p /= p.sum(1, keepdims=True)
    grad = x[np.arange(60), pick].sum(0) - (p[:, :, None] * x).sum((0, 1)) - 0.7 * b
    assert np.abs(grad).max() < 1e-6
    m = models.boosted_trees(d.withColumn("y", (F.col("a") > 0).cast("double")), ["a", "b"], "y", rounds=3)
    out = m.transform(__import__("pyspark.ml.feature", fromlist=["VectorAssembler"]).VectorAssembler(inputCols=["a", "b"], outputCol="_features").transform(d))
    assert out.filter("(a > 0) <> (prediction > 0.5)").count() <= 6


def test_running_totals_and_ranks(spark):
    g = np.random.default_rng(5)
    v = g.integers(0, 40, 500)
    d = spark.createDataFrame([(k, int(x)) for k, x in enumerate(v)], "i long, v long").repartition(7)
    got = {r.i: r.t for r in Q.running_total(d, ["v", "i"], "v", "t").collect()}
    order = sorted(range(500), key=lambda k: (v[k], k))
    total = 0
    for k in order:
        total += int(v[k])
        assert got[k] == total
    keys = spark.createDataFrame([(k % 3, f"{k * 2654435761 % 2**32:08x}", float(k)) for k in range(300)], "g long, h string, x double")
    for size in (1, 17, 99, 100, 200):
        for r in Q.smallest_means(keys, ["g"], "h", "x", size, 1).collect():
            mine = sorted((f"{k * 2654435761 % 2**32:08x}", k) for k in range(300) if k % 3 == r.g)[:size]
            assert math.isclose(r.q, np.mean([k for _, k in mine]))


def test_scans(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 0.1)], "k string, ratio double")
    s = scans.regime_scan(d, "ratio", [0.5, 4.0], lambda r, x: r * x / (1 + r * x), 0.5, 0.05).collect()
    assert {(r.k, r.signal): r.category for r in s} == {("a", 0.5): "doubly_silent", ("a", 4.0): "doubly_silent", ("b", 0.5): "reporter_only", ("b", 4.0): "concordant"}
    f = spark.createDataFrame([("g", []), ("t", ["g"]), ("e", ["t", "g"])], "id string, up array<string>").withColumn("kind", F.lit("x"))
    got = {r.id: (r.unit, r.parents) for r in scans.compiled_features(f, "id", "up", "kind").collect()}
    assert got == {"e": (0, [1, 2]), "g": (1, []), "t": (2, [1])}
    with pytest.raises(Exception, match="no feature q"):
        scans.compiled_features(spark.createDataFrame([("g", ["q"])], "id string, up array<string>").withColumn("kind", F.lit("x")), "id", "up", "kind").collect()


def test_exact_quantiles(spark):
    g = np.random.default_rng(8)
    v, k = g.integers(0, 30, 400).astype(float), g.integers(0, 3, 400)
    d = spark.createDataFrame([(int(a), float(x)) for a, x in zip(k, v)] + [(0, None)], "k int, v double").repartition(5)
    for r in Q.exact_quantiles(d, "v", {"a": 0.0, "b": 0.37, "c": 1.0}, ["k"]).collect():
        assert np.allclose([r.a, r.b, r.c], np.quantile(v[k == r.k], [0, 0.37, 1]))
    r = Q.exact_quantiles(d, "v", {"m": 0.5}).first()
    assert math.isclose(r.m, np.median(v))
