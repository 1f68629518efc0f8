"""Fits whose data stays on the cluster: sums come to the driver, rows don't."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import gram


def moments(df: DataFrame, xs: list[str], y: str, by: str | None = None) -> dict:
    """Per value of ``by`` (a bounded parameter, such as split or fold): n, sums
    and second moments of (xs, y), in one aggregation."""
    names = [*xs, y]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)] + [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    rows = (df.groupBy(by) if by else df.groupBy(F.lit(0).alias("_all"))).agg(*sums).collect()
    out = {}
    for r in rows:
        second = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                second[i, j] = second[j, i] = float(r[f"p{i}_{j}"] or 0)
        out[r[0]] = (int(r["n"]), np.array([float(r[f"s{i}"] or 0) for i in range(len(names))]), second)
    return out


def _added(parts: list[tuple]) -> tuple:
    return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)


def standardised_ridge(part: tuple, penalty: float, floor: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, means, deviations) of a ridge on standardised features
    without an intercept, from moments alone."""
    n, s, p = part
    mean = s[:-1] / n
    sd = np.sqrt(np.maximum(np.diag(p)[:-1] / n - mean**2, 0)) + floor
    xx = (p[:-1, :-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    xy = (p[:-1, -1] - mean * s[-1]) / sd
    return np.linalg.solve(xx + penalty * np.eye(len(mean)), xy), mean, sd


def correlation(part: tuple, b: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> float:
    """Pearson r of the prediction with y on rows that have these moments; 0
    without variance."""
    n, s, p = part
    w = b / sd
    vx = w @ (p[:-1, :-1] / n - np.outer(s[:-1], s[:-1]) / n**2) @ w
    vy = p[-1, -1] / n - (s[-1] / n) ** 2
    cov = w @ (p[:-1, -1] / n - s[:-1] * s[-1] / n**2)
    return float(cov / np.sqrt(vx * vy)) if vx > 0 and vy > 0 else 0.0


def ridge_sweep(df: DataFrame, xs: list[str], y: str, split: str, penalties: list[float]) -> dict:
    """The penalty with the best validation r (the first of equals), and the fit
    on train and validation with it. One aggregation, whatever the sweep."""
    m = moments(df, xs, y, split)
    tried = []
    for penalty in penalties:
        b, mean, sd = standardised_ridge(m["train"], penalty)
        tried.append((penalty, correlation(m["val"], b, mean, sd)))
    best = max(tried, key=lambda t: t[1])[0]
    both = _added([m["train"], m["val"]])
    b, mean, sd = standardised_ridge(both, best)
    out = {"penalty": best, "sweep": tried, "coefficients": b, "mean": mean, "deviation": sd}
    if "test" in m:
        out["test_r"] = correlation(m["test"], b, mean, sd)
    return out


def nested_ridge(df: DataFrame, xs: list[str], y: str, fold: str, penalties: list[float]) -> dict:
    """For each held-out fold, the penalty that inner folds choose (leave one out
    of the rest, mean r) and the held-out r of the fit on the rest. Folds are a
    bounded parameter; their moments are all that comes here."""
    m = moments(df, xs, y, fold)
    out = {}
    for held in sorted(m):
        rest = [k for k in sorted(m) if k != held]

        def inner(penalty: float, rest=rest) -> float:
            rs = []
            for k in rest:
                others = [m[j] for j in rest if j != k]
                if others:
                    b, mean, sd = standardised_ridge(_added(others), penalty)
                    rs.append(correlation(m[k], b, mean, sd))
            return float(np.mean(rs)) if rs else 0.0

        best = max(penalties, key=lambda p: (inner(p), -penalties.index(p)))
        b, mean, sd = standardised_ridge(_added([m[k] for k in rest]), best)
        out[held] = {"penalty": best, "coefficients": b, "held_out_r": correlation(m[held], b, mean, sd)}
    return out


def temporal_basis(values: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of polynomials up to rank - 1 over time points."""
    x = (values - values.mean()) / (np.ptp(values) or 1.0)
    q, r = np.linalg.qr(np.vander(x, rank, increasing=True))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _leave_out(batches: Iterator[pa.RecordBatch], size: int, penalty: float, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = size * (size + 1) // 2
    for b in batches:
        own = np.array(b.column("m").to_pylist(), float).reshape(b.num_rows, -1)
        out = []
        for v in total - own:
            g = np.zeros((size, size))
            g[np.triu_indices(size)] = v[:pairs]
            out.append(np.linalg.solve(g + np.triu(g, 1).T + penalty * np.eye(size), v[pairs:]))
        yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(out, pa.list_(pa.float64()))], ["group", "coefficients"])


def leave_group_out(df: DataFrame, group: str, xs: list[str], y: str, penalty: float) -> DataFrame:
    """(group, coefficients) of the ridge without each group's rows: groups stay
    on the cluster, however many, and only the sums of all come here."""
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(F.col(a) * F.col(y)) for a in xs]
    total = np.array([float(v or 0) for v in df.agg(*sums).first()])
    own = df.groupBy(F.col(group).alias("group")).agg(F.array(*sums).alias("m"))
    kind = own.schema["group"].dataType.simpleString()
    return own.mapInArrow(partial(_leave_out, size=len(xs), penalty=penalty, total=total), f"group {kind}, coefficients array<double>")


def conditional_logit(df: DataFrame, group: str, xs: list[str], chosen: str, penalty: float, rounds: int = 30) -> np.ndarray:
    """L2 conditional logit (softmax within groups) by Newton steps; a group's
    rows meet as sums of weights, one aggregation of groups a round."""
    k = len(xs)
    b = np.zeros(k)
    for _ in range(rounds):
        z = sum((F.col(x) * float(v) for x, v in zip(xs, b, strict=True)), F.lit(0.0))
        e = F.exp(F.least(z, F.lit(500.0)))
        sums = [F.sum(e).alias("w")] + [F.sum(e * F.col(x)).alias(f"m{i}") for i, x in enumerate(xs)] + [F.sum(e * F.col(a) * F.col(c)).alias(f"h{i}_{j}") for i, a in enumerate(xs) for j, c in enumerate(xs) if j >= i] + [F.sum(F.when(F.col(chosen) == 1, F.col(x)).otherwise(0.0)).alias(f"c{i}") for i, x in enumerate(xs)] + [F.sum((F.col(chosen) == 1).cast("double")).alias("n")]
        g = df.groupBy(group).agg(*sums)
        grad = [F.sum(F.col(f"c{i}") - F.col("n") * F.col(f"m{i}") / F.col("w")) for i in range(k)]
        hess = [F.sum(F.col("n") * (F.col(f"h{i}_{j}") / F.col("w") - F.col(f"m{i}") * F.col(f"m{j}") / (F.col("w") * F.col("w")))) for i in range(k) for j in range(i, k)]
        row = [float(v or 0) for v in g.agg(*grad, *hess).first()]
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = row[k:]
        step = np.linalg.solve(h + np.triu(h, 1).T + penalty * np.eye(k), np.array(row[:k]) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


def boosted_trees(df: DataFrame, xs: list[str], y: str, weight: str | None = None, rounds: int = 20, depth: int = 3, seed: int = 7):
    """Gradient-boosted trees for a 0/1 label, by Spark's own learner."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=xs, outputCol="_features").transform(df)
    learner = GBTClassifier(featuresCol="_features", labelCol=y, maxIter=rounds, maxDepth=depth, seed=seed)
    return (learner.setWeightCol(weight) if weight else learner).fit(rows)


def ridge_from_gram(df: DataFrame, xs: list[str], y: str, penalties: list[float], weight: str | None = None) -> np.ndarray:
    """Weighted ridge with a penalty for each column."""
    g, c = gram(df, xs, y, weight)
    return np.linalg.solve(g + np.diag(penalties), c)
