"""Family-balanced statistics, rank metrics, resampling and small linear fits.

Everything reduces to sums per group before rows meet, so shuffles carry one
row per group and task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import col
from .joins import checkpointed


def two_level_mean(df: DataFrame, family: str, value: str | Column) -> DataFrame:
    """One row: the mean over families of the mean over a family's rows."""
    v = col(value)
    return df.groupBy(family).agg(F.avg(v).alias("m")).agg(F.avg("m").alias("mean"), F.count("m").alias("families"))


def family_weight(df: DataFrame, family: str, name: str = "weight") -> DataFrame:
    """1 / (families * rows of the family): each family weighs the same."""
    n = df.groupBy(family).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.count(F.lit(1)).alias("_f"))
    return df.join(n, family).crossJoin(F.broadcast(total)).withColumn(name, 1 / (F.col("_f") * F.col("_n"))).drop("_n", "_f")


def three_level_weight(df: DataFrame, family: str, culture: str, name: str = "weight") -> DataFrame:
    """1 / (families * cultures of the family * rows of family and culture)."""
    n = df.groupBy(family, culture).agg(F.count(F.lit(1)).alias("_n"))
    c = n.groupBy(family).agg(F.count(F.lit(1)).alias("_c"))
    total = c.agg(F.count(F.lit(1)).alias("_f"))
    return df.join(n, [family, culture]).join(c, family).crossJoin(F.broadcast(total)).withColumn(name, 1 / (F.col("_f") * F.col("_c") * F.col("_n"))).drop("_n", "_c", "_f")


def pearson(x, y, w=None) -> Column:
    """Weighted Pearson r as an aggregate; null without variance or rows."""
    x, y = col(x).cast("double"), col(y).cast("double")
    w = F.lit(1.0) if w is None else col(w)
    w = F.when(x.isNotNull() & y.isNotNull(), w)
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - F.try_divide(sx * sy, n)
    vx, vy = F.sum(w * x * x) - F.try_divide(sx * sx, n), F.sum(w * y * y) - F.try_divide(sy * sy, n)
    return F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx * vy)))


def running_total(df: DataFrame, order: str | list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``, the sum of value over rows up to and with each one in a
    total order, without a sort in one task: a range partition sorts, and the
    totals of the partitions before (a row a partition) are joined back."""
    order = [order] if isinstance(order, str) else order
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    s = checkpointed(s)
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = s.groupBy("_p").agg(F.sum(value).alias("_t"))
    before = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_b"))
    return s.withColumn(name, own).join(F.broadcast(before), "_p").withColumn(name, F.col(name) + F.col("_b")).drop("_p", "_b")


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, a column for each name of qs): linear-interpolated quantiles of the
    values that aren't null. Counts of distinct values are numbered by a range
    partition, so neither a group nor the table meets in one task."""
    by = by or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    r = running_total(n, [*by, value], "_n", "_to")
    g = r.groupBy(*by).agg(F.sum("_n").alias("_t"), F.min(F.col("_to") - F.col("_n")).alias("_o"))
    r = r.join(g, by) if by else r.crossJoin(F.broadcast(g))
    first, last = F.col("_to") - F.col("_n") - F.col("_o"), F.col("_to") - F.col("_o") - 1
    columns = []
    for name, q in qs.items():
        at = (F.col("_t") - 1) * q
        low = F.floor(at)
        here = lambda k: F.max(F.when((first <= k) & (k <= last), F.col(value)))
        a, b = here(low), here(F.least(low + 1, F.col("_t") - 1))
        columns.append((a + (b - a) * F.max(at - low)).alias(name))
    return r.groupBy(*by).agg(*columns)


def mean_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 with ties averaged. Ranks come from counts of distinct
    values, so a ranking sorts values, not rows."""
    by = by or []
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        n = n.withColumn("_to", F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        n = running_total(n, value, "_n", "_to")
    ranks = n.withColumn(name, F.col("_to") - (F.col("_n") - 1) / 2.0).drop("_n", "_to")
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, ties: str = "mean", order: str | None = None) -> DataFrame:
    """One row rho: of averaged ranks, or of ordinal ranks where ``order``
    breaks ties."""
    if ties == "mean":
        r = mean_ranks(mean_ranks(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    else:
        one = df.withColumn("_one", F.lit(1).cast("long"))
        r = running_total(running_total(one, [x, order], "_one", "_rx"), [y, order], "_one", "_ry")
    return r.agg(pearson("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area under the curve; null with one class."""
    r = mean_ranks(df, score, "_r").agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("s"), F.sum((F.col(label) == 1).cast("int")).alias("p"), F.sum((F.col(label) == 0).cast("int")).alias("n"))
    return r.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auroc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def sign_accuracy(score, truth, middle: float = 0.0) -> Column:
    """Share of right signs as an aggregate; a score at the middle counts half."""
    s = col(score) - middle
    return F.avg(F.when(s == 0, 0.5).otherwise((F.signum(s) == F.signum(col(truth))).cast("double")))


def errors(predicted, truth) -> list[Column]:
    d = col(predicted) - col(truth)
    return [F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg((F.signum(col(predicted)) == F.signum(col(truth))).cast("double")).alias("sign_agreement")]


def one_per_family(df: DataFrame, family: str, score: str, id_: str) -> DataFrame:
    """Each family's row of the greatest |score|, the lesser id on ties."""
    best = F.row_number().over(Window.partitionBy(family).orderBy(F.abs(score).desc(), id_))
    return df.withColumn("_r", best).filter("_r = 1").drop("_r")


def panel(df: DataFrame, family: str, score: str, id_: str, size: int) -> DataFrame:
    """The size best rows of different families, ranked; raises if too few."""
    top = one_per_family(df, family, score, id_).orderBy(F.abs(score).desc(), id_).limit(size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(score).desc(), id_)))
    n = top.agg(F.count(F.lit(1)).alias("_n"))
    short = F.col("_n") < size
    checked = n.filter(F.when(short, F.raise_error(F.lit(f"fewer than {size} families")).cast("boolean")).otherwise(True))
    return ranked.crossJoin(F.broadcast(checked)).drop("_n")


def top_k_utility(df: DataFrame, family: str, score: str, truth: str, id_: str, copies: str, k: float) -> DataFrame:
    """Mean of sign(score) * truth over the k best families with copies; the
    last one counts in part."""
    # no more than k families have a part, as each has one copy at least
    one = one_per_family(df, family, score, id_).filter(F.col(copies) >= 1).orderBy(F.abs(score).desc(), id_).limit(int(-(-k // 1)))
    before = F.sum(copies).over(Window.orderBy(F.abs(score).desc(), id_).rowsBetween(Window.unboundedPreceding, -1))
    part = F.least(F.greatest(k - F.coalesce(before, F.lit(0)), F.lit(0)), F.col(copies))
    return one.withColumn("_p", part).agg((F.sum(F.col("_p") * F.signum(score) * F.col(truth)) / k).alias("utility"), F.sum("_p").alias("used"))


def softmax_by(df: DataFrame, group: str, score: str, name: str = "p") -> DataFrame:
    w = Window.partitionBy(group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top1_shared(df: DataFrame, group: str, score: str, truth: str) -> DataFrame:
    """Per group: the truth's share among rows with the greatest score."""
    m = df.groupBy(group).agg(F.max(score).alias("_m"))
    return df.join(m, group).filter(F.col(score) == F.col("_m")).groupBy(group).agg(F.avg(F.col(truth).cast("double")).alias("share"))


def pairwise_accuracy(df: DataFrame, group: str, order: str, score: str, truth: str, by: list[str]) -> DataFrame:
    """(by, n, accuracy): share of a group's pairs with different truths that the
    scores put in the same order. Groups are small by their nature (the rivals of
    one choice); a group's rows meet in one array, and pairs are counted there."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(score).cast("double").alias("s"), F.col(truth).cast("double").alias("t"))))
    g = df.groupBy(group, *by).agg(rows.alias("_r"))
    other = lambda a: F.filter("_r", lambda b: (b["i"] > a["i"]) & (b["t"] != a["t"]))
    right = lambda a: F.size(F.filter(other(a), lambda b: F.signum(a["t"] - b["t"]) == F.signum(a["s"] - b["s"])))
    count = lambda f: F.aggregate(F.transform("_r", f), F.lit(0), lambda t, x: t + x)
    n = g.select(*by, count(lambda a: F.size(other(a))).alias("_n"), count(right).alias("_k")).filter("_n > 0")
    return n.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_k") / F.sum("_n")).alias("accuracy"))


def leave_one_out(df: DataFrame, value: str) -> DataFrame:
    """Each row with the mean of the others."""
    total = df.agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return df.crossJoin(F.broadcast(total)).withColumn("others", F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1)).drop("_s", "_n")


def islands(df: DataFrame, keys: list[str], order: str, gap: float, name: str = "island") -> DataFrame:
    """Runs of rows whose neighbours are at most gap apart, numbered from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def crps(df: DataFrame, value: str, mass: str, observed: float) -> DataFrame:
    """CRPS of a discrete forecast: the squared distance of its distribution
    function from the observation's step, integrated between support points."""
    w = Window.orderBy(value)
    p = df.groupBy(value).agg(F.sum(mass).alias("_m"))
    p = p.unionByName(p.limit(1).select(F.lit(float(observed)).cast(p.schema[value].dataType).alias(value), F.lit(0.0).cast(p.schema["_m"].dataType).alias("_m")))
    p = p.groupBy(value).agg(F.sum("_m").alias("_m"))
    total = F.sum("_m").over(Window.partitionBy())
    p = p.withColumn("_f", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).withColumn("_next", F.lead(value).over(w))
    step = (F.col(value) >= observed).cast("double")
    return p.agg(F.sum((F.col("_next") - F.col(value)) * F.pow(F.col("_f") - step, 2)).alias("crps"))


def effective_size(w) -> Column:
    return F.try_divide(F.pow(F.sum(col(w)), 2), F.sum(col(w) * col(w)))


def hash_draws(families: DataFrame, family: str, draws: int, seed: str) -> DataFrame:
    """(draw, slot, family): whole families drawn with replacement, as many as
    there are. Slots hash to places, so any engine draws the same; families are
    numbered by a range partition."""
    n = families.select(family).distinct().withColumn("_one", F.lit(1).cast("long"))
    numbered = running_total(n, family, "_one", "_i").withColumn("_i", F.col("_i") - 1).drop("_one")
    total = n.agg(F.count(F.lit(1)).alias("_n"))
    grid = families.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "draw", "slot").cast("binary"), 256), 1, 12), 16, 10).cast("long") % F.col("_n")
    return grid.withColumn("_i", pick).join(numbered, "_i").select("draw", "slot", family)


def bootstrap(df: DataFrame, family: str, value: str, draws: int, seed: str) -> DataFrame:
    """(draw, mean): family-balanced means of resampled families; rows meet the
    draws as one mean a family."""
    means = df.groupBy(family).agg(F.avg(value).alias("_m"))
    copies = hash_draws(means, family, draws, seed).groupBy("draw", family).agg(F.count(F.lit(1)).alias("_c"))
    return copies.join(means, family).groupBy("draw").agg((F.sum(F.col("_c") * F.col("_m")) / F.sum("_c")).alias("mean"))


#: Groups whose cut is sent to the tasks.
MET = 1 << 14


def smallest_means(df: DataFrame, by: list[str], key: str, value: str, size: int, digits: int = 3) -> DataFrame:
    """(by, q): the mean value of each group's ``size`` rows of the least key (a
    lower-case hexadecimal hash). Counts of the key's first digits tell which
    rows are in, and only those that share the last prefix are sorted, so no
    group is. Prefixes are counted first and met where the rows are read, so rows
    outside of them are never shuffled; df is computed twice."""
    p = df.withColumn("_p", F.substring(key, 1, digits))
    n = p.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    n = checkpointed(n.withColumn("_to", F.sum("_n").over(w)))  # 16 ** digits rows a group at most
    whole = n.filter(F.col("_to") <= size).groupBy(*by).agg(F.sum("_s").alias("_s"), F.max("_to").alias("_c"))
    cut = n.filter((F.col("_to") > size) & (F.col("_to") - F.col("_n") < size)).select(*by, "_p", (F.col("_to") - F.col("_n")).alias("_b"))
    few = cut.limit(MET + 1).count() <= MET  # a row a group; more groups than that meet by a shuffle
    rest = p.join(F.broadcast(cut) if few else cut, [*by, "_p"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key)) + F.col("_b")).filter(F.col("_r") <= size)
    part = rest.groupBy(*by).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c")).withColumn("_part", F.lit(True))
    both = whole.select(*by, "_s", "_c").unionByName(part.select(*by, "_s", "_c"))
    return both.groupBy(*by).agg((F.sum("_s") / F.sum("_c")).alias("q"))


def order_interval(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """The low-th and high-th smallest of a bounded number of draws (from 0)."""
    a = df.agg(F.array_sort(F.collect_list(value)).alias("a"))
    return a.select(F.element_at("a", low + 1).alias("low"), F.element_at("a", high + 1).alias("high"))


def gram(df: DataFrame, xs: list[str], y: str, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(X'WX, X'Wy) in one aggregation; len(xs) is small and fixed."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w * F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(w * F.col(a) * F.col(y)) for a in xs]
    row = [float(v or 0) for v in df.agg(*sums).first()]
    n = len(xs)
    g = np.zeros((n, n))
    g[np.triu_indices(n)] = row[: n * (n + 1) // 2]
    return g + np.triu(g, 1).T, np.array(row[n * (n + 1) // 2 :])


def ridge(df: DataFrame, xs: list[str], y: str, penalty: float | list[float], weight: str | None = None) -> np.ndarray:
    """(G + diag(penalty)) b = c, with the sums from the cluster."""
    g, c = gram(df, xs, y, weight)
    return np.linalg.solve(g + np.diag(np.broadcast_to(penalty, len(xs))), c)


def leave_group_out_ridge(df: DataFrame, group: str, xs: list[str], y: str, penalty: float) -> DataFrame:
    """(group, coefficients) without each group: total sums minus the group's,
    solved where the groups are."""
    from .models import leave_group_out

    return leave_group_out(df, group, xs, y, penalty)


def logistic(df: DataFrame, xs: list[str], y: str, penalty: float, rounds: int = 25, weight: str | None = None) -> np.ndarray:
    """L2 logistic regression by Newton steps; each round is one aggregation."""
    b = np.zeros(len(xs))
    w = F.col(weight) if weight else F.lit(1.0)
    df = df.select(*xs, y, w.alias("_w")).cache()
    for _ in range(rounds):
        z = sum((F.col(x) * float(v) for x, v in zip(xs, b, strict=True)), F.lit(0.0))
        p = df.withColumn("_p", 1 / (1 + F.exp(-z)))
        p = p.withColumn("_h", F.col("_w") * F.col("_p") * (1 - F.col("_p"))).withColumn("_g", F.col("_w") * (F.col("_p") - F.col(y)))
        h, _ = gram(p, xs, y, "_h")
        one = np.array([float(v or 0) for v in p.agg(*[F.sum(F.col("_g") * F.col(x)) for x in xs]).first()])
        step = np.linalg.solve(h + penalty * np.eye(len(xs)), one + penalty * b)
        b = b - step
        if np.abs(step).max() < 1e-10:
            break
    df.unpersist()
    return b
