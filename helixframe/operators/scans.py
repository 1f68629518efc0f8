"""Scans over grids of edits and signals, and what is read off them.

A grid is an explode; states come from a column expression or a joined table of
solved distinct parameters, so the solver sees each parameter once. Results are
sums per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import col


def regime_scan(edits: DataFrame, ratio: str, signals: list[float], response: Callable[[Column, Column], Column], threshold: float, floor: float) -> DataFrame:
    """Every edit at every signal: the states of reference (ratio 1) and edit, the
    change, whether the fate flips, and its category."""
    from .collections import category

    grid = edits.withColumn("signal", F.explode(F.array(*map(F.lit, signals))))
    grid = grid.withColumn("before", response(F.lit(1.0), F.col("signal"))).withColumn("after", response(F.col(ratio), F.col("signal")))
    grid = grid.withColumn("change", F.col("after") - F.col("before")).withColumn("flip", (F.col("after") > threshold) != (F.col("before") > threshold))
    return grid.withColumn("category", category("change", F.col("flip"), floor))


def rescues(scan: DataFrame, keys: list[str], ratio: str, other: str, target: float = 1.0, size: int = 8) -> DataFrame:
    """Each group's second changes whose product with the first comes nearest to
    the target, ranked."""
    gap = F.abs(F.col(ratio) * F.col(other) - target)
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(gap, other))
    return scan.withColumn("gap", gap).withColumn("rank", r).filter(F.col("rank") <= size)


def profile(signals: DataFrame, key: str, length: str, positions: int, response: Callable[[Column], Column], threshold: float = 0.5) -> DataFrame:
    """(key, first, last, n): the domain of positions in [0, 1] at which the
    response to exp(-position / length) is above the threshold; nulls if none."""
    grid = signals.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(positions - 1)))).withColumn("_x", F.col("_i") / (positions - 1))
    on = response(F.exp(-F.col("_x") / F.col(length))) > threshold
    return grid.groupBy(key).agg(F.min(F.when(on, F.col("_x"))).alias("first"), F.max(F.when(on, F.col("_x"))).alias("last"), F.count_if(on).alias("n"))


def trajectory_difference(a: DataFrame, b: DataFrame, keys: list[str], order: str, value: str, stride: int = 1) -> DataFrame:
    """Greatest |difference| of aligned trajectories; b's times may be finer by a
    whole stride. Times that one side lacks count as missing."""
    l = a.select(*keys, F.col(order).alias("_t"), F.col(value).alias("_a"))
    r = b.filter(F.col(order) % stride == 0).select(*keys, (F.col(order) / stride).cast("long").alias("_t"), F.col(value).alias("_b"))
    both = l.withColumn("_t", F.col("_t").cast("long")).join(r, [*keys, "_t"], "full")
    return both.groupBy(*keys).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"))


def jittered(df: DataFrame, id_: str, draws: int, seed: str, width: float) -> DataFrame:
    """Each row ``draws`` times with a factor in [1 - width, 1 + width) that a
    hash of seed, id and draw gives, so any engine draws the same."""
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_), "draw").cast("binary"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return d.withColumn("factor", 1 - width + 2 * width * u)


def ensemble(draws: DataFrame, keys: list[str], state: str, threshold: float) -> DataFrame:
    """(keys, probability, p05, p95) of a state over a group's draws, of which
    there is a fixed number."""
    from .assays import array_quantile

    all_ = F.collect_list(state)
    g = draws.groupBy(*keys).agg(F.avg((F.col(state) > threshold).cast("double")).alias("probability"), all_.alias("_s"))
    return g.select(*keys, "probability", array_quantile("_s", 0.05).alias("p05"), array_quantile("_s", 0.95).alias("p95"))


def empirical_p(observed: DataFrame, decoys: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, p): (1 + decoys at least as great) / (1 + decoys)."""
    o = observed.select(*keys, F.col(value).alias("_o"))
    ge = F.count_if(F.col(value) >= F.col("_o"))
    return decoys.join(o, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ((1 + ge) / (1 + F.count(F.lit(1)))).alias("p"))


def falsified(df: DataFrame, keys: list[str], predicted: str, observed: str, rmse: float, agreement: float) -> DataFrame:
    """Each group's error and sign agreement, and whether either refutes it."""
    d = F.col(predicted) - F.col(observed)
    g = df.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg((F.signum(predicted) == F.signum(observed)).cast("double")).alias("agreement"))
    return g.withColumn("falsified", (F.col("rmse") > rmse) | (F.col("agreement") < agreement))


def benchmark(scan: DataFrame, locus: str, measured: DataFrame, edit: list[str], effect: str, truth: str) -> DataFrame:
    """Per locus: edits scanned, edits measured, and sign agreement on those."""
    m = measured.select(locus, *edit, F.col(truth).alias("_m"))
    j = scan.join(m, [locus, *edit], "left")
    hit = F.when(F.col("_m").isNotNull(), (F.signum(effect) == F.signum("_m")).cast("double"))
    return j.groupBy(locus).agg(F.count(F.lit(1)).alias("edits"), F.count("_m").alias("measured"), F.avg(hit).alias("agreement"))


def partition_delta(sequence, position, alt, weight: Callable[[Column, int], Column], width: int) -> Column:
    """Z(edit) - Z(reference) of a single-base change, from the windows that
    cover it alone; a window's weight is the product of ``weight(letter, place)``,
    on both strands."""
    from ..functions.sequence import reverse_complement

    s, p, a = col(sequence), col(position), col(alt)
    changed = F.concat(s.substr(F.lit(1), p), a, s.substr(p + 2, F.length(s)))
    lo, hi = F.greatest(p - width + 1, F.lit(0)), F.least(F.length(s) - width, p)

    def site(w: Column) -> Column:
        out = F.lit(1.0)
        for j in range(width):
            out = out * weight(w.substr(j + 1, 1), j)
        return out

    both = lambda w: site(w) + site(reverse_complement(w))
    each = lambda i: both(changed.substr(i + 1, F.lit(width))) - both(s.substr(i + 1, F.lit(width)))
    return F.when(lo <= hi, F.aggregate(F.transform(F.sequence(lo, F.greatest(hi, lo)), each), F.lit(0.0), lambda t, x: t + x)).otherwise(0.0)


def occupancy_delta(sequence, position, alt, score: Callable[[Column, int], Column], width: int, middle: float) -> Column:
    """Sum over sites that cover the edit, on both strands, of the change of
    1 / (1 + 2 ** (middle - score)); sites outside of the sequence don't count."""
    from ..functions.sequence import reverse_complement

    s, p, a = col(sequence), col(position), col(alt)
    changed = F.concat(s.substr(F.lit(1), p), a, s.substr(p + 2, F.length(s)))
    lo, hi = F.greatest(p - width + 1, F.lit(0)), F.least(F.length(s) - width, p)

    def occupied(w: Column) -> Column:
        total = F.lit(0.0)
        for j in range(width):
            total = total + score(w.substr(j + 1, 1), j)
        return 1 / (1 + F.pow(F.lit(2.0), middle - total))

    both = lambda w: occupied(w) + occupied(reverse_complement(w))
    each = lambda i: both(changed.substr(i + 1, F.lit(width))) - both(s.substr(i + 1, F.lit(width)))
    return F.when(lo <= hi, F.aggregate(F.transform(F.sequence(lo, F.greatest(hi, lo)), each), F.lit(0.0), lambda t, x: t + x)).otherwise(0.0)


def spliced(sequence, exons: list[tuple[int, int]], reverse: bool = False) -> Column:
    """The coding string of exons (from 0, end excluded) in genome order."""
    from ..functions.sequence import reverse_complement

    s = F.concat(*[col(sequence).substr(a + 1, b - a) for a, b in exons])
    return reverse_complement(s) if reverse else s


def genome_place(position, exons: list[tuple[int, int]], reverse: bool = False) -> Column:
    """The genome's place of a place of the coding string; null outside."""
    p, total = col(position), sum(b - a for a, b in exons)
    q = total - 1 - p if reverse else p
    out, done = F.lit(None).cast("long"), 0
    for a, b in exons:
        out = F.when((q >= done) & (q < done + b - a), (q - done + a).cast("long")).otherwise(out)
        done += b - a
    return out


def units(spark, count: int, fields: dict[str, Column]) -> DataFrame:
    """count units with dense ids from 0 and initialised fields."""
    return spark.range(count).withColumnRenamed("id", "unit").withColumns(fields)


def created(groups: DataFrame, order: list[str], count: str, fields: dict[str, Column]) -> DataFrame:
    """As many units as each group's count, with ordinal (from 0 within the group),
    initialised fields and dense ids from 0 in the order of the groups. Ids come
    from a running total of the counts, so no units are numbered in one task."""
    from .statistics import running_total

    some = running_total(groups.filter(F.col(count) > 0), order, count, "_to")
    each = some.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))
    return each.withColumn("unit", F.col("_to") - F.col(count) + F.col("ordinal")).withColumns(fields).drop("_to", count)


def write_conflicts(rules: DataFrame, phase: str, field: str, rule: str) -> DataFrame:
    """(phase, field, rules): fields that several rules write in one phase."""
    return rules.groupBy(phase, field).agg(F.count_distinct(rule).alias("rules")).filter("rules > 1")


def feature_edges(features: DataFrame, id_: str, parent: str, kind: str) -> DataFrame:
    """(child, parent, kind, closed): edges of features to their parents (an
    array), and whether the parent is a feature."""
    e = features.select(F.col(id_).alias("child"), F.explode(parent).alias("parent"), kind)
    there = features.select(F.col(id_).alias("parent"), F.lit(True).alias("_there")).distinct()
    return e.join(there, "parent", "left").select("child", "parent", kind, F.coalesce("_there", F.lit(False)).alias("closed"))


def compiled_features(features: DataFrame, id_: str, parent: str, kind: str) -> DataFrame:
    """Units (dense by id) with the dense numbers of their parents; a parent that
    is no feature raises. Numbers come from a range partition, not one task."""
    from .collections import ranked

    n = ranked(features.select(F.col(id_).alias("_id")).distinct(), "_id", "unit")
    own = features.join(n, F.col(id_) == F.col("_id")).drop("_id")
    e = own.select("unit", F.explode_outer(parent).alias("_p")).join(n.select(F.col("_id").alias("_p"), F.col("unit").alias("_u")), "_p", "left")
    broken = F.col("_p").isNotNull() & F.col("_u").isNull()
    up = e.filter(F.when(broken, F.raise_error(F.concat(F.lit("no feature "), F.col("_p"))).cast("boolean")).otherwise(True)).groupBy("unit").agg(F.array_sort(F.collect_list("_u")).alias("parents"))
    return own.join(up, "unit").select("unit", id_, kind, "parents")


def sealed_scan(scan: DataFrame, locus: str, id_: str, change: str) -> DataFrame:
    """The scan's predictions with a seal each, taken before any outcome is read:
    the digest of locus, id and the change in millionths."""
    whole = F.round(F.col(change) * 1e6).cast("long").cast("string")
    return scan.select(locus, id_, change, F.sha2(F.concat_ws(":", locus, id_, whole).cast("binary"), 256).alias("seal"))


def robust_edits(scan: DataFrame, locus: str, id_: str, ratio: str, change: str, response: Callable[[Column, Column], Column], threshold: float, size: int, draws: int, seed: str, width: float) -> DataFrame:
    """Each locus's ``size`` edits of the greatest |change|, and the share of a
    jittered ensemble in which their fate is above the threshold."""
    r = F.row_number().over(Window.partitionBy(locus).orderBy(F.abs(change).desc(), id_))
    top = scan.withColumn("rank", r).filter(F.col("rank") <= size)
    d = jittered(top, id_, draws, seed, width)
    on = response(F.col(ratio) * F.col("factor"), F.lit(1.0)) > threshold
    return d.groupBy(locus, "rank", id_).agg(F.avg(on.cast("double")).alias("probability"))


def report(scan: DataFrame, rescue: DataFrame, locus: str) -> DataFrame:
    """One row a locus: edits, flips, the share of silent ones, and the best
    rescue's gap (null without any)."""
    s = scan.groupBy(locus).agg(F.count(F.lit(1)).alias("edits"), F.count_if("flip").alias("flips"), F.avg((F.col("category") == "doubly_silent").cast("double")).alias("silent"))
    return s.join(rescue.groupBy(locus).agg(F.min("gap").alias("best_gap")), locus, "left")
