"""Inverse design: which edits bring a locus into a wanted state.

Ratios multiply, and the response grows with their product. So the search keeps a
frontier of edit sets as a DataFrame: each round extends every kept set by one
edit, takes sets of the same edits together and keeps the best of each locus.
The driver counts rounds, never candidates. Second sites that undo a first edit
are neighbours in the order of ratios, found by number and not by pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import checkpointed
from .scans import jittered
from .statistics import running_total

#: Salts over which a locus with many edits is spread.
SALTS = 16


def _best(sets: DataFrame, most: int) -> DataFrame:
    """The sets of each locus with the greatest gain, ties to the smaller ids."""
    order = Window.partitionBy("locus").orderBy(F.desc("gain"), "ids")
    return sets.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _extended(frontier: DataFrame, edits: DataFrame, gain: Callable[[Column, Column, Column], Column], size: int, most: int) -> DataFrame:
    """Sets of the frontier with one edit more, at a place of its own. A set of
    ``size`` edits is reached in as many ways at most, so the best rows of each
    task hold the best sets whatever their copies."""
    f = frontier.select("locus", "signal", "wanted", "ids", "places", F.col("ratio").alias("_before"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    e = edits.select("locus", "id", "place", "ratio", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt"))
    met = f.join(e, ["locus", "_salt"]).filter(~F.array_contains("places", F.col("place")))
    sets = met.select("locus", "signal", "wanted", F.array_sort(F.concat("ids", F.array("id"))).alias("ids"), F.array_sort(F.concat("places", F.array("place"))).alias("places"), (F.col("_before") * F.col("ratio")).alias("ratio"))
    some = _best(sets.withColumn("gain", gain(F.col("ratio"), F.col("signal"), F.col("wanted"))), most * size)
    once = some.groupBy("locus", "ids").agg(*[F.min(c).alias(c) for c in ("signal", "wanted", "places", "ratio", "gain")])
    return _best(once, most)


def edit_sets(edits: DataFrame, loci: DataFrame, response: Callable[[Column, Column], Column], threshold: float, most_edits: int = 2, pool: int = 8) -> DataFrame:
    """(locus, size, ids, ratio, change, rank): for each locus of ``loci`` (locus,
    signal, wanted: whether its state shall be above the threshold) the ``pool``
    best of the smallest edit sets that bring it there. ``edits``: (locus, id,
    place, ratio); a place is edited once. Loci that have the wanted state as they
    are, and those that ``most_edits`` don't bring there, have no rows.

    Exact for sets of one and two: a set outside of its place's ``pool`` best edits,
    or without one of the 2 * pool best smaller sets, has as many better ones. Of
    larger sets it is a beam search."""
    sign = lambda wanted: F.when(wanted, 1.0).otherwise(-1.0)
    gain = lambda ratio, signal, wanted: F.round((response(ratio, signal) - response(F.lit(1.0), signal)) * sign(wanted), 9)
    start = loci.select("locus", "signal", "wanted").filter(F.col("wanted") != (response(F.lit(1.0), F.col("signal")) > threshold))
    toward = edits.join(start, "locus").filter(F.col("ratio") > 0)
    place = Window.partitionBy("locus", "place").orderBy(F.col("ratio") * sign(F.col("wanted")) * -1, "id")
    fit = checkpointed(toward.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= pool).select("locus", "id", "place", "ratio"))
    kinds = dict(fit.dtypes)
    frontier = start.select("locus", "signal", "wanted", F.array().cast(f"array<{kinds['id']}>").alias("ids"), F.array().cast(f"array<{kinds['place']}>").alias("places"), F.lit(1.0).alias("ratio"))
    found = None
    for size in range(1, most_edits + 1):
        sets = checkpointed(_extended(frontier, fit, gain, size, 2 * pool))
        # gains fall along the ranks, so the sets that arrive come first
        there = sets.filter((response(F.col("ratio"), F.col("signal")) > threshold) == F.col("wanted"))
        hits = there.filter(F.col("rank") <= pool).select("locus", F.lit(size).alias("size"), "ids", "signal", "wanted", "ratio", (F.col("gain") * sign(F.col("wanted"))).alias("change"), "rank")
        found = hits if found is None else found.unionByName(hits)
        frontier = sets.join(there.select("locus").distinct(), "locus", "left_anti")
    return found


def compiled_edits(sets: DataFrame, response: Callable[[Column, Column], Column], threshold: float, draws: int, seed: str, width: float) -> DataFrame:
    """``sets`` with probability, the share of a jittered ensemble in which the
    locus gets the wanted state, and whether it is the locus's best set: the most
    probable, the better ranked of equal ones."""
    named = sets.withColumn("_name", F.concat_ws(":", F.col("locus").cast("string"), F.array_join(F.col("ids").cast("array<string>"), ",")))
    drawn = jittered(named, "_name", draws, seed, width)
    on = (response(F.col("ratio") * F.col("factor"), F.col("signal")) > threshold) == F.col("wanted")
    keys = ["locus", "size", "ids", "ratio", "change", "rank"]
    rated = drawn.groupBy(*keys).agg(F.avg(on.cast("double")).alias("probability"))
    best = F.row_number().over(Window.partitionBy("locus").orderBy(F.desc("probability"), "rank")) == 1
    return rated.withColumn("best", best)


def nearest_products(first: DataFrame, second: DataFrame, k: int, target: float = 1.0) -> DataFrame:
    """(locus, id, other_id, gap, rank): for each row of ``first`` (locus, id,
    ratio) the k of ``second`` (alike, of other ids) whose product with it comes
    nearest to the target; ties by the other's ratio, then id. Ratios that aren't
    above 0 take no part.

    The gap falls and then grows along the other's ratio, so the nearest are among
    the k + 1 values on either side of target / ratio. Values and wanted ratios
    are numbered in one order by a range partition, and meet by number: rows grow
    with the input, whatever a locus holds."""
    ids = Window.partitionBy("locus", "value").orderBy("other_id")
    values = second.filter("ratio > 0").select("locus", F.col("ratio").alias("value"), F.col("id").alias("other_id")).distinct().withColumn("_r", F.row_number().over(ids)).filter(F.col("_r") <= k + 1)
    values = values.groupBy("locus", "value").agg(F.sort_array(F.collect_list("other_id")).alias("others"))
    wanted = first.filter("ratio > 0").select("locus", "ratio").distinct()
    both = values.select("locus", F.col("value").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("n"), "value", "others").unionByName(wanted.select("locus", (F.lit(target) / F.col("ratio")).alias("x"), F.lit(1).alias("kind"), F.lit(0).alias("n"), "ratio"), allowMissingColumns=True)
    placed = checkpointed(running_total(both, ["locus", "x", "kind"], "n", "at"))
    near = placed.filter("kind = 1").select("locus", "ratio", F.explode(F.sequence(F.col("at") - k, F.col("at") + k + 1)).alias("at"))
    met = near.join(placed.filter("kind = 0").select("at", F.col("locus").alias("_locus"), "value", "others"), "at").filter(F.col("locus") == F.col("_locus"))
    pairs = met.select("locus", "ratio", "value", F.explode("others").alias("other_id"), F.abs(F.col("ratio") * F.col("value") - target).alias("gap"))
    order = ["gap", "value", "other_id"]
    few = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("locus", "ratio").orderBy(*order))).filter(F.col("_r") <= k + 1).drop("_r")
    mine = first.select("locus", "id", "ratio").join(few, ["locus", "ratio"]).filter(F.col("id") != F.col("other_id"))
    rank = F.row_number().over(Window.partitionBy("locus", "id").orderBy(*order))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= k).select("locus", "id", "other_id", "gap", "rank")
