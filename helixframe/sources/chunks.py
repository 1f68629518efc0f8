"""References as rows of fixed size, and windows put together from them.

A record's sequence is cut into chunks of ``size`` bases, so no row grows with a
chromosome. A window meets the chunks it touches by their numbers, in an
equi-join; what it gets is two rows for a window no longer than a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import running_total

CHUNK = 1 << 16


def chunked(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """(record_id, chunk, bases) of lines (record_id, place, bases) in the order of
    their places; a line's offset is a running total over a range partition, so no
    record meets in one task. Chunks number from 0; the last may be shorter. Null
    or empty lines have no bases."""
    some = lines.select("record_id", "place", "bases").filter("length(bases) > 0").withColumn("n", F.length("bases").cast("long"))
    placed = running_total(some, ["record_id", "place"], "n", "end")
    start = placed.groupBy("record_id").agg(F.min(F.col("end") - F.col("n")).alias("_start"))
    at = placed.join(start, "record_id").select("record_id", "bases", (F.col("end") - F.col("n") - F.col("_start")).alias("lo"), (F.col("end") - F.col("_start")).alias("hi"))
    number = F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size)))
    parts = at.withColumn("chunk", number).withColumn("from", F.greatest("lo", F.col("chunk") * size))
    piece = F.col("bases").substr((F.col("from") - F.col("lo") + 1).cast("int"), (F.least("hi", (F.col("chunk") + 1) * size) - F.col("from")).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", piece.alias("bases")))), lambda x: x["bases"]), "")
    return parts.groupBy("record_id", "chunk").agg(joined.alias("bases"))


def windows(sites: DataFrame, chunks: DataFrame, before: int, length: int, size: int = CHUNK) -> DataFrame:
    """sites (id, record_id, start, ref, ...) with window, the ``length`` bases that
    begin ``before`` bases ahead of the site, and fault: "no record", "off the end"
    (the window isn't whole) or "reference differs" (ref isn't what stands there);
    then window is null. ids are unique."""
    lo = F.col("start") - before
    touched = F.sequence(F.floor(F.greatest(lo, F.lit(0)) / size), F.floor(F.greatest(lo + length - 1, F.lit(0)) / size))
    met = sites.select("id", "record_id", lo.alias("_lo"), F.explode(touched).alias("chunk")).join(chunks, ["record_id", "chunk"])
    a = F.greatest(F.col("_lo"), F.col("chunk") * size)
    piece = F.col("bases").substr((a - F.col("chunk") * size + 1).cast("int"), F.greatest(F.least(F.col("_lo") + length, (F.col("chunk") + 1) * size) - a, F.lit(0)).cast("int"))
    got = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("bases")))), lambda x: x["bases"]), "").alias("_window"))
    there = chunks.select("record_id").distinct().withColumn("_there", F.lit(True))
    whole = sites.join(got, "id", "left").join(there, "record_id", "left")
    same = F.col("_window").substr(F.lit(before + 1), F.length("ref")) == F.upper("ref")
    fault = F.when(F.col("_there").isNull(), "no record").when((lo < 0) | F.col("_window").isNull() | (F.length("_window") < length), "off the end").when(~same, "reference differs")
    return whole.withColumn("fault", fault).withColumn("window", F.when(F.col("fault").isNull(), F.col("_window"))).drop("_window", "_there")
