"""Compiled collections: variants, dense feature fields, graphs and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import sequence as S
from ..functions.sequence import col


def compile_variants(variants: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """Edits (id, record_id, start, end, ref, alt) against records (record_id,
    sequence): kind, VRS ids, and digests and length of the mutated sequence, in
    one plan. A row with an unknown record, bounds outside of the record, a
    reference that doesn't match, letters beyond IUPAC or equal alleles raises,
    or has its refusal in ``code`` if not strict; so does a repeated id."""
    r = records.select("record_id", F.col("sequence").alias("_s"), I.refget("sequence").alias("refget_id"), I.sha256_hex("sequence").alias("sequence_sha256"))
    n = variants.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    v = variants.join(r, "record_id", "left").join(n, "id", "left")
    size = F.col("end") - F.col("start")
    iupac = lambda c: F.col(c).rlike(f"^[{S.IUPAC}]*$")
    code = F.lit(None).cast("string")
    rules = [
        ("duplicate id", F.col("_n").isNotNull()), ("unknown record", F.col("_s").isNull()), ("bad bounds", (F.col("start") < 0) | (size < 0) | (F.col("end") > F.length("_s"))), ("bad letters", ~(iupac("ref") & iupac("alt"))),
        ("reference length", F.length("ref") != size), ("reference mismatch", F.col("_s").substr(F.col("start") + 1, size) != F.col("ref")), ("identical alleles", F.col("ref") == F.col("alt")),
    ]
    for name, broken in reversed(rules):
        code = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(code)
    mutated = F.concat(F.col("_s").substr(F.lit(1), F.col("start")), F.col("alt"), F.col("_s").substr(F.col("end") + 1, F.length("_s")))
    location = I.vrs_location("refget_id", "start", "end")
    out = v.withColumn("code", code).withColumn("_m", F.when(F.col("code").isNull(), mutated)).select(
        "id", "record_id", "refget_id", "sequence_sha256", F.when(F.col("code").isNull(), S.edit_kind("ref", "alt")).alias("edit_kind"), "start", "end", "ref", "alt", "code",
        location.alias("vrs_location_id"), I.vrs_allele(location, "alt").alias("vrs_allele_id"), F.length("_m").cast("long").alias("mutated_bases"), I.sha256_hex("_m").alias("mutated_sequence_sha256"), I.refget("_m").alias("mutated_refget_id"),
    )
    if not strict:
        return out
    stop = F.raise_error(F.concat(F.lit("variant "), F.coalesce("id", F.lit("?")), F.lit(": "), F.col("code"))).cast("boolean")
    return out.filter(F.when(F.col("code").isNull(), True).otherwise(stop)).drop("code")


def dense_fields(df: DataFrame, unit: str, segments: str) -> DataFrame:
    """One row of numbers for each unit from its array of segments struct(size,
    reverse, kind): how many, least, greatest and total size, whether any is
    reverse, and the mask of kinds."""
    sizes = F.transform(segments, lambda x: x["size"])
    mask = F.aggregate(F.transform(segments, lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["kind"].cast("int"))), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))
    return df.select(unit, F.size(segments).cast("long").alias("intervals"), F.array_min(sizes).alias("low"), F.array_max(sizes).alias("high"), F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.exists(segments, lambda x: x["reverse"]).alias("reverse"), mask.alias("mask"))


def edge_budget(edges: DataFrame, a: str, b: str, first: int, second: int, units) -> DataFrame:
    """One row: edges whose ends lie in bounds, those that don't, and units."""
    inside = (F.col(a) >= 0) & (F.col(a) < first) & (F.col(b) >= 0) & (F.col(b) < second)
    return edges.agg(F.count_if(inside).alias("edges"), F.count_if(~inside).alias("out_of_bounds")).withColumn("units", units)


def repeated_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges given more than once."""
    return edges.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unbound_ports(ports: DataFrame, bindings: DataFrame, port: str, index: str, size: str) -> DataFrame:
    """(port, reason): ports without a binding, bound twice at one index, or at
    an index outside of their size."""
    b = bindings.groupBy(port).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(index).alias("_d"), F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    why = F.when(F.col("_n").isNull(), "unbound").when(F.col("_n") != F.col("_d"), "bound twice").when((F.col("_lo") < 0) | (F.col("_hi") >= F.col(size)), "out of range")
    return ports.join(b, port, "left").withColumn("reason", why).filter("reason is not null").select(port, "reason")


def category(report, flip, floor: float) -> Column:
    """The four cells of a reporter's change and a change of fate."""
    silent = F.abs(col(report)) <= floor
    return F.when(silent & ~col(flip), "doubly_silent").when(silent, "reporter_silent").when(col(flip), "concordant").otherwise("reporter_only")


def paired_counts(df: DataFrame, keys: list[str], dna: str, rna: str) -> DataFrame:
    """Sums of both counts and the rows behind them."""
    return df.groupBy(*keys).agg(F.sum(dna).alias("dna"), F.sum(rna).alias("rna"), F.count(F.lit(1)).alias("support"))


def centred_logs(df: DataFrame, column: str, value: str, name: str = "centred") -> DataFrame:
    """ln of a matrix cell minus the mean over its column."""
    mean = df.groupBy(column).agg(F.avg(F.ln(value)).alias("_m"))
    return df.join(mean, column).withColumn(name, F.ln(value) - F.col("_m")).drop("_m")


def conditional_mean(wanted: DataFrame, rows: DataFrame, column: str, residue: str, value: str) -> DataFrame:
    """wanted with mean: of rows of that column and residue, else of the whole
    column."""
    own = rows.groupBy(column, residue).agg(F.avg(value).alias("_own"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    whole = own.groupBy(column).agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    return wanted.join(own.drop("_s", "_n"), [column, residue], "left").join(whole, column).withColumn("mean", F.coalesce("_own", "_all")).drop("_own", "_all")


def trace_summary(df: DataFrame, trace: str, cell: str, length: str, synapse: Column) -> DataFrame:
    return df.groupBy(trace).agg(F.count_distinct(cell).alias("cells"), F.count(F.lit(1)).alias("segments"), F.sum(length).alias("length"), F.count_if(synapse).alias("synapses"))


def ordered_digest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """SHA-256 of a key's values in order, with bars between."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])
    return df.groupBy(key).agg(F.array_join(v, "|").alias("_j")).select(key, I.sha256_hex("_j").alias("digest"))


def candidate_sort(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.orderBy(*keys)


def pareto_score(error, off, weight: float = 0.05) -> Column:
    return col(error) + weight * col(off)


def ranked(df: DataFrame, order: str, name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``: places from 0 in a total order, without a sort in one
    task. A range partition sorts; partitions are counted, and their offsets (a
    row each) are joined back."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(parts, order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % (1 << 33)).alias("_i"))
    n = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return s.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def site_profile(site, consensus: str, weights: list[list[float]]) -> Column:
    """struct(changed, ratio) of a site with one substitution at most: the place
    from 1 and its weight's ratio; null beyond that. A weight of zero raises, as
    it doesn't establish zero affinity."""
    s = col(site)
    places = [k for k in range(len(consensus))]
    differ = sum(((s.substr(k + 1, 1) != consensus[k]).cast("int") for k in places), F.lit(0))
    changed, ratio = F.lit(None).cast("int"), F.lit(1.0)
    for k in places:
        here = s.substr(k + 1, 1)
        changed = F.when(here != consensus[k], k + 1).otherwise(changed)
        for j, base in enumerate("ACGT"):
            if base != consensus[k]:
                w = F.lit(weights[k][j]) if weights[k][j] else F.raise_error(F.lit("a weight of zero")).cast("double")
                ratio = F.when(here == base, w).otherwise(ratio)
    return F.when((F.length(s) == len(consensus)) & (differ <= 1), F.struct(changed.alias("changed"), ratio.alias("ratio")))


def same_pairs(a, b) -> Column:
    """Whether two strings have the same letter pairs, counted."""
    pairs = lambda s: F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col(s)) - 1, F.lit(1))), lambda i: col(s).substr(i, F.lit(2))))
    return pairs(a) == pairs(b)


def affinity_ratio(reference, variant, floor: float) -> Column:
    """(Z variant + floor) / (Z reference + floor)."""
    return (col(variant) + floor) / (col(reference) + floor)


def chromatin_gate(ratio, gate) -> Column:
    return F.exp(col(gate) * F.ln(col(ratio)))
