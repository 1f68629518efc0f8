"""Readers of tabular inputs with explicit schemas, and strict JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import col


def variants(spark: SparkSession, path: str, format: str) -> DataFrame:
    """(id, reference, sequence) from csv, tsv or json rows that give the
    variant as sequence or variant, or as pos (from 1) and alt."""
    fields = "id string, reference string, sequence string, variant string, pos string, alt string"
    if format == "json":
        raw = spark.read.schema(fields).json(path, multiLine=True)
    elif format in ("csv", "tsv"):
        raw = spark.read.csv(path, header=True, sep="," if format == "csv" else "\t")
        for name in ("sequence", "variant", "pos", "alt"):
            raw = raw if name in raw.columns else raw.withColumn(name, F.lit(None).cast("string"))
    else:
        raise ValueError(f"no format {format!r}")
    edited = F.overlay("reference", "alt", F.col("pos").cast("int"))
    return raw.select("id", F.upper("reference").alias("reference"), F.upper(F.coalesce("sequence", "variant", edited)).alias("sequence"))


def variant_list(spark: SparkSession, path: str) -> DataFrame:
    """Edits of a JSON array, or of an object with member variants."""
    edit = "struct<id:string,record_id:string,start:bigint,end:bigint,ref:string,alt:string>"
    text = spark.read.text(path, wholetext=True)
    one = F.from_json("value", f"array<{edit}>")
    two = F.from_json("value", f"struct<variants:array<{edit}>>")["variants"]
    rows = text.select(F.explode(F.when(F.ltrim("value").startswith("["), one).otherwise(two)).alias("v"))
    return rows.select("v.*")


def count_matrix(spark: SparkSession, path: str, id_column: str, value: str) -> DataFrame:
    """A wide tab-separated matrix of whole numbers as (id, sample, value);
    sample columns may number thousands, so they unpivot in one projection."""
    wide = spark.read.csv(path, header=True, sep="\t")
    samples = [c for c in wide.columns if c != id_column]
    bad = F.raise_error(F.concat(F.lit("not a whole number: "), F.col(value)))
    long = wide.unpivot(id_column, samples, "sample", value)
    checked = F.when(F.col(value).rlike(r"^\d+$"), F.col(value)).otherwise(bad).cast("long")
    return long.withColumn(value, checked)


def assay_rows(spark: SparkSession, activity: str, design: str, times: int = 7) -> DataFrame:
    """(id, sequence, values) of a CSV (plain or gzip) with an id and ``times``
    columns, joined with the designs of a FASTA file by id. Ids that designs give
    several sequences are left out; an activity without a design raises."""
    from ..operators.assays import unambiguous
    from ..operators.joins import strict_join
    from . import formats

    raw = spark.read.csv(activity, header=True)
    names = raw.columns[1 : times + 1]
    values = raw.select(F.col(raw.columns[0]).alias("id"), F.array(*[F.col(c).cast("double") for c in names]).alias("values"))
    designs = formats.read(spark, "fasta", design).select(F.col("record_id").alias("id"), "sequence")
    return strict_join(values, unambiguous(designs, "id", "sequence").distinct(), ["id"])


def sample_coordinates(df: DataFrame, name: str = "sample") -> DataFrame:
    """replicate, hour and barcode from names like rep2_h12_bc7."""
    part = lambda p: F.regexp_extract(name, p, 1).cast("int")
    return df.withColumns({"replicate": part(r"rep(\d+)"), "hour": part(r"h(\d+)"), "barcode": part(r"bc(\d+)")})


def paired_counts(dna: DataFrame, rna: DataFrame, keys: list[str]) -> DataFrame:
    """DNA and RNA counts of equal slots; a slot that one side lacks raises."""
    both = dna.join(rna, keys, "full")
    whole = F.col("dna").isNotNull() & F.col("rna").isNotNull()
    return both.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("slots of DNA and RNA differ")).cast("boolean")))


def gtf_tss(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chrom, tss, strand) of a GTF's gene rows."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, source string, type string, start long, end long, score string, strand string, phase string, attributes string", quote="")
    gene = F.split(F.regexp_extract("attributes", 'gene_id "([^"]+)"', 1), r"\.")[0]
    return raw.filter("type = 'gene'").select(gene.alias("gene"), "chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("tss"), "strand")


def narrow_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, signal) of narrowPeak rows, from 0, end excluded."""
    fields = "chrom string, start long, end long, name string, score int, strand string, signal double, p double, q double, summit int"
    return spark.read.csv(path, sep="\t", schema=fields).select("chrom", "start", "end", "signal")


def credible_rows(spark: SparkSession, path: str, least: float) -> DataFrame:
    """SNVs with at least that posterior from a table with variant
    (chrom_pos_ref_alt), gene_id and pip."""
    raw = spark.read.csv(path, header=True, sep="\t")
    p = F.split("variant", "_")
    return raw.select(p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[2].alias("ref"), p[3].alias("alt"), F.split("gene_id", r"\.")[0].alias("gene"), F.col("pip").cast("double").alias("pip")).filter((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("pip") >= least))


def motif_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(motif, pos, base, weight) of JASPAR texts: log odds of counts plus 0.25
    pseudocounts against equal bases."""
    text = spark.read.text(path, wholetext=True)
    block = text.select(F.explode(F.expr(r"regexp_extract_all(value, '(>[^>]+)', 1)")).alias("b"))
    base = block.select(F.regexp_extract("b", r">(\S+)", 1).alias("motif"), F.explode(F.expr(r"regexp_extract_all(b, '([ACGT]\\s*\\[[^\\]]+\\])', 1)")).alias("r"))
    cell = base.select("motif", F.substring("r", 1, 1).alias("base"), F.posexplode(F.expr(r"regexp_extract_all(r, '([0-9.]+)', 1)")).alias("pos", "n"))
    cell = cell.withColumn("n", F.col("n").cast("double"))
    total = cell.groupBy("motif", "pos").agg(F.sum("n").alias("t"))
    return cell.join(total, ["motif", "pos"]).select("motif", "pos", "base", F.ln((F.col("n") + 0.25) / (F.col("t") + 1.0) / 0.25).alias("weight"))


def repeated_keys(text) -> Column:
    """Whether a JSON object has a key twice (null if it is no object)."""
    k = F.json_object_keys(col(text))
    return F.size(k) != F.size(F.array_distinct(k))


def closed_schema(text, names: list[str]) -> Column:
    """Whether a JSON object has exactly these members, each once."""
    k = F.json_object_keys(col(text))
    return F.coalesce(F.array_sort(k) == F.array_sort(F.array(*map(F.lit, names))), F.lit(False))
