"""Reference catalogs of FASTA files of any size, without their sequences.

Spark splits the text; each split counts its headers, the counts of the splits
before number its records, and the lines of a record meet in order in one
stream, where digests go line by line. So a record is never held, a file is
read by many tasks, and a record that spans splits is whole."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import FormatError

CATALOG = "path string, ordinal long, record_id string, bases long, gc long, ambiguous long, masked long, sha256 string, refget string"
_BASES = re.compile("[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, block, place, value): lines with their record's number
    (-1 before the first header), in file order by (block, place)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = raw.withColumn("place", F.monotonically_increasing_id())
    here = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("value").startswith(">").cast("long")
    counted = lines.groupBy("path", "block").agg(F.sum(head).alias("_n"))
    # a row for each split
    before = counted.withColumn("_b", F.sum("_n").over(Window.partitionBy("path").orderBy("block")) - F.col("_n")).drop("_n")
    return lines.withColumn("_k", F.sum(head).over(here)).join(before, ["path", "block"]).select("path", (F.col("_b") + F.col("_k") - 1).alias("ordinal"), "block", "place", "value")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CATALOG.split(", ")]
    key, state, out = None, None, []

    def closed() -> tuple:
        path, ordinal, name, n, gc, odd, low, short, long = state
        if not n:
            raise FormatError(f"{path}: no bases in {name}")
        return path, ordinal, name, n, gc, odd, low, short.hexdigest(), "SQ." + base64.urlsafe_b64encode(long.digest()[:24]).decode()

    for batch in batches:
        for path, ordinal, value in zip(*(batch.column(c).to_pylist() for c in ("path", "ordinal", "value")), strict=True):
            line = value.rstrip("\r")
            if (path, ordinal) != key:
                if state:
                    out.append(closed())
                key = (path, ordinal)
                name = line[1:].split()
                if ordinal < 0 or not name:
                    raise FormatError(f"{path}: letters before a header, or a header without a name")
                state = [path, ordinal, name[0], 0, 0, 0, 0, hashlib.sha256(), hashlib.sha512()]
                continue
            if not _BASES.fullmatch(line):
                raise FormatError(f"{path}: letters beyond IUPAC in {state[2]}")
            upper = line.upper()
            state[3] += len(line)
            state[4] += upper.count("G") + upper.count("C")
            state[5] += len(line) - sum(map(upper.count, "ACGT"))
            state[6] += sum(map(str.islower, line)) if upper != line else 0
            state[7].update(upper.encode())
            state[8].update(upper.encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
            out = []
    if state:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])


def reference_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: id, bases, counts and digests. Blank lines count
    nothing; a record without bases, and an id that a file repeats, raise."""
    lines = numbered_lines(spark, path).filter("trim(value) <> ''")
    found = lines.repartition("path", "ordinal").sortWithinPartitions("path", "ordinal", "block", "place").select("path", "ordinal", "value").mapInArrow(_digests, CATALOG)
    again = F.count(F.lit(1)).over(Window.partitionBy("path", "record_id"))
    stop = F.raise_error(F.concat(F.lit("record id given twice: "), F.col("record_id"))).cast("boolean")
    return found.withColumn("_n", again).filter(F.when(F.col("_n") == 1, True).otherwise(stop)).drop("_n")
