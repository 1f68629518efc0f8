"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-case A-Z alone, as the contracts ask.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: documents may be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"
FILTER_BITS = 1 << 24


def prepare(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, and the folder for checkpoints: the one that
    spark.checkpoint.dir names. Only a session whose tasks run in the driver's
    own process may go without; it gets a folder on its disk."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{os.getcwd()}/spark-warehouse/checkpoints"
        context.setCheckpointDir(folder)
    return spark


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects what referred to them; after a
    large step that was checkpointed that shouldn't wait for a full heap. The
    scheduler forgets a job once another has run, and the thread that tells the
    JVM what Python has dropped looks once a second."""
    spark.range(1).count()
    gc.collect()
    time.sleep(1.1)
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column) -> F.Column:
    return F.translate(column, UPPER, LOWER)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand ``work`` tables of whole groups, from batches sorted by ``keys``.

    Only the group that may go on in the next batch is kept back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        lo, hi = 0, batch.num_rows
        while lo < hi:  # the first row of the last group
            mid = (lo + hi) // 2
            same = all(batch.column(k)[mid] == v for k, v in zip(keys, last, strict=True))
            lo, hi = (lo, mid) if same else (mid + 1, hi)
        if lo == 0 and (len(held) == 1 or all(held[-2].column(k)[held[-2].num_rows - 1] == v for k, v in zip(keys, last, strict=True))):
            continue
        whole = [pa.Table.from_batches([*held[:-1], batch.slice(0, lo)])]
        held = [batch.slice(lo)]
        yield from work(whole.pop())
        pa.default_memory_pool().release_unused()  # freed columns would stay with the worker
    if held:
        whole = [pa.Table.from_batches(held)]
        held.clear()
        yield from work(whole.pop())
        pa.default_memory_pool().release_unused()


def _bits(ids: DataFrame, id_column: str, size: int) -> DataFrame:
    """One bit for each hash value of an id, ``size`` bits whatever the data, in
    bitmaps of 4 KB; so what the driver collects and broadcasts is size / 8 bytes
    in few rows at most."""
    place = ids.select(F.pmod(F.xxhash64(id_column), F.lit(size)).alias("p"))
    return place.groupBy(F.bitmap_bucket_number("p").alias("_word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))


def _marked(df: DataFrame, column: str, ids: DataFrame, id_column: str, size: int, how: str) -> DataFrame:
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(size))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return df.join(F.broadcast(_bits(ids, id_column, size)), F.bitmap_bucket_number(place) == F.col("_word"), how).withColumn("_hit", hit)


def may_contain(df: DataFrame, column: str, ids: DataFrame, id_column: str, size: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose id may be in ids: all that are, and a few others; with
    many more ids than ``size`` bits, most others. Follow it with an inner join:
    the optimizer would put a semi-join in front."""
    return _marked(df, column, ids, id_column, size, "inner").filter("_hit").drop("_word", "_bits", "_hit")


def without(df: DataFrame, column: str, ids: DataFrame, id_column: str, size: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose id isn't in ids (distinct), null ids included, whatever
    df's columns are called. Only rows that may be in ids are shuffled to meet
    them."""
    names = [f"c{k}" for k in range(len(df.columns))]
    key = names[df.columns.index(column)]
    marked = _marked(df.toDF(*names), key, ids, id_column, size, "left")
    there = ids.select(F.col(id_column).alias("_id"), F.lit(True).alias("_there"))
    met = marked.filter("_hit").join(there, F.col(key) == F.col("_id"), "left").filter("_there is null")
    return marked.filter("not _hit").select(names).unionByName(met.select(names)).toDF(*df.columns)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every end of a link; component_id is the smallest
    reachable id. Labels spread along links and jump along pointers, so chains
    shorten by half a round; each round is checkpointed and nothing but one
    count comes to the driver. No links give an empty table."""
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).filter("id <> other")
    edges = both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().checkpoint()
    labels = edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        after = spread.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")).checkpoint()
        labels = after.select("id", "label")
        if after.filter("old <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component_id"))
