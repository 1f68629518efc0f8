"""Conversation turns put in order again by a stateful stream.

Each conversation is a key of ``transformWithState``. Its state is a map of the
turns kept so far, one row of counters and a tombstone. The event time is
synthetic: batch b happens at a whole number of seconds, so the watermark counts
batches. Every arrival deletes the conversation's timer and registers it anew,
``idle`` batches after itself; when it expires, the conversation closes, its map
goes and the tombstone stays, which rejects whatever comes later. Each batch
carries a row of no conversation besides, so that time goes on without arrivals.

A turn's first arrival is kept with its role; later ones only keep the
conversation open. After each batch the gapless run of kept turns from the
conversation's first turn is released, each turn once; a released turn's text
leaves the state, its role stays for the count of breaks.

Nulls: rows without a turn are dropped, a null role or text is empty, rows with a
null conv_id are one conversation. Texts are kept whole, however long. Ties: of a
turn's arrivals in one batch only the smallest payload (UTF-8 bytes) arrives, of
equal payloads that of the smallest role; repeated rows are such ties. An empty
table gives an empty result. Other columns are never looked at.

What meets in one task is one conversation: its turns of one batch, as rows of
their own that stream past the state. Nothing else is gathered, in tasks or in
the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import prepare

#: Seconds of batch 0: not the epoch, from which an unset watermark starts.
ORIGIN = 86_400
ARRIVAL = "conv_id long, turn long, first long, role string, text string, batch int"
EVENT = "event string, conv_id long, turn long, batch long, role string, text string, unreleased array<long>, n_missing long, n_breaks long"
#: What such a query needs: keyed timers live in RocksDB, whose commits write what
#: has changed and not the whole state. Many small stores don't preallocate files.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A checkpoint's number of state partitions never changes, so it follows the
#: data and not what the session happens to shuffle with.
PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"


class Reassembly(StatefulProcessor):
    """The state and the timer of one conversation."""

    def __init__(self, idle: int, end: int):
        self.idle, self.end = idle, end

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "turn long", "role string, text string")
        #: next: the turn to release; top: the largest kept; n: how many are kept.
        self.open = handle.getValueState("open", "first long, next long, top long, n long, last int")
        self.tombstone = handle.getValueState("tombstone", "batch int")

    def _timer(self, last: int) -> int:
        """Half a second early: due once the watermark is at last + idle, not before."""
        return (ORIGIN + last + self.idle) * 1000 - 500

    def _close(self, conv: int | None, seen: tuple) -> Row:
        first, following, top, n, last = seen
        roles = {key[0]: value[0] for key, value in self.kept.iterator()}
        batch = min(last + self.idle, self.end)
        self.kept.clear()
        self.open.clear()
        self.tombstone.update((batch,))
        breaks = sum(roles.get(t - 1) == role for t, role in roles.items())
        return Row(event="close", conv_id=conv, turn=-1, batch=batch, role=None, text=None, unreleased=sorted(t for t in roles if t >= following), n_missing=top - first + 1 - n, n_breaks=breaks)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv, seen, before, looked = key[0], None, None, False
        for r in rows:
            if r.turn is None:  # the row that only tells the time
                continue
            if not looked:
                looked = True
                closed = self.tombstone.exists()
                seen = None if closed else self.open.get()
                before = seen and seen[4]
                if seen and before + self.idle < r.batch:  # its timer is still to come
                    self.handle.deleteTimer(self._timer(before))
                    yield self._close(conv, seen)
                    seen, before, closed = None, None, True
            if closed:
                yield Row(event="reject", conv_id=conv, turn=r.turn, batch=r.batch, role=r.role, text=r.text, unreleased=None, n_missing=None, n_breaks=None)
                continue
            first, following, top, n, _ = seen or (r.first, r.first, r.first, 0, 0)
            if not self.kept.containsKey((r.turn,)):
                self.kept.updateValue((r.turn,), (r.role, r.text))
                top, n = max(top, r.turn), n + 1
            seen = (first, following, top, n, r.batch)
        if seen:
            first, following, top, n, last = seen
            while following <= top and (held := self.kept.getValue((following,))) is not None:
                yield Row(event="release", conv_id=conv, turn=following, batch=last, role=held[0], text=held[1], unreleased=None, n_missing=None, n_breaks=None)
                self.kept.updateValue((following,), (held[0], None))
                following += 1
            self.open.update((first, following, top, n, last))
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.open.get()
        if seen:
            yield self._close(key[0], seen)

    def close(self) -> None:
        pass


def events(arrivals: DataFrame, idle: int, end: int) -> DataFrame:
    """Releases, rejections and closures of a stream of ARRIVAL rows, of which
    the batches come in order. ``end``: the batch as which conversations close
    that the end of the stream closes."""
    timed = arrivals.withColumn("at", F.timestamp_seconds(F.lit(ORIGIN) + F.col("batch"))).withWatermark("at", "0 seconds")
    return timed.groupBy("conv_id").transformWithState(Reassembly(idle, end), EVENT, "append", "eventTime")


def arrivals(conversations: DataFrame, batches: int = 12, copies_of: int = 7, copies: int = 2, later: int = 3) -> DataFrame:
    """When each turn arrives: in the batch that a hash of its conversation and
    number names, and for ``copies`` of ``copies_of`` hashes once more, as the
    user's, ``later`` batches on."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.filter("turn is not null")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    hashed = turns.withColumn("h", F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long"))
    own = F.array(F.struct("role", (F.col("h") % batches).cast("int").alias("batch")))
    again = F.array(F.struct(F.lit("user").alias("role"), ((F.col("h") + later) % batches).cast("int").alias("batch")))
    sent = hashed.select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % copies_of < copies, F.concat(own, again)).otherwise(own)).alias("sent"))
    payload = F.struct(F.concat("sent.role", F.lit("|"), "text").alias("payload"), F.col("sent.role").alias("role"))
    least = sent.groupBy("conv_id", "turn", F.col("sent.batch").alias("batch")).agg(F.min(payload).alias("least"))
    first = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("turn").alias("first"))
    text = F.expr("substring(least.payload, length(least.role) + 2)")
    return least.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "turn", "first", F.col("least.role").alias("role"), text.alias("text"), "batch")


def replay(conversations: DataFrame, batches: int = 12, idle: int = 3, partitions: int | None = None) -> DataFrame:
    """EVENT rows of ``conversations`` arriving in so many batches. Each batch is
    a folder below spark.checkpoint.dir that moves to where the stream looks;
    the query starts anew for each of them on one checkpoint, and once more for
    the end. The state has so many ``partitions``: as many as the table, if not
    said, but 8 at least and 4096 at most."""
    spark = prepare(conversations.sparkSession)
    store = STORE | {PARTITIONS: str(partitions or min(4096, max(8, conversations.rdd.getNumPartitions())))}
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/turns-{uuid.uuid4().hex}"
    clock = spark.range(batches + 1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("first", "long"), ("role", "string"), ("text", "string"))], F.when(F.col("id") == batches, batches + idle).otherwise(F.col("id")).cast("int").alias("batch"), F.col("id").cast("int").alias("part"))
    arrivals(conversations, batches).withColumn("part", F.col("batch")).unionByName(clock).write.partitionBy("part").parquet(f"{folder}/batches")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{folder}/arrived"))
    before = {k: spark.conf.get(k, None) for k in store}
    for k, v in store.items():
        spark.conf.set(k, v)
    try:
        for part in range(batches + 1):
            files.rename(path(f"{folder}/batches/part={part}"), path(f"{folder}/arrived/{part:05d}"))
            _feed(spark, folder, idle, batches)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(EVENT).parquet(f"{folder}/events")


def _feed(spark: SparkSession, folder: str, idle: int, end: int) -> None:
    stream = spark.readStream.schema(ARRIVAL).option("recursiveFileLookup", "true").parquet(f"{folder}/arrived")
    query = events(stream, idle, end).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/events")
    query.awaitTermination()


def event_digests(found: DataFrame) -> DataFrame:
    """EVENT rows with sha256 of the payload (closures: of the unreleased kept
    turns' numbers) instead of texts."""
    payload = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return found.select("event", "conv_id", "turn", "batch", F.sha2(payload, 256).alias("sha256"), "n_missing", "n_breaks")
