"""Range, overlap and nearest joins on binned keys, and graph reachability.

A bin key turns a range condition into an equi-join: rows of one side go to
their own bin, rows of the other to all bins that they can reach. Bins as wide
as the window bound that to three. Skewed bins are split by adaptive execution,
which a nested loop never is."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block that are compared with a block of values at once.
PAIRED = 512
#: Letters that a product of matrices tells apart.
LETTERS = 8


def _bin(c: Column, width: float) -> Column:
    return F.floor(c / width)


def _near(right: DataFrame, keys: list[str], value: str, window: float) -> DataFrame:
    b = _bin(F.col(value), window)
    return right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(value).alias("_r_value"), F.explode(F.array(b - 1, b, b + 1)).alias("_bin"))


def within(left: DataFrame, right: DataFrame, keys: list[str], value: str, window: float, how: str = "left_semi") -> DataFrame:
    """Rows of left with (left_semi) or without (left_anti) a row of right of
    equal keys whose value is at most window away, both ends included. Null
    values have no neighbours."""
    l = left.withColumn("_bin", _bin(F.col(value), window))
    r = _near(right, keys, value, window).distinct()
    on = (l["_bin"] == r["_bin"]) & (F.abs(l[value] - r["_r_value"]) <= window)
    for k in keys:
        on &= l[k] == r[f"_r_{k}"]
    return l.join(r, on, how).drop("_bin")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: float, suffix: str = "_r") -> DataFrame:
    """Pairs of half-open intervals of equal keys that share a point. Intervals
    go to each bin that they touch; a pair counts in the bin where the later of
    the two starts, so it is found once."""
    spread = lambda d: d.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1e-9, width))))
    l = spread(left)
    r = spread(right)
    r = r.select(*[F.col(c).alias(c if c in (*keys, "_bin") else c + suffix) for c in r.columns])
    first = F.greatest(F.col(start), F.col(start + suffix))
    return l.join(r, [*keys, "_bin"]).filter((F.col(start) < F.col(end + suffix)) & (F.col(start + suffix) < F.col(end)) & (_bin(first, width) == F.col("_bin"))).drop("_bin")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, value: str, width: float) -> DataFrame:
    """points with max_value, the greatest value of the intervals that hold the
    point (start included, end not); null outside of all. Null columns and equal
    points keep their rows."""
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1e-9, width))))
    p = checkpointed(points.withColumn("_row", F.monotonically_increasing_id()))
    hit = p.withColumn("_bin", _bin(F.col(at), width)).join(spread.select(*keys, "_bin", F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v")), [*keys, "_bin"]).filter((F.col("_s") <= F.col(at)) & (F.col(at) < F.col("_e")))
    # points of no interval go round the shuffle; of the others the columns are carried
    best = hit.groupBy("_row").agg(F.max("_v").alias("max_value"))
    return p.join(best, "_row", "left").drop("_row")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """left with prev_value and next_value: of right's last row at or before,
    and first at or after, in that order. One sort of the union, no pairs."""
    union = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True)).unionByName(
        right.select(*keys, order, F.col(value).alias("_v")).withColumn("_left", F.lit(False)), allowMissingColumns=True
    )
    back = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rangeBetween(0, Window.unboundedFollowing)
    out = union.withColumn("prev_value", F.last("_v", True).over(back)).withColumn("next_value", F.first("_v", True).over(ahead))
    return out.filter("_left").drop("_left", "_v")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises when a row of left has no partner."""
    r = right.withColumn("_there", F.lit(True))
    out = left.join(r, keys, "left")
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return out.filter(F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("no partner for "), key)).cast("boolean"))).drop("_there")


def same_sets(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """Groups of left and right with exactly the same members, counted."""
    key = lambda d, n: d.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members")).withColumnRenamed(group, n)
    return key(left, "left_group").join(key(right, "right_group"), "members")


def _letters(values: list[str]) -> np.ndarray:
    """A row of code points for each of equally long strings."""
    return np.array(values, f"<U{len(values[0])}").view("<u4").reshape(len(values), -1) if values[0] else np.zeros((len(values), 0), np.uint32)


def _least_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block of queries (_q: id, value) and one of values (_r: value, id if
    all its rows have one), each query's nearest values. Equal letters are counted
    as products of matrices, a few letters at a time, so counts are exact."""
    for batch in batches:
        for queries, values in zip(batch.column("_q"), batch.column("_r"), strict=True):
            q, r = queries.as_py(), values.as_py()
            by_size = [{}, {}]
            for found, rows in zip(by_size, (q, r), strict=True):
                for k, x in enumerate(rows):
                    found.setdefault(len(x["v"]), []).append(k)
            for size in by_size[0].keys() & by_size[1].keys():
                mine, other = (f[size] for f in by_size)
                y = _letters([r[k]["v"] for k in other])
                holders: dict = {}
                for at, k in enumerate(other):
                    holders.setdefault(r[k]["i"], []).append(at)
                for lo in range(0, len(mine), PAIRED):
                    some = mine[lo : lo + PAIRED]
                    x = _letters([q[k]["v"] for k in some])
                    alike = np.zeros((len(some), len(other)), np.float32)
                    both = np.intersect1d(x, y)
                    for few in (both[k : k + LETTERS] for k in range(0, len(both), LETTERS)):
                        one, two = (np.concatenate([z == letter for letter in few], 1).astype(np.float32) for z in (x, y))
                        alike += one @ two.T
                    alike[alike == size] = -1  # the same value
                    for at, k in enumerate(some):  # values that only rows of the query's id have
                        if q[k]["i"] in holders:
                            alike[at, holders[q[k]["i"]]] = -1
                    most = alike.max(1)
                    a, b = np.nonzero((alike == most[:, None]) & (most[:, None] >= 0))
                    columns = [pa.array([q[some[k]][c] for k in a]) for c in "iv"], [pa.array([r[other[k]]["v"] for k in b], pa.string()), pa.array((size - most[a]).astype(np.int32))]
                    if len(a):
                        schema = batch.schema.field("_q").type.value_type
                        yield pa.RecordBatch.from_arrays([columns[0][0].cast(schema.field("i").type), columns[0][1].cast(pa.string()), *columns[1]], ["_i", "_v", "_w", "distance"])


def nearest_hamming(queries: DataFrame, rows: DataFrame, id_: str, value: str, block: int = 1024, values: int = 1 << 14) -> DataFrame:
    """(id, other, distance) of each query's nearest rows of another value and
    id, all of them on ties; nulls and values of other lengths have no distance.
    Blocks of ``block`` queries meet blocks of ``values`` distinct values, a row
    of a join each, and of each pair of blocks only the nearest are shuffled."""
    kind = rows.schema[id_].dataType.simpleString()
    some = checkpointed(queries.select(id_, value).dropna().distinct())
    every = checkpointed(rows.select(id_, value).dropna())
    once = checkpointed(every.groupBy(F.col(value).alias("v")).agg(F.when(F.min(id_) == F.max(id_), F.min(id_)).alias("i")))

    def blocked(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64("v"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct("i", "v")).alias(name)), n

    q, parts = blocked(some.select(F.col(id_).alias("i"), F.col(value).alias("v")), block, "_q")
    r, n = blocked(once, values, "_r")
    # each block of values gets the queries; blocks of queries are the smaller
    spread = q.withColumn("_r_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    meets = spread.repartition(max(1, min(n * parts, 4 * rows.sparkSession.sparkContext.defaultParallelism)), "_r_block", "_q_block").join(r.hint("shuffle_hash"), "_r_block")
    pairs = meets.select("_q", "_r").mapInArrow(_least_distances, f"_i {kind}, _v string, _w string, distance int")
    least = pairs.withColumn("_least", F.min("distance").over(Window.partitionBy("_i", "_v"))).filter("distance = _least").drop("_least")
    found = checkpointed(least.select(F.col("_i").alias(id_), F.col("_w").alias(value), "distance"))
    return found.join(every.withColumnRenamed(id_, "other"), value).filter(F.col(id_) != F.col("other")).select(id_, "other", "distance")


def _shared_folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names; only a session whose tasks run
    in the driver's process may go without."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{os.getcwd()}/spark-warehouse/checkpoints"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names."""
    _shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut, as compressed columns in the same folder: a tenth
    of a checkpoint's bytes. ``discard`` takes it away."""
    folder = f"{_shared_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote of frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(df: DataFrame, *keys: str, rows: int = 1 << 20) -> DataFrame:
    """A stored df dealt by keys to partitions of about ``rows`` rows, so a task's
    memory doesn't grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, family): family is the least node that edges reach. Labels spread
    along edges and jump along pointers until none changes."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node is not null and other is not null")
    once = stored(one)  # repeated edges may come; they are dropped in parts of bounded rows
    way = in_parts(once, "node", "other").distinct()
    both = stored(way.unionByName(way.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    discard(once)
    parts = lambda df, key: in_parts(df, key)
    labels = stored(parts(both, "node").groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("family")))
    while True:
        near = parts(both, "other").join(parts(labels, "node").withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("family").alias("near"))
        spread = parts(labels, "node").join(near, "node").select("node", F.col("family").alias("old"), F.least("family", "near").alias("family"))
        up = labels.select(F.col("node").alias("family"), F.col("family").alias("up"))
        after = stored(spread.join(up, "family", "left").select("node", "old", F.least("family", F.coalesce("up", "family")).alias("family")))
        discard(labels)
        labels = after
        if after.filter("old <> family").isEmpty():
            discard(both)
            return labels.select("node", "family")


def hops(edges: DataFrame, source, a: str, b: str) -> DataFrame:
    """(node, hops) of nodes reachable along undirected edges from a source."""
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = checkpointed(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    seen = checkpointed(both.select(F.lit(source).cast(both.schema["x"].dataType).alias("node"), F.lit(0).alias("hops")).limit(1))
    front, k = seen, 0
    while not front.isEmpty():
        k += 1
        front = checkpointed(front.join(both, front["node"] == both["x"]).select(F.col("y").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = checkpointed(seen.unionByName(front))
    return seen


def has_cycle(edges: DataFrame, child: str, parent: str) -> bool:
    """Whether directed edges close a circle: leaves go until none is left."""
    left = checkpointed(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct())
    while True:
        kept = checkpointed(left.join(left.select(F.col("c").alias("p")).distinct(), "p", "left_semi"))
        if kept.isEmpty():
            return False
        if kept.count() == left.count():
            return True
        left = kept
