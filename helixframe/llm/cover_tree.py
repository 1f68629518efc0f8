"""Embedding near-duplicates by dual traversal of cover trees.

Equal vectors are one point with a weight. The upper levels of a cover tree come
first: of the points of a label that don't fit one block, centres are taken from
a sample, each the farthest from those before, at most LEVEL of them. Every point
falls to the nearest centre's cell, whose true radius is known then, and two cells
only meet if their centres are as near as both radii and the distance that the
least cosine allows; other pairs of cells shuffle nothing. Crowded cells are cut
into blocks of bounded size. Each pair of blocks that meets is one unit of work,
so a label that holds most rows is spread over many tasks. In a unit every block
has a cover tree: nodes cover their points within a radius that halves from level
to level, and a child per centre. Two trees are walked together: with centres d
apart and true covering radii p and q, a pair of nodes has no linked points if
d - p - q is more than the distance that the least cosine allows, and only linked
points if d + p + q is no more. The other pairs go on to their children, and
single points are compared in double precision. A unit tells for each point the
weight of what it links with, and a spanning forest of its links, never all pairs.

Nulls, zero vectors and vectors with null or non-finite components link with
nothing, as do rows with a null label or id; they keep a row (component_id is
their own id). Labels are compared as they are written, whatever their type. Only
vectors of one length are compared. Repeated rows count as vectors each. A cosine
at the bound links. An empty table gives an empty result; other columns are never
looked at. Where all vectors are about equally far from each other no cells can
be told apart, and the work of an exact join is quadratic in a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, connected_components, prepare

FOUND = "id long, other long, weight long"
CELLS = "label string, dim int, cell int, id long, weight long, v array<double>, far double, centre array<double>"
#: Centres of a label; points of a label that they are chosen from.
LEVEL, SAMPLE = 256, 2048
#: Slack of distances that come from products, which lose half the digits near
#: zero; within it, cosines decide.
SLACK = 1e-7
#: Centres whose distances are one product of matrices.
STEP = 256
#: Distances of centres that are held at once.
PAIRS = 1 << 21
#: Pairs of points of two small nodes (32 points each) that are compared at once
#: rather than walked further, and what a product of matrices may be off.
DIRECT, ROUND = 1 << 10, 1e-9


class CoverTree:
    """Nested levels with halving radii over unit vectors. Nodes are numbers;
    ``centre``, ``radius`` (true), ``children`` and ``points`` hold their parts."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.points: list[np.ndarray] = []
        self.root = self._node(0, np.arange(len(x)), self._to(0, np.arange(len(x))), 2.0)

    def _to(self, c: int, points: np.ndarray) -> np.ndarray:
        d = self.x[points] - self.x[c]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _node(self, centre: int, points: np.ndarray, far: np.ndarray, radius: float) -> int:
        while len(points) > 1 and far.max() <= radius / 2 and radius > 1e-6:
            radius /= 2  # a level at which the centre still covers all
        me = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.points.append(points)
        self.children.append(np.zeros(0, np.int64))
        if len(points) > 1 and radius > 1e-6:
            near = far <= radius / 2
            kids, left = [self._node(centre, points[near], far[near], radius / 2)], points[~near]
            while len(left):  # of a few candidates at once each that none before it covers
                some = left[:STEP]
                dist = np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[some] @ self.x[left].T)))
                free = np.ones(len(left), bool)
                for k, c in enumerate(some.tolist()):
                    if free[k]:
                        near = free & (dist[k] <= radius / 2)
                        near[k] = True
                        kids.append(self._node(c, left[near], dist[k][near], radius / 2))
                        free &= ~near
                left = left[free]
            self.children[me] = np.array(kids)
        return me

    def arrays(self) -> None:
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)
        self.single = np.array([len(p) == 1 for p in self.points])
        self.count = np.array([len(p) for p in self.points])
        self.offset = np.cumsum(self.count) - self.count
        self.flat = np.concatenate(self.points)


def _compared(a: CoverTree, b: CoverTree, u: np.ndarray, v: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of the points of nodes u[k] and v[k], of all k at once."""
    n = a.count[u] * b.count[v]
    cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), "right") if len(n) else []
    for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
        x, y, m = u[lo:hi], v[lo:hi], n[lo:hi]
        of = np.repeat(np.arange(len(m)), m)
        k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        i, j = a.flat[a.offset[x][of] + k // b.count[y][of]], b.flat[b.offset[y][of] + k % b.count[y][of]]
        hit = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= cosine
        if same:
            hit &= (i < j) | (x != y)[of]
        yield i[hit], j[hit]


def linked(a: CoverTree, b: CoverTree, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (point of a, point of b) with at least that cosine, each once; if
    the trees are the same, without pairs of a point with itself."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    a.arrays()
    b.arrays()
    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        ps = a.children[p] if len(a.children[p]) else np.array([p])
        qs = b.children[q] if len(b.children[q]) else np.array([q])
        if len(a.points[p]) * len(b.points[q]) <= DIRECT or len(a.children[p]) == 0 and len(b.children[q]) == 0:
            i, j = a.points[p], b.points[q]
            r, c = np.nonzero(a.x[i] @ b.x[j].T >= cosine - ROUND)
            i, j = i[r], j[c]
            # one formula decides, whatever else is in the product
            keep = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= cosine
            if same and p == q:
                keep &= i < j
            yield i[keep], j[keep]
            continue
        high = max(1, PAIRS // len(qs))
        for at in range(0, len(ps), high):  # so many rows of distances at once
            some = ps[at : at + high]
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (a.x[a.centres[some]] @ b.x[b.centres[qs]].T)))
            both = a.radii[some][:, None] + b.radii[qs][None, :]
            near = d - both <= reach + SLACK
            if same and p == q:  # unordered pairs of children
                near &= np.arange(at, at + len(some))[:, None] <= np.arange(len(qs))[None, :]
            r, c = np.nonzero(near)
            inside = (d[r, c] + both[r, c]) <= reach - SLACK
            u, v = some[r], qs[c]
            points = a.single[u] & b.single[v]
            i, j = a.centres[u[points]], b.centres[v[points]]
            if same:
                i, j = i[i != j], j[i != j]
            hit = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= cosine
            yield i[hit], j[hit]
            for k in np.flatnonzero(inside & ~points):
                i, j = a.points[u[k]], b.points[v[k]]
                if same and u[k] == v[k]:
                    x, y = np.triu_indices(len(i), 1)
                    yield i[x], i[y]
                else:
                    yield np.repeat(i, len(j)), np.tile(j, len(i))
            rest = ~inside & ~points
            small = rest & (a.count[u] * b.count[v] <= DIRECT)
            yield from _compared(a, b, u[small], v[small], cosine, same)
            rest &= ~small
            stack.extend(zip(u[rest].tolist(), v[rest].tolist(), strict=True))


def unit_vectors(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spread_centres(x: np.ndarray, count: int) -> np.ndarray:
    """Places of ``count`` rows, the first and then each the farthest from those
    before; fewer if the others equal them."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _groups(group: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    group = group.combine_chunks()
    same = np.ones(max(group.num_rows - 1, 0), bool)
    for c in keys:
        k = group.column(c)
        k = np.array(k.to_pylist(), object) if pa.types.is_string(k.type) else k.to_numpy()
        same &= k[1:] == k[:-1]
    cuts = np.flatnonzero(~same) + 1
    for a, b in zip([0, *cuts], [*cuts, group.num_rows], strict=True):
        yield group.slice(a, b - a)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres of each label out of its sample."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        for rows in _groups(group, ["label", "dim"]):
            x = unit_vectors(rows.column("v"), rows.num_rows)
            some = spread_centres(x, min(LEVEL, rows.column("blocks")[0].as_py()))
            part = rows.take(pa.array(some))
            yield from part.select(["label", "dim", "blocks"]).append_column("cell", pa.array(np.arange(len(some)), pa.int32())).append_column("v", pa.array(list(x[some]), pa.list_(pa.float64()))).combine_chunks().to_batches()

    yield from by_group(batches, ["label", "dim"], work)


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by label, length and salt, centres (point false) before points.
    Each point with the nearest centre, the first of equally near ones."""
    own, parts, centres = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        for rows in _groups(pa.Table.from_batches([batch]), ["label", "dim", "salt", "point"]):
            key = tuple(rows.column(c)[0].as_py() for c in ("label", "dim", "salt"))
            if key != own:
                own, parts, centres = key, [], None
            x = unit_vectors(rows.column("v"), rows.num_rows)
            if not rows.column("point")[0].as_py():
                parts.append((rows.column("cell").to_numpy(), x))
                continue
            if centres is None:
                cells, centres = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = np.argsort(cells)
                centres = centres[order]
            near = (x @ centres.T).argmax(1)
            far = np.sqrt(((x - centres[near]) ** 2).sum(1))
            columns = [rows.column("label"), rows.column("dim"), pa.array(near, pa.int32()), rows.column("id"), rows.column("weight"), rows.column("v"), pa.array(far), pa.array(list(centres[near]), pa.list_(pa.float64()))]
            yield from pa.table(columns, names=["label", "dim", "cell", "id", "weight", "v", "far", "centre"]).combine_chunks().to_batches()


def _unit(rows: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, weight) of a unit: forest links and weights of links."""
    ids = rows.column("id").to_numpy()
    weight = rows.column("weight").to_numpy()
    second = rows.column("second").to_numpy(zero_copy_only=False)
    x = unit_vectors(rows.column("v"), len(ids))
    one = np.flatnonzero(~second)
    two = np.flatnonzero(second)
    same = not len(two)
    if not len(one):
        return ids[:0], ids[:0], weight[:0]
    left = CoverTree(x[one])
    right = left if same else CoverTree(x[two])
    to = one if same else two
    total = np.zeros(len(ids), np.int64)
    label = np.arange(len(ids))
    pairs = []
    for i, j in linked(left, right, cosine, same):
        i, j = one[i], to[j]
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
        if len(i):
            pairs.append((i, j))
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:  # the least place that links reach
            least = np.minimum(label[i], label[j])
            after = label.copy()
            np.minimum.at(after, i, least)
            np.minimum.at(after, j, least)
            after = after[after]
            if (after == label).all():
                break
            label = after
    some = np.flatnonzero(total > 0)
    return ids[some], ids[label[some]], total[some]


def _units(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    keys = ["label", "dim", "lo", "hi"]

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        for rows in _groups(group, keys):
            if rows.column("lo")[0] != rows.column("hi")[0] and len(rows.column("second").unique()) < 2:
                continue
            found = _unit(rows, cosine)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "other", "weight"])

    yield from by_group(batches, keys, work)


def _cells(points: DataFrame, reach: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): points (label, dim, cell, id, weight, v) and the pairs of
    cells (label, dim, a, b, na, nb; a <= b) that may have links, with the blocks
    of both. Labels that fit a block are one cell."""
    size = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).checkpoint()
    one = size.filter("blocks = 1").select("label", "dim")
    rows = points.join(one, ["label", "dim"]).select("label", "dim", F.lit(0).alias("cell"), "id", "weight", "v")
    pairs = one.select("label", "dim", *[F.lit(x).alias(n) for n, x in (("a", 0), ("b", 0), ("na", 1), ("nb", 1))])
    many = size.filter("blocks > 1").select("label", "dim", "blocks")
    if many.isEmpty():
        return rows, pairs
    rest = points.join(many, ["label", "dim"])
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("id"), "id"))
    sample = rest.withColumn("r", rank).filter(f"r <= {SAMPLE}").select("label", "dim", "blocks", "r", "v")
    centres = sample.repartition("label", "dim").sortWithinPartitions("label", "dim", "r").mapInArrow(_chosen, "label string, dim int, blocks int, cell int, v array<double>").checkpoint()
    # every salt of a label gets all of its centres, LEVEL at most
    none = F.lit(None).cast("long")
    first = centres.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(False).alias("point"), "cell", none.alias("id"), none.alias("weight"), "v")
    dealt = first.unionByName(rest.select("label", "dim", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt"), F.lit(True).alias("point"), F.lit(0).alias("cell"), "id", "weight", "v"))
    found = dealt.repartition("label", "dim", "salt").sortWithinPartitions("label", "dim", "salt", "point").mapInArrow(_assigned, CELLS).checkpoint()
    cells = found.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"), F.first("centre").alias("centre"))
    side = lambda k: cells.select("label", "dim", F.col("cell").alias(k), F.col("radius").alias("r" + k), F.col("n").alias("n" + k), F.col("centre").alias("c" + k))
    apart = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = side("a").join(side("b"), ["label", "dim"]).filter("a <= b").filter(apart - F.col("ra") - F.col("rb") <= reach + SLACK)
    return rows.unionByName(found.select(rows.columns)), pairs.unionByName(near.select(pairs.columns))


def valid_vector(c: str) -> F.Column:
    """Not null or empty, all components finite, one not zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(c).isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93, block: int = 8192) -> DataFrame:
    """vec_id, n_links (other vectors of that label with at least that cosine),
    component_id (smallest vec_id that links reach), kept (whether that is the
    row's own). ``block`` bounds the points of a block, about."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("fit", valid_vector("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    fit = rows.filter("fit").select("vec_id", "label", "v")
    points = fit.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("v"))
    # ids may repeat with other vectors: points have names of their own
    points = points.withColumnRenamed("id", "vid").withColumn("id", F.monotonically_increasing_id()).checkpoint()
    cells, pairs = _cells(points, float(np.sqrt(max(0.0, 2 - 2 * cosine))), block)
    pairs = pairs.checkpoint()
    # a point of a pair's first cell goes to its block of that cell against every
    # block of the other; within a cell, to the units of its own block
    sub = lambda c: F.pmod(F.xxhash64("id", "v"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    name = lambda cell, part: F.concat_ws(".", cell, part)
    far = pairs.filter("a <> b")
    to = lambda mine, other: cells.join(far, (cells["label"] == far["label"]) & (cells["dim"] == far["dim"]) & (cells["cell"] == far[mine])).select(cells["label"], cells["dim"], "a", "b", sub("n" + mine).alias("own"), every("n" + other).alias("to"), "id", "weight", "v")
    left = to("a", "b").select("label", "dim", name("a", "own").alias("lo"), name("b", "to").alias("hi"), F.lit(False).alias("second"), "id", "weight", "v")
    right = to("b", "a").select("label", "dim", name("a", "to").alias("lo"), name("b", "own").alias("hi"), F.lit(True).alias("second"), "id", "weight", "v")
    self_ = pairs.filter("a = b").select("label", "dim", F.col("a").alias("cell"), "na")
    own = cells.join(self_, ["label", "dim", "cell"]).withColumn("own", sub("na")).withColumn("to", every("na"))
    own = own.select("label", "dim", name("cell", F.least("own", "to")).alias("lo"), name("cell", F.greatest("own", "to")).alias("hi"), (F.col("own") > F.col("to")).alias("second"), "id", "weight", "v")
    met = own.unionByName(left).unionByName(right)
    found = met.repartition("label", "dim", "lo", "hi").sortWithinPartitions("label", "dim", "lo", "hi").mapInArrow(partial(_units, cosine=cosine), FOUND).checkpoint()
    total = found.groupBy("id").agg(F.sum("weight").alias("linked"))
    vid = lambda k: points.select(F.col("id").alias(k), F.col("vid").alias("v" + k))
    joined = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).join(vid("a"), "a").join(vid("b"), "b"), "va", "vb").withColumnRenamed("id", "vid")
    named = points.join(total, "id", "left").join(joined, "vid", "left").select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "vid").alias("component_id"))
    out = fit.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
