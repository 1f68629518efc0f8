"""N-gram Jaccard join by PartEnum signatures.

Sets of size s fall in bands whose upper ends grow by the factor 1/threshold,
so linked sets lie in one band or in two neighbours. Under the tag of a band
with upper end u, linked sets differ in at most k = (1-t)/(1+t) * 2u elements.
The feature domain is cut into n1 partitions and each of those into n2 cells;
n1 * (k2 + 1) is more than k, so some partition has at most k2 differing cells,
and one subset of n2 - k2 of its cells agrees. Each subset's content is a
signature. Of SCHEMES a band takes the one whose signatures cover most and
number at most BUDGET; the last one, of single cells, is for large sets.

Signatures find partners in three steps, none of which compares all members of
a group. First, linked sets share a known number of signatures (``agreeing``),
so a set stays only if so many of its own are shared with any other set: a
count, which groups of any size meet as sums. A set may leave out signatures of
empty cells, which say nothing, as far as that number allows. Second, the sets
that stay are cut into FINE * k + 1 cells, of which linked sets differ in k at
most. Rarest first, the k + 1 foremost cells of both have one in common; only
these make edges, from each set to the least one of a cell's group. Third, what
edges connect is a cluster. A cluster is one unit of work, in which exact
intersections are counted by products of matrices; a larger one than UNIT
elements is compared with its hubs first, and only the sets outside its largest
component meet the others, block by block. So no link is lost.

Nulls: a null text is empty; a null id takes no part and gets no component.
Empty sets link with nothing. Documents are their ids: repeated rows each give
a row, and texts that share an id share its component. Texts are taken whole,
however long. A set is named by 127 bits. An empty table gives an empty result.
Columns besides id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import by_group, connected_components, may_contain, prepare, release, without

_U = np.uint64
#: (n2, k2): cells of a partition, and how many of them a subset lacks.
SCHEMES = ((6, 3), (4, 2), (2, 1))
#: Signatures of a set under one tag that schemes before the last may take.
BUDGET = 64
#: Cells of the second cut for each element that linked sets may differ in.
FINE = 2
#: Signatures that a task holds to see which of them it has twice; signatures of
#: a bucket, which a task holds some twelve times over, at 8 bytes, to count them.
CHUNK, BUCKET = 1 << 19, 1 << 19
#: Elements of the sets of a unit of work, or of a block of a larger cluster.
UNIT = 1 << 20
#: Elements that more sets have, and one in SHARE of a unit's, are counted by
#: products of matrices; a set counts as LEAST elements at least.
COMMON, SHARE, LEAST = 48, 16, 64
ROWS = "doc_id long, n_shingles long, key long, key2 long"
SETS = "key long, key2 long, n int, items array<long>"


def bands(limit: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands up to beyond ``limit``."""
    ends = [1]
    while ends[-1] < limit or len(ends) < 2:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return np.array(ends, np.int64)


@lru_cache(1 << 16)
def scheme(most: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, agreeing) for sets that differ in at most ``most`` elements;
    agreeing: the signatures that they share at least. That is least when the
    differing cells are spread evenly, as the subsets left are convex in them."""
    if most <= 0:
        return 0, 2, 1, 0
    for n2, k2 in SCHEMES:
        spare = max(1, most // 8) if (n2, k2) == SCHEMES[-1] else 1
        n1 = -(-(most + 1) // (k2 + 1)) + spare
        if n1 * comb(n2, k2) <= BUDGET:
            break
    each, more = divmod(most, n1)
    left = lambda gone: comb(n2 - gone, n2 - k2) if gone <= k2 else 0
    return n1, n2, k2, (n1 - more) * left(each) + more * left(each + 1)


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each set: 63 bits, then 64; the first one's low bit is 0."""
    out = np.zeros((2, len(sets)), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        items = np.concatenate(sets)
        start = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[k, some] = np.add.reduceat(tk.mix(items ^ _U(salt)), start)
    names = tk.mix(out + sizes.astype(np.uint64))
    return (names[0] & ~_U(1)).view(np.int64), names[1].view(np.int64)


@dataclass
class Cells:
    """Sets cut under one tag: set k has the cells base[k]..base[k + 1]; linked
    sets differ in ``most`` at most."""

    tag: np.ndarray
    most: np.ndarray
    base: np.ndarray
    content: np.ndarray
    empty: np.ndarray


def cut(sets: list[np.ndarray], percent: int, step: int, fine: int = 0) -> Cells:
    """Contents of the cells under the tag of each set's own band (step 0) or of
    the next one: those of its scheme, or ``fine`` for each element that linked
    sets may differ in, and one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = bands(int(sizes.max(initial=1)), percent)
    tag = np.searchsorted(ends, sizes) + step
    most = np.where(sizes > 0, 2 * ends[tag] * (100 - percent) // (100 + percent), 0)
    if fine:
        cells = np.where(most > 0, fine * most + 1, 0)
    else:
        kinds, of = np.unique(most, return_inverse=True)
        cells = np.array([s[0] * s[1] for s in map(scheme, kinds.tolist())], np.int64)[of]
    base = np.concatenate([[0], np.cumsum(cells)])
    items = np.concatenate([np.zeros(0, np.uint64), *sets])
    whose = np.repeat(np.arange(len(sets)), sizes)
    use = cells[whose] > 0
    own, items = whose[use], items[use]
    place = base[own] + (tk.mix(items ^ tk.mix(tag[own].astype(np.uint64))) % cells[own].astype(np.uint64)).astype(np.int64)
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, place, tk.mix(items + _U(0x2545F4914F6CDD1D)))
    return Cells(tag, most, base, tk.mix(total), total == 0)


def cell_names(c: Cells) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of every single cell."""
    of = np.repeat(np.arange(len(c.tag)), np.diff(c.base))
    name = tk.mix(c.tag[of].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (np.arange(len(of)) - c.base[of]).astype(np.uint64))
    return of, tk.mix(c.content * _U(3) + name)


def tagged(sets: list[np.ndarray], percent: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, signature) under one tag, and of each set how many of
    its signatures a linked set has at least."""
    c = cut(sets, percent, step)
    plans = np.array([scheme(m) for m in c.most.tolist()], np.int64).reshape(-1, 4)
    room = np.maximum(0, (plans[:, 3] - 1) // 2)
    found, blank = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], np.zeros(len(sets), np.int64)
    left = np.zeros(len(sets), np.int64)
    for n2, k2 in SCHEMES:
        some = np.flatnonzero((plans[:, 1] == n2) & (plans[:, 0] > 0))
        if not len(some):
            continue
        n1 = plans[some, 0]
        parts = np.repeat(some, n1)
        nth = np.arange(len(parts)) - np.repeat(np.cumsum(n1) - n1, n1)
        cells = (c.base[parts] + nth * n2)[:, None] + np.arange(n2)
        content, empty = c.content[cells], c.empty[cells]
        name = tk.mix(c.tag[parts].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * _U(0xD1342543DE82EF95) + _U(n2))
        of, sig, void = [], [], []
        for j, subset in enumerate(combinations(range(n2), n2 - k2)):
            h = name + _U(j)
            for x in subset:
                h = tk.mix(h * _U(3) + content[:, x])
            of.append(parts)
            sig.append(h)
            void.append(empty[:, list(subset)].all(1))
        of, sig, void = np.concatenate(of), np.concatenate(sig), np.concatenate(void)
        blank += np.bincount(of[void], minlength=len(sets))
        order = np.flatnonzero(void)
        order = order[np.argsort(of[order], kind="stable")]
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        keep = np.ones(len(of), bool)
        keep[order[rank < room[of[order]]]] = False
        left += np.bincount(of[~keep], minlength=len(sets))
        found.append((of[keep], sig[keep]))
    # what either side leaves out is among this set's empty ones
    least = plans[:, 3] - np.minimum(blank, left + room)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), least


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of every signature, under both tags."""
    both = [tagged(sets, percent, step)[:2] for step in (0, 1)]
    return np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])


def _shingles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            yield part, tk.shingle_sets(tk.words(part.column("text")), n)


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for part, sets in _shingles(batches, n):
        key, key2 = set_names(sets)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key), pa.array(key2)], ["doc_id", "n_shingles", "key", "key2"])


def _met(sig: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Signatures with a low bit that says whether this chunk has them of several
    sets. All but one row of those get a place of their own, so that a group
    has a row for each chunk at most, however many sets share it."""
    order = np.lexsort((name, sig))
    s, n = sig[order], name[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]])
    width = np.diff(np.concatenate([np.flatnonzero(fresh), [len(s)]]))
    many = np.repeat(width > 1, width)
    out = np.where(many & ~fresh, tk.mix(s ^ tk.mix(n)), s) & ~_U(1) | many.astype(np.uint64)
    back = np.empty_like(out)
    back[order] = out
    return back


def _signatures(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, sig, name, least): the signatures of a chunk that fall in
    a bucket, and whose they are: a set's key with the step as its low bit. Or,
    in the bucket of a name, what ``tagged`` says of it. In binary columns, so a
    signature costs its own bytes and no row."""
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        sig, name, least = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        true = least == 0
        sig[true] = _met(sig[true], name[true])
        place = ((sig >> _U(1)) % _U(buckets)).astype(np.int64)
        order = np.lexsort((sig, place))
        sig, name, least, place = sig[order], name[order], least[order], place[order]
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            some = slice(cuts[b], cuts[b + 1])
            names, of = np.unique(name[some], return_inverse=True)
            columns = [sig[some].astype("<u8"), names.astype("<u8"), of.astype("<u4"), least[some].astype("<i4")]
            # byte by byte: high bytes of sorted numbers, and zeros, take next to nothing then
            packed = [pa.array([x.view(np.uint8).reshape(len(x), -1).T.tobytes()], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *packed], ["bucket", "sig", "names", "name", "least"])

    for _, sets in _shingles(batches, n):
        keys = set_names(sets)[0]
        new = [k for k, key in enumerate(keys.tolist()) if len(sets[k]) and not (key in seen or seen.add(key))]
        if not new:
            continue
        mine = [sets[k] for k in new]
        for step in (0, 1):
            of, sig, least = tagged(mine, percent, step)
            name = keys[new].view(np.uint64) | _U(step)
            held.append((sig, name[of], np.zeros(len(of), np.int64)))
            some = least > 0
            held.append((tk.mix(name[some]) | _U(1), name[some], least[some]))
        if sum(len(s) for s, *_ in held) >= CHUNK:
            yield from flush()
    yield from flush()


def shared_count(sig: np.ndarray, name: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, count) of a bucket's rows: how many of its signatures another name
    has too, minus what ``tagged`` asks for. Rows that copies repeat count once."""
    order = np.lexsort((least, name, sig >> _U(1))).astype(np.int32)
    sig, name, least = sig[order], name[order], least[order]
    del order
    if not len(sig):
        return name, least.astype(np.int64)
    fresh = np.r_[True, sig[1:] >> _U(1) != sig[:-1] >> _U(1)]
    again = ~fresh & np.r_[False, name[1:] == name[:-1]]
    start = np.flatnonzero(fresh)
    shared = np.logical_or.reduceat((sig & _U(1)).astype(bool), start) | (np.add.reduceat((~again).astype(np.int32), start) > 1)
    use = np.repeat(shared, np.diff(np.r_[start, len(sig)])) & ~again
    del sig, fresh, again, start, shared
    names, of = np.unique(name[use], return_inverse=True)
    return names, np.bincount(of, np.where(least[use] > 0, -least[use], 1), len(names)).astype(np.int64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def numbers(cell: pa.Scalar, kind: str) -> np.ndarray:
        raw = np.frombuffer(cell.as_py(), np.uint8)
        return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in group.column("bucket").unique():
            rows = group.filter(pc.equal(group.column("bucket"), b))
            sig, least = (np.concatenate([numbers(x, kind) for x in rows.column(c)]) for c, kind in (("sig", "<u8"), ("least", "<i4")))
            name = np.concatenate([numbers(x, "<u8")[numbers(y, "<u4")] for x, y in zip(rows.column("names"), rows.column("name"), strict=True)])
            found = shared_count(sig, name, least)
            del rows, sig, least, name
            yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1])], ["name", "c"])

    yield from by_group(batches, ["bucket"], work)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for _, sets in _shingles(batches, n):
        key, key2 = set_names(sets)
        items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key2), pa.array([len(s) for s in sets], pa.int32()), items], ["key", "key2", "n", "items"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each list begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy()
    return flat, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(sig, name, most) of the fine cells; name is 2 * sid + step."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            flat, base = _lists(batch.column("items"))
            sets = [flat[a:b].view(np.uint64) for a, b in zip(base[:-1], base[1:], strict=True)]
            sid = batch.column("sid").to_numpy()
            for step in (0, 1):
                c = cut(sets, percent, step, FINE)
                of, sig = cell_names(c)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(2 * sid[of] + step), pa.array(c.most[of], pa.int32())], ["sig", "name", "most"])


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (least places of what is joined) after joining i with j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def linked_labels(flat: np.ndarray, base: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """For each set flat[base[k]:base[k + 1]] the least place that links reach:
    of the sets not ``second`` with those that are, or among all if none is."""
    m, sizes = len(base) - 1, np.diff(base)
    whose = np.repeat(np.arange(m), sizes)
    _, item, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count[item] > 1
    whose, item = whose[use], item[use]
    often = count[item] > max(COMMON, m // SHARE)
    dense = np.unique(item[often])
    order = np.argsort(item[~often], kind="stable")
    post, post_item = whose[~often][order], item[~often][order]
    first = np.searchsorted(post_item, np.arange(len(count) + 1))
    rare_of, rare_item = whose[~often], item[~often]
    rare_base = np.searchsorted(rare_of, np.arange(m + 1))
    often_of, often_item = whose[often], np.searchsorted(dense, item[often])
    by_item = np.argsort(often_item, kind="stable")
    often_of, often_item = often_of[by_item], often_item[by_item]
    label = np.arange(m)
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if second.any() else left
    column = np.full(m, -1)
    column[right] = np.arange(len(right))
    high = max(1, (1 << 21) // max(1, len(right)))
    wide = max(1, (1 << 22) // max(1, m))
    for at in range(0, len(left), high):
        rows = left[at : at + high]
        common = np.zeros(len(rows) * len(right), np.float32)
        take = np.concatenate([np.arange(rare_base[r], rare_base[r + 1]) for r in rows])
        row = np.repeat(np.arange(len(rows)), rare_base[rows + 1] - rare_base[rows])
        for a in range(0, len(take), 1 << 16):
            e, r = rare_item[take[a : a + (1 << 16)]], row[a : a + (1 << 16)]
            width = first[e + 1] - first[e]
            index = np.repeat(first[e] - np.cumsum(width) + width, width) + np.arange(width.sum())
            col, r = column[post[index]], np.repeat(r, width)
            common += np.bincount((r * len(right) + col)[col >= 0], minlength=len(common)).astype(np.float32)
        common = common.reshape(len(rows), len(right))
        for a in range(0, len(dense), wide):
            lo, hi = np.searchsorted(often_item, [a, a + wide])
            has = np.zeros((m, min(wide, len(dense) - a)), np.float32)
            has[often_of[lo:hi], often_item[lo:hi] - a] = 1
            common += has[rows] @ has[right].T
        both = sizes[rows][:, None] + sizes[right][None, :]
        i, j = np.nonzero((100 + percent) * common >= percent * both - 0.5)
        exact = (100 + percent) * common[i, j].astype(np.int64) >= percent * both[i, j]
        label = united(label, rows[i[exact]], right[j[exact]])
    return label


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each unit's links, as pairs of documents."""
    keys = ["cluster", "lo", "hi"]

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        group = group.combine_chunks()
        k = np.stack([group.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((np.diff(k, axis=1) != 0).any(0)) + 1
        for a, b in zip([0, *cuts], [*cuts, k.shape[1]], strict=True):
            unit = group.slice(a, b - a)
            flat, base = _lists(unit.column("items"))
            second = unit.column("second").to_numpy(zero_copy_only=False).astype(bool)
            if k[1, a] != k[2, a] and (second.all() or not second.any()):
                continue
            label = linked_labels(flat, base, second, percent)
            doc, moved = unit.column("rep").to_numpy(), np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[moved]), pa.array(doc[label[moved]])], ["a", "b"])

    yield from by_group(batches, keys, work)


def _wanted(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, key2, rep) of the sets of which enough signatures are shared; rep
    is the least document with that set."""
    elements = rows.agg(F.sum("n_shingles")).first()[0] or 0
    # two tags, and a quarter more signatures than differences
    buckets = 1 + int(elements * 5 * (100 - percent) / (100 + percent)) // BUCKET
    found = docs.filter("doc_id is not null").select("text").mapInArrow(partial(_signatures, n=n, percent=percent, buckets=buckets), "bucket int, sig binary, names binary, name binary, least binary")
    shared = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "name long, c long")
    alive = shared.groupBy("name").agg(F.sum("c").alias("c")).filter("c >= 0").select(F.expr("shiftleft(shiftright(name, 1), 1)").alias("key")).distinct()
    reps = rows.filter("doc_id is not null and n_shingles > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"))
    return reps.join(alive, "key", "left_semi").checkpoint()


def _candidates(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(sid, rep, n, items) of the wanted sets."""
    wanted = _wanted(docs, rows, n, percent)
    release(docs.sparkSession)
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    texts = may_contain(docs, "doc_id", ids, "doc_id").join(ids, "doc_id").select("text")
    sets = texts.mapInArrow(partial(_sets, n=n), SETS).join(wanted, ["key", "key2"]).dropDuplicates(["key", "key2"])
    return sets.select(F.monotonically_increasing_id().alias("sid"), "rep", "n", "items").checkpoint()


def _edges(sets: DataFrame, percent: int) -> DataFrame:
    """(hub, sid): each set with the least one of each group of its foremost
    fine cells."""
    cells = sets.select("sid", "items").mapInArrow(partial(_cells, percent=percent), "sig long, name long, most int")
    met = cells.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").checkpoint()
    shared = cells.join(met, "sig")
    # cells of no other set are the rarest, so they fill places without a row
    own = Window.partitionBy("name")
    place = F.row_number().over(own.orderBy("n", "sig")) - F.count(F.lit(1)).over(own)
    kept = shared.withColumn("r", place + FINE * F.col("most") + 1).filter("r <= most + 1").select("sig", F.shiftright("name", 1).alias("sid")).checkpoint()
    hub = kept.groupBy("sig").agg(F.min("sid").alias("hub"), F.max("sid").alias("top")).filter("hub < top").drop("top")
    return kept.join(hub, "sig").filter("sid <> hub").select("hub", "sid").distinct().checkpoint()


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges whose sets link."""
    one = sets.select(F.col("sid").alias("hub"), F.col("n").alias("na"), F.col("items").alias("ia"))
    two = sets.select("sid", F.col("n").alias("nb"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    return edges.join(one, "hub").join(two, "sid").filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("hub", "sid").checkpoint()


def set_links(docs: DataFrame, rows: DataFrame, n: int, percent: int, unit: int = UNIT) -> DataFrame:
    """(a, b): a spanning forest of the links between documents' sets, each set
    named by its least document."""
    sets = _candidates(docs, rows, n, percent)
    edges = _edges(sets, percent)
    release(docs.sparkSession)
    of = connected_components(edges, "hub", "sid").select(F.col("id").alias("sid"), F.col("component_id").alias("cluster")).checkpoint()
    sized = of.join(sets.select("sid", F.greatest("n", F.lit(LEAST)).alias("n")), "sid").checkpoint()
    total = sized.groupBy("cluster").agg(F.sum("n").alias("total"))
    large = total.filter(F.col("total") > unit).select("cluster")
    one = lambda d: d.withColumn("open", F.lit(1)).withColumn("closed", F.lit(0)).withColumn("own", F.lit(0))
    members, links = one(sized.join(large, "cluster", "left_anti")), None
    if not large.isEmpty():
        # hubs first; then the sets outside a cluster's largest component meet all
        star = _verified(edges.join(sized.join(large, "cluster", "left_semi").select("sid"), "sid", "left_semi"), sets, percent)
        core = connected_components(star, "hub", "sid").select(F.col("id").alias("sid"), F.col("component_id").alias("core"))
        named = sized.join(large, "cluster", "left_semi").join(core, "sid", "left").withColumn("core", F.coalesce("core", "sid")).checkpoint()
        width = named.groupBy("cluster", "core").agg(F.sum("n").alias("w"))
        main = width.groupBy("cluster").agg(F.max_by("core", F.struct("w", "core")).alias("main"))
        named = named.join(main, "cluster").withColumn("settled", F.col("core") == F.col("main"))
        blocks = lambda c: F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / unit).cast("int")
        shape = named.groupBy("cluster").agg(blocks(~F.col("settled")).alias("open"), blocks(F.col("settled")).alias("closed"))
        dealt = named.join(shape, "cluster").filter("open > 0")
        deal = lambda c: F.pmod(F.xxhash64("sid"), F.col(c)).cast("int")
        members = members.unionByName(dealt.withColumn("own", F.when(F.col("settled"), F.col("open") + deal("closed")).otherwise(deal("open"))).select(members.columns))
        by = sets.select("sid", "rep")
        links = star.join(by, "sid").select("hub", F.col("rep").alias("b")).join(by.select(F.col("sid").alias("hub"), F.col("rep").alias("a")), "hub").select("a", "b")
    last = F.when(F.col("own") < F.col("open"), F.col("open") + F.col("closed")).otherwise(F.col("open")) - 1
    units = members.withColumn("to", F.explode(F.sequence(F.lit(0), last)))
    units = units.select("sid", "cluster", F.least("own", "to").alias("lo"), F.greatest("own", "to").alias("hi"), (F.col("own") > F.col("to")).alias("second"))
    dealt = units.join(sets.select("sid", "rep", "items"), "sid").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    found = dealt.mapInArrow(partial(_links, percent=percent), "a long, b long")
    return (found if links is None else found.unionByName(links)).checkpoint()


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80, unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents: documents
    link when ``100 * intersection >= percent * union`` of their sets of n-word
    shingles; component_id is the smallest doc_id that links reach."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(partial(_rows, n=n), ROWS).checkpoint()
    links = set_links(docs, rows, n, percent, unit)
    # copies of one set link too, and so do the texts of one id
    reps = rows.filter("doc_id is not null and n_shingles > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"))
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("doc_id")
    named = rows.join(reps, ["key", "key2"], "left")
    same = named.filter("doc_id is not null and rep is not null").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = connected_components(links.unionByName(same)).withColumnRenamed("id", "rep")
    return named.join(joined, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id")).alias("component_id"))


def drop_near_copies(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents without those that a component's smallest doc_id stands for;
    rows with a null id, and repeated rows of one id, stay."""
    gone = jaccard_components(documents, n, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return without(documents, "doc_id", gone.checkpoint(), "doc_id")
