"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity``; pieces are dealt evenly
to groups of bounded size and each group is packed by best-fit decreasing. Dual
feasible functions bound from below the bins that a group's pieces need: a group
with as many bins is certified and its bins stay as they are. Groups with a gap
give up the pieces of their poorly filled bins; these are dealt to fresh groups,
so documents of different groups meet, and are packed again. Certificates of
groups don't make one of all, as each rounds up: so while all bins together are
above the bound of all pieces, a certified group gives up its least filled bin,
and that one alone. It ends when the bins are as few as that bound, when there
is nobody to exchange with, or when it saves no bin.

Nulls: a null text is empty and a null id is carried along. An empty text is
the end token alone. Texts are taken whole, however long, and only cut where
longer than ``capacity``. Pieces of one length are ordered by document, piece
and content, so ties are settled by the rows alone. Repeated rows are packed
each; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import prepare

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, fill long, gap long, least boolean"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    e = bpe.encoder(path, walk=False)
    tail = end.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        row, piece, start, length, crc = [], [], [], [], []
        for first, run in bpe.text_runs([t or "" for t in batch.column("text").to_pylist()]):
            for k, split in enumerate(e.cut(run)):
                ids = e.ids(split) + tail
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    row.append(first + k)
                    piece.append(at // capacity)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids if size == n else ids[4 * at : 4 * (at + size)]))
        columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        yield pa.RecordBatch.from_arrays(columns, names)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that sizes need at least."""
    values, counts = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    return lower_bound_of(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity)


def lower_bound_of(counts: dict[int, int], capacity: int) -> int:
    """Bins that pieces need at least, from how many there are of each size, by
    two families of dual feasible functions: pieces above capacity - k count
    whole and those below k not at all; and multiples of 1 / (k + 1) round down
    to multiples of 1 / k."""
    if not counts:
        return 0
    count = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        count[size] = n
    number, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(0, capacity // 2 + 1)
    middle = weight[capacity - k] - np.where(k > 0, weight[np.maximum(k - 1, 0)], 0)
    best = int((number[-1] - number[capacity - k] + -(-middle // capacity)).max())
    s = np.flatnonzero(count)
    for m in range(1, 33):
        whole = (s * (m + 1)) % capacity == 0
        twice = np.where(whole, s * m, (s * (m + 1) // capacity) * capacity)
        best = max(best, int(-(-int((twice * count[s]).sum()) // (m * capacity))))
    return best


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size, which come in decreasing order, and the fill
    of each bin. Bins wait by the room that they have left; a bit set says which
    amounts of room there are."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    fill: list[int] = []
    where, offset = [], []
    for size in sizes:
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where.append(b)
        offset.append(fill[b])
        fill[b] += size
        room -= size
        if room:
            waiting[room].append(b)
            rooms |= 1 << room
    return where, offset, fill


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, turn: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    sizes = t.column("length").to_numpy()
    where, offset, fill = best_fit(sizes.tolist(), capacity)
    base = (turn << 56) + (TaskContext.get().partitionId() << 24)
    gap = len(fill) - lower_bound(sizes, capacity)
    bins, least = np.array(where, np.int64), len(fill) - 1 - int(np.argmin(fill[::-1]))
    for name, values in (("sequence_id", bins + base), ("offset", np.array(offset, np.int64)), ("fill", np.array(fill, np.int64)[bins]), ("gap", np.full(len(bins), gap, np.int64)), ("least", bins == least)):
        t = t.append_column(name, pa.array(values))
    yield from t.to_batches(max_chunksize=10_000)


def token_pieces(documents: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's token pieces."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(partial(_pieces, path=path, capacity=capacity, end=end), PIECES)


def needed_bins(pieces: DataFrame, capacity: int = 4096) -> int:
    """A lower bound of the bins of all pieces; one row a length comes here."""
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    return lower_bound_of({r.length: r.n for r in found}, capacity)


def pack(pieces: DataFrame, capacity: int = 4096, group: int = 40_000, turns: int = 6) -> DataFrame:
    """pieces with sequence_id and offset. ``group`` bounds the pieces that are
    packed by one task, ``turns`` the exchanges between groups."""
    return packed_with_gap(pieces, capacity, group, turns).drop("fill", "gap", "least")


def packed_with_gap(pieces: DataFrame, capacity: int = 4096, group: int = 40_000, turns: int = 6) -> DataFrame:
    """The same with each bin's fill, the gap (bins above the bound) of the group
    that packed it, 0 if certified, and whether it was that group's least filled."""
    prepare(pieces.sparkSession)
    bound = needed_bins(pieces, capacity)
    bin_ = F.col("offset") == 0
    items, done, settled, before = pieces, None, 0, None
    for turn in range(turns + 1):
        groups = max(1, -(-items.count() // group))
        packed = items.repartition(groups).mapInArrow(partial(_pack, capacity=capacity, turn=turn), PACKED).checkpoint()
        poor = (F.col("fill") < capacity - capacity // 64) & ((F.col("gap") > 0) | F.col("least"))
        seen = packed.filter(bin_).agg(F.count(F.lit(1)).alias("bins"), F.count(F.when(poor, 1)).alias("loose"), F.count_distinct(F.when(poor, F.shiftright("sequence_id", 24))).alias("open")).first()
        stop = turn == turns or settled + seen["bins"] <= bound or seen["open"] < 2 or (before is not None and seen["bins"] >= before)
        kept = packed if stop else packed.filter(~poor)
        done = kept if done is None else done.unionByName(kept)
        if stop:
            return done
        settled, before = settled + seen["bins"] - seen["loose"], seen["loose"]
        items = packed.filter(poor).drop("sequence_id", "offset", "fill", "gap", "least")
    return done


def pack_documents(documents: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents
    as tokens with an end token, cut only where longer than ``capacity``, in few
    sequences of at most ``capacity`` tokens."""
    return pack(token_pieces(documents, path, capacity, end).checkpoint(), capacity)
