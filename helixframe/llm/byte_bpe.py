"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A pattern cuts each text into words, and no token spans two of them. Texts are
exploded into words with their positions, packed: a chunk (an Arrow batch of
documents) is one row of positions that name the chunk's distinct words, and
one row of words for each bucket of their hashes. So no word, however common,
travels more than once a chunk. The words meet in their bucket, where each
distinct word is encoded once; its ids go back to the chunks that have it and
take their places in the texts by position. Decoding joins ids to the table of
the tokens' bytes, which is as large as the vocabulary whatever the data.

Both kinds of rows come from the texts by passes of their own, and a task that runs
again must see its rows in the same order, as those of a scan of files are. Other
texts are written first.

Nulls: a null text is empty and has no ids; a null id is carried along. Texts are
encoded whole, however long; words too, by a heap where they are long. Of equal
merges the left one is first, as the ranks leave no other ties. Repeated rows each
give a row; an empty table gives an empty result; other columns are never looked
at. Ids that no token has can't be decoded and raise an error.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, Vocabulary
from .common import by_group, prepare

#: Most buckets of words: a chunk sends a row to each at most.
BUCKETS = 4096
PLACES = "chunk long, bucket int, doc_ids array<long>, sizes array<long>, places binary, buckets binary"
WORDS, ANSWERS = "chunk long, bucket int, words binary", "chunk long, bucket int, lengths binary, ids binary"
#: Letters of these texts are A-Z, a-z and those of Latin-1, and their white space
#: is ASCII's, so the standard library can split them by explicit classes.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIMPLE = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


class Ranks(Vocabulary):
    """Tokens by their bytes. A pair may merge if its bytes are a token's; the
    token's rank, which is its id, says when."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        pairs = {}
        for token, made in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = made
        keys = np.array(list(pairs), np.int64)
        order = np.argsort(keys)
        self.pairs = pairs
        self._keys, self._ranks = keys[order], np.array(list(pairs.values()), np.int32)[order]
        self._made = np.arange(max(self.ids.values()) + 1, dtype=np.int32)
        self._byte = np.array([[self.ids[bytes([b])] for b in range(256)]] * 2, np.int32)

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word by a heap of its pairs: no worse than n log n."""
        ids = self._byte[0][np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(made, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (made := pairs.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            made, k, a, b = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r] = made, -1
            right[k] = right[r]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (then := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (then, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_bytes(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words, as little-endian 32-bit numbers."""
        known = {w: self.ids[w].to_bytes(4, "little") for w in words if w in self.ids}
        known |= {w: self.merge_long(w) for w in words if len(w) > LONG and w not in known}
        rest = {w.decode("latin-1") for w in words if w not in known}
        return known | {w.encode("latin-1"): ids for w, ids in self.merge_words(rest).items()}


@lru_cache(1)
def ranks(path: str) -> Ranks:
    """One a worker: the pairs take a second to find."""
    return Ranks(path)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


@lru_cache(4)
def _splitters(pattern: str):
    import regex

    explicit = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
    return regex.compile(pattern).findall, None if r"\p" in explicit else re.compile(explicit, re.ASCII).findall


def split(text: str, pattern: str) -> list[str]:
    """The words of a text."""
    whole, simple = _splitters(pattern)
    return simple(text) if simple and _SIMPLE.fullmatch(text) else whole(text)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the upper ones are nearly all zeros."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _joined(parts: list[bytes]) -> bytes:
    """Byte strings with their lengths in front."""
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts))


def _parted(joined: bytes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(joined)
    n = int.from_bytes(whole[:4], "little")
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(whole, "<u4", n, 4))
    return [whole[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def _numbered(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[tuple]:
    """Of each batch: its chunk, the words from the most frequent one on, so that
    places are small numbers, their buckets, and where they are."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(b for b in batches if b.num_rows):
        numbers, places = _Numbers(), []
        for text in batch.column("text").to_pylist():
            found = split(text, pattern) if text else []
            places.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
        at = np.concatenate(places)
        order = np.argsort(-np.bincount(at, minlength=len(numbers)), kind="stable") if len(numbers) else np.zeros(0, np.int64)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = [w.encode() for w in numbers]
        words = [words[i] for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
        yield batch, part << 32 | k, words, bucket, rank[at], [len(p) for p in places]


def _places(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of places for each chunk."""
    for batch, chunk, _, bucket, at, sizes in _numbered(batches, pattern, buckets):
        columns = [pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_packed(at)], pa.binary()), pa.array([_packed(bucket)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "doc_ids", "sizes", "places", "buckets"])


def _words(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of words for each chunk and bucket."""
    for _, chunk, words, bucket, _, _ in _numbered(batches, pattern, buckets):
        by_bucket = np.argsort(bucket, kind="stable")
        there, starts = np.unique(bucket[by_bucket], return_index=True)
        ends = [*starts[1:].tolist(), len(words)]
        sent = [_joined([words[i] for i in by_bucket[a:b].tolist()]) for a, b in zip(starts.tolist(), ends, strict=bool(len(there)))]
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(there), pa.int64()), pa.array(there, pa.int32()), pa.array(sent, pa.binary())], ["chunk", "bucket", "words"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Words become ids. Rows come by bucket; a bucket's words are kept while its
    rows last, so each distinct one is encoded once."""
    table, known, current = ranks(path), {}, None
    for batch in batches:
        lengths, ids = [], []
        bucket = batch.column("bucket").to_pylist()
        rows = [_parted(w) for w in batch.column("words").to_pylist()]
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and bucket[to] == bucket[at]:
                to += 1
            if bucket[at] != current:
                known, current = {}, bucket[at]
            known |= table.encode_bytes({w for r in rows[at:to] for w in r if w not in known})
            for r in rows[at:to]:
                found = [known[w] for w in r]
                lengths.append(_packed(np.fromiter(map(len, found), np.uint32, len(found)) // 4))
                ids.append(_packed(np.frombuffer(b"".join(found), "<u4")))
            at = to
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "bucket", "lengths", "ids"])


def _assemble(whole: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole chunks: each place gets its word's ids."""
    chunks = whole.column("chunk").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]])).tolist()
    for a, b in zip(starts, [*starts[1:], len(chunks)], strict=True):
        rows = whole.slice(a, b - a)
        head = rows.slice(0, 1).to_pylist()[0]
        none = [np.zeros(0, np.uint32)]
        length, flat = (np.concatenate(none + [_unpacked(x) for x in rows.slice(1).column(c).to_pylist()]) for c in ("lengths", "ids"))
        length = length.astype(np.int64)
        of_bucket = np.argsort(_unpacked(head["buckets"]), kind="stable")
        place, sizes = _unpacked(head["places"]), np.array(head["sizes"], np.int64)
        # in the order of the places' numbers, not of the buckets
        start, count = np.empty(len(of_bucket), np.int64), np.empty(len(of_bucket), np.int64)
        start[of_bucket], count[of_bucket] = np.cumsum(length) - length, length
        flat = flat.astype(np.int32)
        at = 0
        for lo, hi in _runs(sizes):
            mine = place[at : at + int(sizes[lo:hi].sum())]
            at += len(mine)
            n = count[mine]
            ends = np.cumsum(n)
            ids = flat[np.arange(int(n.sum())) + np.repeat(start[mine] - ends + n, n)]
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes[lo:hi])])]
            yield pa.RecordBatch.from_arrays([pa.array(head["doc_ids"][lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["doc_id", "ids"])


def _runs(sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Documents of about ``limit`` words together, one at least."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def token_ids(documents: DataFrame, path: str, pattern: str, stable: bool = False) -> DataFrame:
    """doc_id and the ids of each whole text. ``stable``: the rows of documents
    come in the same order whenever they are read, as from a table of files; if
    not, they are written first."""
    spark = prepare(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not stable:
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/texts-{uuid.uuid4().hex}"
        texts.write.parquet(folder)
        texts = spark.read.schema("doc_id long, text string").parquet(folder)
    buckets = min(BUCKETS, 2 * max(8, texts.rdd.getNumPartitions()))
    words = texts.mapInArrow(partial(_words, pattern=pattern, buckets=buckets), WORDS)
    answers = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_encode, path=path), ANSWERS)
    whole = texts.mapInArrow(partial(_places, pattern=pattern, buckets=buckets), PLACES).unionByName(answers, allowMissingColumns=True)
    return whole.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(partial(by_group, keys=["chunk"], work=_assemble), "doc_id long, ids array<int>")


def _bytes_of(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    ids = ranks(path).ids
    table: list[bytes | None] = [None] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = token
    tokens = pa.array(table, pa.binary())
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
        found = tokens.take(pc.if_else(known, flat, None))
        if found.null_count:
            raise ValueError("an id that no token has")
        # the bytes found lie one behind the other; a list's are a run of them
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        at = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1][ends].tobytes() if len(found) else bytes(4 * len(ends))
        data = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), found.buffers()[2] or pa.py_buffer(b"")])
        yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(lists.is_valid(), data, None)], [*batch.schema.names, "data"])


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with data, the bytes that the ids stand for: a join of ids
    and the tokens' bytes, of which the table is with every task."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_bytes_of, path=path), "doc_id long, ids array<int>, data binary")


def token_digests(documents: DataFrame, path: str, pattern: str, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by a space and of the
    decoded bytes."""
    both = decoded(token_ids(documents, path, pattern, stable), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
