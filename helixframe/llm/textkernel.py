"""Vectorised word kernel over Arrow string buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; only A-Z is
lower-cased. Words, shingles and sets are named by 64-bit hashes. Work on the
buffer is cut into windows of about ``WINDOW`` bytes, so that scratch memory
stays bounded however long one text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, WINDOW + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= WINDOW + 4096:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of a batch of texts; start and end are byte offsets in ``data``."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # of documents in data
    first: np.ndarray  # index of each document's first word, with a last entry

    def of(self, d: int) -> slice:
        return slice(self.first[d], self.first[d + 1])


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and document offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def words(texts: pa.Array | pa.ChunkedArray) -> Words:
    data, offsets = buffers(texts)
    hashes, starts, ends = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + WINDOW)
        if to < n:  # cut at white space or at a document's end
            bound = offsets[np.searchsorted(offsets, to)]
            while to < bound and not _SPACE[data[to]]:
                step = min(bound, to + 4096)
                hit = np.flatnonzero(_SPACE[data[to:step]])
                to = to + int(hit[0]) if len(hit) else step
        low = _LOWER[data[at:to]]
        inside = ~_SPACE[low]
        cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to)] - at
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[cuts] = inside[cuts]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        finish[before] = inside[before]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(_BYTE[low] * _power(_BASE, len(low)), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _power(_INVERSE, len(low) + 1)[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(join(hashes, np.uint64), doc, start, join(ends, np.int64), data, offsets, first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n neighbours of h; those across documents too."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = h[:count] * _U(0xD6E8FEB86659FD93) + _U(n)
    for k in range(1, n):
        out = mix(out) + h[k : k + count] * _U(0xD6E8FEB86659FD93)
    return mix(out)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Each document's sorted distinct n-word shingles; with fewer words the
    whole sequence is its one shingle, without words the set is empty."""
    every = grams(w.hash, n)
    out = []
    for d in range(len(w.first) - 1):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(grams(w.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = WINDOW):
    """The batch in runs of rows with about ``limit`` bytes of text at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)
