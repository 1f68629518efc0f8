"""Motif features of many motifs at once.

A window's odds are the mean over both strands of exp(score); its potential is
log(1 + scale * odds) - log(1 + scale), so a window without evidence adds nothing.

A motif is cut into parts of at most PART columns. A part's odds of all its words
are one table, so a window's odds are a product of looked-up rows: of the words
at its parts' places, read as numbers of base 4 that roll along a sequence. The
other strand reads the same tables with the complements' numbers, its parts in
reverse order. Motifs are parameters, a bounded table that travels with the task;
sequences stream past in Arrow batches. Windows with letters beyond ACGT count
nothing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a part (a table of 4 ** PART words), and windows looked up at once.
PART, STEP = 5, 1 << 11
_BASE = np.full(256, 4, np.uint8)
_BASE[[65, 67, 71, 84]] = range(4)


@dataclass
class Family:
    """The motifs of one width: which they are, and for each part its first
    column, its width, and the odds of its words by strand (words x motifs)."""

    width: int
    motifs: np.ndarray
    parts: list[tuple[int, int, np.ndarray, np.ndarray]]


def complements(n: int) -> np.ndarray:
    """The number of the reverse complement of each word of n letters."""
    words = np.arange(4**n)
    out = np.zeros_like(words)
    for _ in range(n):
        out, words = out * 4 + 3 - words % 4, words // 4
    return out


def families(matrices: list[np.ndarray]) -> list[Family]:
    """Motifs (4 x width arrays of log odds) by width, with their tables."""
    shapes = np.array([np.shape(m)[1] for m in matrices])
    found = []
    for width in np.unique(shapes).tolist():
        members = np.flatnonzero(shapes == width)
        cuts = np.linspace(0, width, -(-width // PART) + 1).round().astype(int).tolist()
        parts = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            scores = np.zeros((1, len(members)))
            for column in range(lo, hi):
                letter = np.array([matrices[k][:, column] for k in members], float).T
                scores = (scores[:, None, :] + letter[None, :, :]).reshape(-1, len(members))
            odds = np.exp(scores)
            parts.append((lo, hi - lo, odds, odds[complements(hi - lo)]))
        found.append(Family(width, members, parts))
    return found


class Text:
    """Sequences one behind the other, with a stop after each."""

    def __init__(self, sequences: list[str]):
        coded = [_BASE[np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8)] for s in sequences]
        self.size = np.array([len(c) for c in coded], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.codes = np.concatenate([x for c in coded for x in (c, np.array([4], np.uint8))] or [np.zeros(0, np.uint8)])
        self.stops = np.concatenate([[0], np.cumsum(self.codes == 4)])
        self._words: dict[int, np.ndarray] = {}

    def words(self, n: int) -> np.ndarray:
        """The number of the n letters from each place on (of any value at stops)."""
        if n not in self._words:
            known, out = np.where(self.codes == 4, 0, self.codes).astype(np.int32), 0
            for k in range(n):
                out = out * 4 + np.roll(known, -k)
            self._words[n] = out
        return self._words[n]

    def clear(self, places: np.ndarray, width: int) -> np.ndarray:
        """Which windows have no stop and no other letter."""
        return self.stops[np.minimum(places + width, len(self.codes))] == self.stops[places]


def _spread(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges lo..hi - 1, each with its range's owner."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    return np.repeat(owner, n), np.arange(int(n.sum())) + np.repeat(lo - ends + n, n)


def potentials(text: Text, places: np.ndarray, family: Family, scale: float) -> np.ndarray:
    """Of the windows at places, for each motif of a family."""
    one = two = None
    for lo, n, odds, other in family.parts:
        words = text.words(n)
        a, b = odds[words[places + lo]], other[words[places + family.width - lo - n]]
        one, two = (a, b) if one is None else (one * a, two * b)
    return np.log1p(scale * (one + two) / 2) - np.log1p(scale)


def _summed(out: np.ndarray, text: Text, owner: np.ndarray, sign: np.ndarray, places: np.ndarray, family: Family, scale: float) -> None:
    """Adds signed potentials of windows to their owners' rows; owners come in order."""
    whole = text.clear(places, family.width)
    owner, sign, places = owner[whole], sign[whole], places[whole]
    for at in range(0, len(places), STEP):
        piece = slice(at, at + STEP)
        value = potentials(text, places[piece], family, scale) * sign[piece, None]
        first = np.flatnonzero(np.diff(owner[piece], prepend=-1))
        out[owner[piece][first][:, None], family.motifs[None, :]] += np.add.reduceat(value, first, axis=0)


def _alike(a: str, b: str) -> tuple[int, int]:
    """Letters that both begin, and further ones that both end, alike."""
    most = min(len(a), len(b))
    x, y = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (a, b))
    head = np.flatnonzero(x[:most] != y[:most])
    p = int(head[0]) if len(head) else most
    tail = np.flatnonzero(x[len(x) - most + p :][::-1] != y[len(y) - most + p :][::-1])
    return p, int(tail[0]) if len(tail) else most - p


def deltas(references: list[str], sequences: list[str], motifs: list[Family], scale: float) -> np.ndarray:
    """Potential of each sequence minus its reference's: only windows that touch
    the edit differ, so only those are scored."""
    n = len(references)
    text = Text([*references, *sequences])
    same = np.array([_alike(a.upper(), b.upper()) for a, b in zip(references, sequences, strict=True)], np.int64).reshape(n, 2)
    out = np.zeros((n, sum(len(f.motifs) for f in motifs)))
    for family in motifs:
        ranges = []
        for start, size in ((text.start[:n], text.size[:n]), (text.start[n:], text.size[n:])):
            last = np.minimum(size - same[:, 1], size - family.width + 1)
            ranges.append(_spread(np.arange(n), start + np.maximum(same[:, 0] - family.width + 1, 0), start + last))
        owner, places = (np.concatenate([r[k] for r in ranges]) for k in (0, 1))
        sign = np.repeat([-1.0, 1.0], [len(r[0]) for r in ranges])
        order = np.argsort(owner, kind="stable")
        _summed(out, text, owner[order], sign[order], places[order], family, scale)
    return out


def endpoints(sequences: list[str], motifs: list[Family], scale: float) -> np.ndarray:
    """Potential of each whole sequence for each motif."""
    text = Text(sequences)
    out = np.zeros((len(sequences), sum(len(f.motifs) for f in motifs)))
    for family in motifs:
        owner, places = _spread(np.arange(len(sequences)), text.start, text.start + text.size - family.width + 1)
        _summed(out, text, owner, np.ones(len(owner)), places, family, scale)
    return out


def _rows(found: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))


def _delta_rows(batches: Iterator[pa.RecordBatch], matrices: list[np.ndarray], scale: float, quadratic: bool) -> Iterator[pa.RecordBatch]:
    motifs = families(matrices)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            r, s = b.column("reference").to_pylist(), b.column("sequence").to_pylist()
            found = deltas(r, s, motifs, scale)
            columns = [b.column("reference"), b.column("sequence"), _rows(found)]
            if quadratic:
                columns.append(_rows(found * (endpoints(r, motifs, scale) + endpoints(s, motifs, scale))))
            yield pa.RecordBatch.from_arrays(columns, ["reference", "sequence", "delta", "quadratic"][: len(columns)])


def _each_once(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows of keys without nulls, dealt to all cores: a row costs
    milliseconds, so partitions of few bytes must not be merged."""
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.select(*keys).dropna().repartition(parts, *keys).distinct()


def motif_deltas(df: DataFrame, matrices: list[np.ndarray], scale: float = 1.0, quadratic: bool = False, summary: dict[str, Column] | None = None) -> DataFrame:
    """df (reference, sequence, ...) with delta, an array over the motifs, and,
    if asked for, quadratic: delta times the sum of both potentials. Equal pairs
    are scored once; null sequences get nulls. With ``summary``, columns by name
    of these arrays take their place before anything is shuffled."""
    ddl = "reference string, sequence string, delta array<double>" + (", quadratic array<double>" if quadratic else "")
    scored = _each_once(df, "reference", "sequence").mapInArrow(partial(_delta_rows, matrices=matrices, scale=scale, quadratic=quadratic), ddl)
    if summary:
        scored = scored.select("reference", "sequence", *[c.alias(name) for name, c in summary.items()])
    return df.join(scored, ["reference", "sequence"], "left")


def _endpoint_rows(batches: Iterator[pa.RecordBatch], matrices: list[np.ndarray], scale: float) -> Iterator[pa.RecordBatch]:
    motifs = families(matrices)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            yield pa.RecordBatch.from_arrays([b.column("sequence"), _rows(endpoints(b.column("sequence").to_pylist(), motifs, scale))], ["sequence", "potential"])


def _endpoint_columns(batches: Iterator[pa.RecordBatch], matrices: list[np.ndarray], scale: float) -> Iterator[pa.RecordBatch]:
    motifs = families(matrices)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            texts = b.column("sequence")
            found = _rows(endpoints([x or "" for x in texts.to_pylist()], motifs, scale))
            rated = pc.if_else(texts.is_valid(), found, pa.scalar(None, found.type))
            yield pa.RecordBatch.from_arrays([*b.columns, rated], [*b.schema.names, "potential"])


def motif_endpoints(df: DataFrame, matrices: list[np.ndarray], scale: float = 1.0, once: bool = True) -> DataFrame:
    """df (sequence, ...) with potential, an array over the motifs. Where
    sequences hardly repeat and motifs are few, ``once=False`` scores each row
    where it is, without a shuffle."""
    if not once:
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(partial(_endpoint_columns, matrices=matrices, scale=scale), f"{kept}, potential array<double>")
    scored = _each_once(df, "sequence").mapInArrow(partial(_endpoint_rows, matrices=matrices, scale=scale), "sequence string, potential array<double>")
    return df.join(scored, "sequence", "left")


def drawn_matrices(count: int, seed: int = 0) -> list[np.ndarray]:
    """Log odds of random motifs of 6 to 20 bases, as a stand-in for a library."""
    g = np.random.default_rng(seed)
    return [np.log(np.clip(g.dirichlet(np.full(4, 0.4), int(g.integers(6, 21))).T, 1e-3, None) / 0.25) for _ in range(count)]


def scrambled_columns(width: int, seed):
    """An array column of a motif's column numbers in an order that hashes of
    seed (a text or a column) and number give, so any engine scrambles alike."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    numbers = F.array(*[F.struct(F.sha2(F.concat(seed, F.lit(f":{k}")).cast("binary"), 256).alias("h"), F.lit(k).alias("k")) for k in range(width)])
    return F.transform(F.array_sort(numbers), lambda x: x["k"])
