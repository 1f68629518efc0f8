"""Language-model scoring: a class-based log-bilinear model trained by noise-
contrastive estimation.

A token's probability is P(class | two classes before) * P(token | class). The
OWN most frequent tokens are classes of their own, with vectors of their own;
the others fall in SHAPES classes by their last bytes. The first factor is
log-bilinear: the classes before are embedded, mapped linearly and multiplied
with the class's own vector. Sums of two terms make the normaliser of all
contexts one matrix product. The second factor, and the base score, are add-one
estimates from counts of all training tokens; counts of frequent tokens go to
the tasks (a bounded table), those of the others meet the texts in a join.

The first factor is trained in numpy, on every training token. Documents are
dealt by a hash to shards of about SHARE tokens, so their number follows the
data, and to ROUNDS parts of each shard. In a round every shard runs its part
through noise-contrastive steps, from the parameters and the step sizes that the
round before left; their means by tokens are what the next round begins with.
Neither files nor partitions decide who learns what, and a shard's steps are as
many however large the corpus is.

Nulls: a null text is empty, so its one token is the end. A null id is never
learned from and counts as held out. Texts are taken whole, however long.
Repeated rows are learned from and scored each; of equally frequent tokens those
of the least hash come first. An empty table gives an empty result; without
training text, N and V are 0. Columns besides doc_id and text are never looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import prepare

#: Tokens that are classes of their own; classes of other tokens; length of
#: vectors; noise samples a step; tokens a step; tokens whose counts are sent.
OWN, SHAPES, WIDTH, NOISE, STEP, SENT = 1792, 255, 16, 64, 512, 1 << 16
#: Tokens of a shard; rounds of training; a step's size.
SHARE, ROUNDS, RATE = 1 << 22, 8, 0.3
#: Tasks whose parameters are added up before they come to the driver.
SUMS = 16
END = np.uint64(0x656E64)  # the end token's name; words' names are scrambled
_U = np.uint64
#: Classes: OWN tokens, SHAPES, end (last of the outputs), start (context alone).
CLASSES = OWN + SHAPES + 1
OUT = "kind int, h long, rid long, doc_id long, m int, n_tokens long, n_known long, base double, score double"


def shapes(w: tk.Words) -> np.ndarray:
    """A class in 0..SHAPES-1 for each word, from its last three bytes and
    whether its first is an ASCII letter."""
    if not len(w.hash):
        return np.zeros(0, np.int64)
    low = tk._LOWER[w.data]
    size = w.end - w.start
    code = np.zeros(len(size), np.uint64)
    for k in (1, 2, 3):
        code = code * _U(257) + np.where(size >= k, low[np.maximum(w.end - k, 0)].astype(np.uint64) + _U(1), _U(0))
    return (tk.mix(code + _U(977)) % _U(SHAPES)).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tk.Words]]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            yield part, tk.words(part.column("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, kinds, docs = [], [], 0
        for part in tk.slices(batch, "text"):
            w = tk.words(part.column("text"))
            names.append(w.hash)
            kinds.append(shapes(w))
            docs += part.num_rows
        if docs:
            h, first, n = np.unique(np.concatenate([*names, [END]]).astype(np.uint64), return_index=True, return_counts=True)
            kind = np.concatenate([*kinds, [SHAPES]])[first]
            n[h == END] = docs
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], ["h", "shape", "c"])


class Lexicon:
    """Names and counts of the frequent tokens, and totals of the classes."""

    def __init__(self, top: list[tuple[int, int, int]], totals: list[tuple[int, int, int]]):
        """top: (h, shape, count), most frequent first; totals: (shape, tokens,
        distinct) of all. The end token is in neither."""
        self.total = sum(t[1] for t in totals)
        self.distinct = sum(t[2] for t in totals)
        self.docs = 0
        mass, kinds = np.zeros(SHAPES + 1), np.zeros(SHAPES + 1)
        for s, n, v in totals:
            mass[s], kinds[s] = n, v
        names = np.array([t[0] for t in top], np.int64).view(np.uint64)
        self.order = np.argsort(names)
        self.names = names[self.order]
        self.counts = np.array([t[2] for t in top], np.int64)[self.order]
        own = np.arange(len(top)) < OWN
        for _, s, c in top[:OWN]:
            mass[s] -= c
            kinds[s] -= 1
        self.rank = np.where(own, np.arange(len(top)), -1)[self.order]
        self.spread = np.log10(mass + kinds + 1)  # of P(token | shape)
        unigram = np.zeros(CLASSES)
        unigram[: min(OWN, len(top))] = [t[2] for t in top[:OWN]]
        unigram[OWN : OWN + SHAPES] = mass[:SHAPES]
        self.unigram = unigram

    def with_docs(self, docs: int) -> Lexicon:
        self.docs = docs
        self.unigram[-1] = docs
        self.noise = (self.unigram + 1) / (self.unigram + 1).sum()
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in names, or -1."""
        if not len(self.names):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return np.where(self.names[at] == h, at, -1)

    def classes(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in names or -1) of each word."""
        at = self.find(w.hash)
        rank = np.where(at >= 0, self.rank[at] if len(self.rank) else -1, -1)
        return np.where(rank >= 0, rank, OWN + shapes(w)), at


def contexts(first: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, class, class before, class two before) of every token, ends
    included; before the first stands the start class. Document d has the words
    first[d]:first[d + 1]."""
    n = len(first) - 1
    own = np.repeat(np.arange(n), np.diff(first))
    size = len(kinds) + n
    out = np.full(size, CLASSES - 1)
    out[np.arange(len(kinds)) + own] = kinds
    ends = first[1:] + np.arange(n)
    doc = np.repeat(np.arange(n), np.diff(first) + 1)
    begin = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, np.int64)
    one = np.concatenate([[CLASSES], out[:-1]]) if size else out
    one[begin] = CLASSES
    two = np.concatenate([[CLASSES], one[:-1]]) if size else out
    two[begin] = CLASSES
    return doc, out, one, two


class Model:
    """s(c | a, b) = (R[a] A + R[b] B) . Q[c] + bias[c], for a just before c."""

    SHAPE = {"R": (CLASSES + 1, WIDTH), "Q": (CLASSES, WIDTH), "A": (WIDTH, WIDTH), "B": (WIDTH, WIDTH), "bias": (CLASSES, 1)}

    def __init__(self, values: dict[str, np.ndarray], grown: dict[str, np.ndarray] | None = None):
        self.values = values
        self.grown = grown or {k: np.full(s, 1e-3) for k, s in self.SHAPE.items()}

    @classmethod
    def fresh(cls, noise: np.ndarray) -> Model:
        g = np.random.default_rng(7)
        v = {k: g.normal(0, 0.1, s) for k, s in cls.SHAPE.items()}
        v["A"], v["B"] = np.eye(WIDTH), np.eye(WIDTH) / 2
        v["bias"] = np.log(noise)[:, None]
        return cls(v)

    def packed(self) -> np.ndarray:
        """All parameters, then their step sizes, as one vector."""
        return np.concatenate([x.ravel() for part in (self.values, self.grown) for x in part.values()])

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for _ in range(2):
            part = {}
            for k, s in cls.SHAPE.items():
                part[k] = flat[at : at + s[0] * s[1]].reshape(s).astype(np.float64)
                at += s[0] * s[1]
            parts.append(part)
        return cls(*parts)

    def train(self, rate: float, noise: np.ndarray, seed: int = 11):
        """A function that takes a step on tokens (class, before, two before)."""
        v, grown = self.values, self.grown
        g = np.random.default_rng(seed)
        cumulative = np.cumsum(noise)
        shift = np.log(NOISE * noise)

        def scatter(rows: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
            wide = values.shape[1]
            flat = (index[:, None] * wide + np.arange(wide)).ravel()
            return np.bincount(flat, values.ravel(), rows * wide).reshape(rows, wide)

        def step(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            other = np.minimum(np.searchsorted(cumulative, g.random(NOISE)), CLASSES - 1)
            ra, rb = v["R"][a], v["R"][b]
            hidden = ra @ v["A"] + rb @ v["B"]
            qc, qo = v["Q"][c], v["Q"][other]
            up = np.einsum("ij,ij->i", hidden, qc) + v["bias"][c, 0] - shift[c]
            down = hidden @ qo.T + v["bias"][other, 0] - shift[other]
            gu = -1 / (1 + np.exp(np.clip(up, -30, 30)))
            gd = 1 / (1 + np.exp(-np.clip(down, -30, 30)))
            back = gu[:, None] * qc + gd @ qo
            grad = {"A": ra.T @ back, "B": rb.T @ back}
            grad["R"] = scatter(CLASSES + 1, np.concatenate([a, b]), np.concatenate([back @ v["A"].T, back @ v["B"].T]))
            grad["Q"] = scatter(CLASSES, np.concatenate([c, other]), np.concatenate([gu[:, None] * hidden, gd.T @ hidden]))
            grad["bias"] = (np.bincount(c, gu, CLASSES) + np.bincount(other, gd.sum(0), CLASSES))[:, None]
            for k, x in grad.items():
                x /= len(c)
                grown[k] += x * x
                v[k] -= rate * x / np.sqrt(grown[k])

        return step

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one, two, norm): ln P(c | a, b) = one[a, c] + two[b, c] - norm[a, b].
        The sums over all classes are one product of matrices."""
        v = self.values
        one = v["R"] @ v["A"] @ v["Q"].T + v["bias"].T
        two = v["R"] @ v["B"] @ v["Q"].T
        ma, mb = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.exp(one - ma) @ np.exp(two - mb).T) + ma + mb.T
        return one, two, norm


def _coded(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, part, place, kinds): a document's classes, 16 bits each."""
    for part, w in _batches(batches):
        kinds = lexicon.classes(w)[0].astype("<u2")
        place = part.column("place").to_numpy()
        name = tk.mix(place.view(np.uint64))
        rows = [kinds[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array((name % _U(shards)).astype(np.int64)), pa.array((tk.mix(name) % _U(ROUNDS)).astype(np.int32)), pa.array(place), pa.array(rows, pa.binary())], ["shard", "part", "place", "kinds"])


def _trained(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, flat: bytes, turn: int) -> Iterator[pa.RecordBatch]:
    """(x, w): the mean by tokens of the models of this task's shards, which come
    one after the other, and their tokens."""
    start = np.frombuffer(flat, np.float32)
    total, tokens = np.zeros(len(start)), 0
    shard, step, model, held, size, own = None, None, None, [], 0, 0

    def learn() -> None:
        nonlocal held, size, own
        if not held:
            return
        kinds = [np.frombuffer(x, "<u2") for x in held]
        first = np.concatenate([[0], np.cumsum([len(x) for x in kinds])])
        _, c, a, b = contexts(first, np.concatenate(kinds).astype(np.int64))
        order = np.random.default_rng(len(c)).permutation(len(c))
        for at in range(0, len(c), STEP):
            k = order[at : at + STEP]
            step(c[k], a[k], b[k])
        own += len(c)
        held, size = [], 0

    def close() -> None:
        nonlocal total, tokens, own
        learn()
        if own:
            total += own * model.packed()
            tokens += own
        own = 0

    for batch in batches:
        for number, kinds in zip(batch.column("shard").to_pylist(), batch.column("kinds"), strict=True):
            if number != shard:
                close()
                shard, model = number, Model.unpacked(start)
                step = model.train(RATE, lexicon.noise, number * ROUNDS + turn)
            held.append(kinds.as_py())
            size += len(held[-1])
            if size >= 64 * STEP:
                learn()
    close()
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["x", "w"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = 0.0, 0
    for batch in batches:
        for x, w in zip(batch.column("x"), batch.column("w").to_pylist(), strict=True):
            total, tokens = total + w * np.frombuffer(x.as_py(), "<f4").astype(np.float64), tokens + w
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["x", "w"])


def fit(learn: DataFrame, lexicon: Lexicon, share: int = SHARE) -> Model:
    """Train on all of learn (place, text); place is a hash that orders them."""
    model = Model.fresh(lexicon.noise)
    if not lexicon.docs:
        return model
    shards = max(1, -(-(lexicon.total + lexicon.docs) // share))
    coded = learn.mapInArrow(partial(_coded, lexicon=lexicon, shards=shards), "shard long, part int, place long, kinds binary")
    coded = coded.repartition("shard").sortWithinPartitions("part", "shard", "place", "kinds").checkpoint()
    for turn in range(ROUNDS):
        flat = model.packed().astype("<f4").tobytes()
        rows = coded.filter(F.col("part") == turn).mapInArrow(partial(_trained, lexicon=lexicon, flat=flat, turn=turn), "x binary, w long")
        # SUMS rows of the size of the model at most
        found = rows.repartition(SUMS, F.pmod(F.xxhash64("x"), F.lit(SUMS))).mapInArrow(_summed, "x binary, w long").collect()
        if found:
            mean = sum(r.w * np.frombuffer(r.x, "<f4").astype(np.float64) for r in sorted(found, key=lambda r: r.x))
            model = Model.unpacked(mean / sum(r.w for r in found))
    return model


_tables: dict[bytes, tuple] = {}


def _tables_of(model: Model) -> tuple:
    """The model's tables, once a worker."""
    key = model.packed().tobytes()
    if key not in _tables:
        _tables.clear()
        _tables[key] = model.tables()
    return _tables[key]


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, model: Model) -> Iterator[pa.RecordBatch]:
    one, two, norm = _tables_of(model)
    whole = np.log10(lexicon.total + lexicon.docs + lexicon.distinct + (lexicon.docs > 0) + 1)
    names = ["kind", "h", "rid", "doc_id", "m", "n_tokens", "n_known", "base", "score"]
    for part, w in _batches(batches):
        n = part.num_rows
        kinds, at = lexicon.classes(w)
        doc, c, a, b = contexts(w.first, kinds)
        sums = lambda index, x: np.bincount(index, x, n)[:n]
        score = sums(doc, (one[a, c] + two[b, c] - norm[a, b]) / np.log(10))
        tokens = np.diff(w.first) + 1
        sent = at >= 0
        log_c = np.where(sent, np.log10((lexicon.counts[at] if len(lexicon.counts) else 0) + 1.0), 0)
        base = sums(w.doc, log_c) - tokens * whole + np.log10(lexicon.docs + 1)
        shaped = kinds >= OWN
        score += sums(w.doc[shaped], log_c[shaped] - lexicon.spread[kinds[shaped] - OWN])
        known = sums(w.doc, sent.astype(float)).astype(np.int64) + (lexicon.docs > 0)
        rid, ids = part.column("rid"), part.column("doc_id")
        zero = np.zeros(n, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(zero), rid, rid, ids, pa.array(zero), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], names)
        rare = np.flatnonzero(~sent)
        if len(rare):
            order = np.lexsort((w.hash[rare], w.doc[rare]))
            h, d = w.hash[rare][order], w.doc[rare][order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            m = np.diff([*first, len(h)]).astype(np.int32)
            k = len(first)
            no = lambda t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(h[first].view(np.int64)), rid.take(pa.array(d[first])), no(pa.int64()), pa.array(m), no(pa.int64()), no(pa.int64()), no(pa.float64()), no(pa.float64())], names)


def score(documents: DataFrame, fold: int = 7, held: int = 2, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10 probability of the whole text) of each row. Rows whose crc32 of the
    id modulo ``fold`` is ``held`` are held out of all learning."""
    prepare(documents.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = docs.filter(~crc).select(F.xxhash64("doc_id", "text").alias("place"), "text")
    counts = learn.select("text").mapInArrow(_counted, "h long, shape int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape")).checkpoint()
    words = counts.filter(F.col("shape") < SHAPES)
    # the frequent words: those of the highest counts, by sixteenths of a doubling, as far as SENT goes
    level = F.floor(F.log2("c") * 16).cast("int")
    cut, taken = 0, 0
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        taken += r.n
        if taken > SENT:
            cut = r.level + 1
            break
    top = [(r.h, r["shape"], r.c) for r in words.filter(level >= cut).select("h", "shape", "c").collect()]
    top.sort(key=lambda x: (-x[2], x[0]))
    totals = [tuple(r) for r in words.groupBy("shape").agg(F.sum("c"), F.count(F.lit(1))).collect()]
    docs_learned = counts.filter(F.col("shape") == SHAPES).agg(F.sum("c")).first()[0] or 0
    lexicon = Lexicon(top, totals).with_docs(docs_learned)
    model = fit(learn, lexicon, share)
    rare = words.select(F.lit(1).alias("kind"), "h", "c")
    named = docs.withColumn("rid", F.monotonically_increasing_id())
    parts = named.mapInArrow(partial(_scored, lexicon=lexicon, model=model), OUT).join(rare, ["kind", "h"], "left")
    more = F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    found = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0))).alias("n_known"), (F.max("base") + F.sum(more)).alias("base_score"), (F.max("score") + F.sum(more)).alias("score"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(True))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.total + docs_learned).cast("long").alias("train_tokens"), "base_score", "score")
