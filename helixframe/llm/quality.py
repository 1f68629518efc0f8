"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. A passage is encoded by what
it says, hashed counts of its words and of the letters' trigrams in them, and by
how it is written: lengths, kinds of characters, repeated words. A linear layer
that is learned embeds both. Gated attention, learned from document labels alone,
weighs the passages, and the weighted sum of their hidden vectors gives the
score. Labels, language, source and id are no inputs. The model is trained in
numpy on at most ``sample`` labelled documents (those of the least hash), none
of them held out, one text an id and ``BAG`` evenly spread passages a text; so
what comes to the driver is bounded. Scores take every passage of every text.

Nulls: a null text is empty; an empty text is one passage of zeros. A null id
has no label and counts as held out. Ids that labels repeat take the mean label,
half and more count as 1; of different texts of an id one is learned from.
Without labels of both classes every score is the share of class 1 (0.5 without
any). Texts of any length are scored whole, in slices. Repeated rows are scored
each and alike; an empty table gives an empty result. Other columns are never
looked at, and ``keep_good`` returns them as they are, whatever their names.
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

PASSAGE = 64
HIDDEN = 16
#: Buckets of words and of trigrams; passages of a text that are learned from.
WORDS, LETTERS, BAG = 128, 128, 16
_U = np.uint64
#: Kinds of bytes: upper case, digit, sentence mark, other mark, beyond ASCII.
_KIND = np.zeros((5, 256))
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, [33, 44, 46, 58, 59, 63]] = 1
_KIND[3, [x for x in range(34, 127) if not chr(x).isalnum() and x not in (44, 46, 58, 59, 63)]] = 1
_KIND[4, 128:] = 1
STYLE = 14
FEATURES = STYLE + WORDS + LETTERS


def passages(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, features) of each passage, in order; each document has one."""
    n = len(w.first) - 1
    sizes = np.diff(w.first)
    count = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.arange(n), count)
    x = np.zeros((len(doc), FEATURES), np.float32)
    if not len(w.hash):
        return doc, x
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    of = first[w.doc] + (np.arange(len(w.hash)) - w.first[w.doc]) // PASSAGE
    total = len(doc)
    add = lambda values: np.bincount(of, values, total)
    words_in = np.maximum(add(np.ones(len(of))), 1)
    size = (w.end - w.start).astype(float)
    bytes_in = np.maximum(add(size), 1)
    per_word = []
    for kind in _KIND:
        flags = np.concatenate([[0], np.cumsum(kind[w.data])])
        per_word.append(flags[w.end] - flags[w.start])
    for k, v in enumerate(per_word):
        x[:, k] = add(v) / bytes_in
    mean = add(size) / words_in
    x[:, 5] = mean
    x[:, 6] = np.sqrt(np.maximum(0, add(size * size) / words_in - mean**2))
    x[:, 7] = add((per_word[2] + per_word[3]) == size) / words_in
    x[:, 8] = add(per_word[0] * 2 > size) / words_in
    x[:, 9] = add(per_word[1] * 2 > size) / words_in
    _, at = np.unique(w.hash + of.astype(np.uint64) * _U(0x9E3779B97F4A7C15), return_index=True)
    x[:, 10] = np.bincount(of[at], minlength=total) / words_in
    _, at = np.unique(w.hash + w.doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15), return_index=True)
    x[:, 11] = np.bincount(of[at], minlength=total) / words_in
    x[:, 12] = np.log1p(words_in)
    x[:, 13] = np.log1p(sizes[doc])
    table = np.bincount(of * WORDS + (tk.mix(w.hash) % _U(WORDS)).astype(np.int64), minlength=total * WORDS)
    x[:, STYLE : STYLE + WORDS] = np.sqrt(table.reshape(total, WORDS) / words_in[:, None])
    # trigrams inside words
    width = np.maximum(0, w.end - w.start - 2)
    at = np.repeat(w.start - np.cumsum(width) + width, width) + np.arange(width.sum())
    if len(at):
        low = tk._LOWER[w.data].astype(np.uint32)
        code = (low[at] * np.uint32(0x9E3779B1) + low[at + 1] * np.uint32(0x85EBCA77) + low[at + 2] * np.uint32(0xC2B2AE3D)) >> np.uint32(25)
        index = np.repeat(of, width) * LETTERS + code
        x[:, STYLE + WORDS :] = np.sqrt(np.bincount(index, minlength=total * LETTERS).reshape(total, LETTERS) / bytes_in[:, None])
    return doc, x


class Attention:
    """h = tanh(x W + w); a = softmax((tanh(h V) * sigmoid(h U)) t) over a bag;
    score = sigmoid((sum a h) c + b)."""

    def __init__(self, values: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, share: float, trained: bool):
        self.v, self.mean, self.scale, self.share, self.trained = values, mean, scale, share, trained

    def forward(self, bag: np.ndarray, x: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        v = self.v
        h = np.tanh(x @ v["W"] + v["w"])
        p, g = np.tanh(h @ v["V"]), 1 / (1 + np.exp(-np.clip(h @ v["U"], -30, 30)))
        s = (p * g) @ v["t"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        e = np.exp(s - top[bag])
        a = e / np.bincount(bag, e, bags)[bag]
        z = np.stack([np.bincount(bag, a * h[:, j], bags) for j in range(HIDDEN)], 1)
        y = 1 / (1 + np.exp(-np.clip(z @ v["c"] + v["b"], -30, 30)))
        return {"h": h, "p": p, "g": g, "a": a, "z": z, "y": y}

    def score(self, doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        if not self.trained:
            return np.full(n, self.share)
        return self.forward(doc, (x - self.mean) / self.scale, n)["y"]


def train(doc: np.ndarray, x: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 3e-4) -> Attention:
    """Adam on the log loss of batches of bags; doc is sorted."""
    share = float(label.mean()) if len(label) else 0.5
    g = np.random.default_rng(3)
    v = {"W": g.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "w": np.zeros(HIDDEN), "V": g.normal(0, 0.3, (HIDDEN, HIDDEN)), "U": g.normal(0, 0.3, (HIDDEN, HIDDEN)), "t": g.normal(0, 0.3, HIDDEN), "c": g.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if len(x):
        one, two = np.zeros(FEATURES), np.zeros(FEATURES)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096].astype(np.float64)
            one += part.sum(0)
            two += (part * part).sum(0)
        mean = one / len(x)
        scale = np.sqrt(np.maximum(0, two / len(x) - mean**2)) + 1e-2
    model = Attention(v, mean, scale, share, len(label) > 0 and 0 < share < 1)
    if not model.trained:
        return model
    every = x.astype(np.float32)
    every -= mean.astype(np.float32)
    every /= scale.astype(np.float32)
    cuts = np.searchsorted(doc, np.arange(len(label) + 1))
    one, two = ({k: np.zeros_like(a) for k, a in v.items()} for _ in range(2))
    total, step = epochs * -(-len(label) // batch), 0
    for _ in range(epochs):
        order = g.permutation(len(label))
        for at in range(0, len(order), batch):
            step += 1
            some = order[at : at + batch]
            x = np.concatenate([every[cuts[d] : cuts[d + 1]] for d in some])
            bag, n, y = np.repeat(np.arange(len(some)), cuts[some + 1] - cuts[some]), len(some), label[some]
            f = model.forward(bag, x, n)
            dy = (f["y"] - y) / n
            d = {"c": f["z"].T @ dy, "b": np.array([dy.sum()])}
            dz = dy[:, None] * v["c"]
            da = np.einsum("ij,ij->i", dz[bag], f["h"])
            ds = f["a"] * (da - np.bincount(bag, f["a"] * da, n)[bag])
            dpg = ds[:, None] * v["t"]
            d["t"] = (f["p"] * f["g"]).T @ ds
            dp, dg = dpg * f["g"] * (1 - f["p"] ** 2), dpg * f["p"] * f["g"] * (1 - f["g"])
            d["V"], d["U"] = f["h"].T @ dp, f["h"].T @ dg
            dh = (f["a"][:, None] * dz[bag] + dp @ v["V"].T + dg @ v["U"].T) * (1 - f["h"] ** 2)
            d["W"], d["w"] = x.T @ dh, dh.sum(0)
            now = rate * (1 - step / (total + 1))
            for k in v:
                grad = d[k] + decay * v[k]
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad**2
                v[k] = v[k] - now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, x): at most BAG passages of each text, evenly spread."""
    for batch in batches:
        for part in tk.slices(batch, "text"):
            doc, x = passages(tk.words(part.column("text")))
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            spread = lambda a, b: np.unique(np.linspace(a, b - 1, min(BAG, b - a)).astype(np.int64))
            rows = [x[spread(a, b)].astype("<f2").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])


def fit(documents: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, sample: int = 4000) -> Attention:
    """Learn from at most ``sample`` labelled documents that aren't held out."""
    prepare(documents.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(crc)
    known = known.groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y double, x binary")
    rows = found.groupBy("doc_id").agg(F.max(F.struct("y", "x")).alias("r")).select("doc_id", "r.y", "r.x").collect()
    rows.sort(key=lambda r: r.doc_id)
    sizes, label = [len(r.x) // (2 * FEATURES) for r in rows], np.array([r.y for r in rows])
    x = np.frombuffer(b"".join([r.x for r in rows]), "<f2").reshape(-1, FEATURES)
    del rows
    return train(np.repeat(np.arange(len(sizes)), sizes), x, label)


def _score(batch: pa.RecordBatch, model: Attention) -> np.ndarray:
    scores = [np.zeros(0)]
    for part in tk.slices(batch, "text"):
        doc, x = passages(tk.words(part.column("text")))
        scores.append(model.score(doc, x, part.num_rows))
    return np.concatenate(scores)


def _scores(batches: Iterator[pa.RecordBatch], model: Attention) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_score(batch, model))], ["doc_id", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model: Attention, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_score(batch, model) >= threshold)).select(["row"])


def scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 4, held: int = 2, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents."""
    model = fit(documents, labels, fold, held, sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(partial(_scores, model=model), "doc_id long, score double")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(True))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """documents without those that score below ``threshold``."""
    model = fit(documents, labels, **options)
    keyed = documents.select(F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = keyed.schema["row"].dataType.simpleString()
    return keyed.mapInArrow(partial(_kept, model=model, threshold=threshold), f"row {kind}").select("row.*")
