"""BPE encoding and decoding over a trie of distinct words.

A BPE encoding is valid exactly when each pair of neighbours is what the merges
make of the pair's own symbols. So the encoding of a prefix is known from its
last token alone: it is the one token that ends the prefix and fits behind the
last token of what comes before it. Distinct words go into a trie of symbols;
a depth-first walk keeps the last token of every prefix on the path, so shared
prefixes are encoded once. A word's final symbol carries the end-of-word mark
and hangs from the path as a leaf.

Texts fall apart at ASCII white space, which no token spans; the pieces' ids
are kept in a table of bounded size for each task.

Nulls: a null text is empty and has no ids; a null id is carried along. Texts
are encoded whole, however long. Merges have ranks of their own, so there are no
ties. Repeated rows each give a row; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Most words and pieces that a task keeps ids of.
KEPT = 400_000
#: Words above so many bytes are never merged pair by pair.
LONG = 256
#: White space of Unicode that ``str.split`` knows and ASCII's six don't.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECE = re.compile("[^ \t\n\r\x0b\x0c]+")
#: Texts of these characters are their own normal form but for case and white
#: space, and fall into words by rules that need no Unicode tables.
_SIMPLE = re.compile("[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_SIMPLE_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \x09-\x0da-z0-9\xdf-\xf6\xf8-\xff]+")
_NONE = np.int32(2**31 - 1)


def pieces(text: str) -> list[str]:
    """Runs of text without ASCII white space."""
    return _PIECE.findall(text) if _OTHER_SPACE.search(text) else text.split()


def byte_alphabet() -> dict[int, int]:
    """Of byte-level BPE: printable characters stand for their own byte, the
    other bytes follow from 256 on. By character, the byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {256 + k: b for k, b in enumerate(rest)}


class Vocabulary:
    """A BPE model with an end-of-word suffix, from a tokenizers JSON file.

    Words are byte strings, held as text of one character a byte."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.bytes_of = byte_alphabet()
        #: Tokens by their bytes, inside a word and at its end.
        self.inner = {s.translate(self.bytes_of): i for s, i in vocab.items() if not s.endswith(mark)}
        self.final = {s[: -len(mark)].translate(self.bytes_of): i for s, i in vocab.items() if s.endswith(mark) and s != mark}
        self.length = {i: len(s) for t in (self.inner, self.final) for s, i in t.items()}
        self.longest = max(self.length.values())
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), r)
            self.parts.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.fits = lru_cache(1 << 19)(self._fits)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.array(list(self.rank.values()), np.int32)[order]
        self._made = np.zeros(len(model["merges"]), np.int32)
        for out, (r, _, _) in self.parts.items():
            self._made[r] = out
        self._byte = np.array([[t[chr(b)] for b in range(256)] for t in (self.inner, self.final)], np.int32)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as neighbours. Back in time, the later
        merge of the two goes; the pair that then met must not have merged
        sooner. Of equal merges the left one is first."""
        limit = 1 << 60
        while True:
            r = self.rank.get((a, b))
            if r is not None and 2 * r < limit:
                return False
            ra, rb = self.parts.get(a), self.parts.get(b)
            if rb is not None and (ra is None or rb[0] >= ra[0]):
                limit, b = 2 * rb[0] + 1, rb[1]
            elif ra is not None:
                limit, a = 2 * ra[0], ra[2]
            else:
                return True

    def _last(self, word: str, end: int, last: list[int], table: dict[str, int]) -> int:
        """The last token of word[:end], given those of all shorter prefixes."""
        whole = table.get(word[:end])
        if whole is not None:
            return whole
        fits = self.fits
        for start in range(max(1, end - self.longest), end):
            token = table.get(word[start:end])
            if token is not None and fits(last[start], token):
                return token
        raise ValueError(f"no encoding of {word!r}")

    def encode_words(self, distinct: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words, by a walk through their trie. Sorted words are the trie
        in depth-first order: what a word shares with the one before it is the
        part of the path that stays."""
        out: dict[str, tuple[int, ...]] = {}
        path, last = "", [-1]
        length = self.length
        for word in sorted(distinct):
            body = len(word) - 1
            same, top = 0, min(len(path), body)
            while same < top and path[same] == word[same]:
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, body + 1):
                last.append(self._last(word, end, last, self.inner))
            path = word[:body]
            token = self._last(word, body + 1, last, self.final)
            tokens, at = [token], body + 1 - length[token]
            while at > 0:
                token = last[at]
                tokens.append(token)
                at -= length[token]
            out[word] = tuple(reversed(tokens))
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], _NONE)

    def merge_words(self, distinct: set[str]) -> dict[str, bytes]:
        """The same ids by plain merging, of many words at once: each round
        merges the best pair of every word."""
        out: dict[str, bytes] = {}
        ordered = sorted(distinct, key=len)
        at = 0
        while at < len(ordered):
            to = at + 1
            while to < len(ordered) and to - at < 1 << 15 and len(ordered[to]) * (to - at) < 1 << 20:
                to += 1
            group, at = ordered[at:to], to
            sizes = np.array([len(w) for w in group])
            wide = int(sizes[-1])
            ids = np.full((len(group), wide + 1), -1, np.int32)
            flat = np.frombuffer("".join(group).encode("latin-1"), np.uint8)
            row = np.repeat(np.arange(len(group)), sizes)
            col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids[row, col] = self._byte[0][flat]
            ends = np.cumsum(sizes) - 1
            ids[np.arange(len(group)), sizes - 1] = self._byte[1][flat[ends]]
            ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(group))
            while len(live):
                k = ranks[live].argmin(1)
                best = ranks[live, k]
                go = best < _NONE
                live, k, best = live[go], k[go], best[go]
                if not len(live):
                    break
                ids[live, k] = self._made[best]
                step = np.arange(wide)[None, :]
                here = ids[live]
                here[:, :-1] = np.where(step > k[:, None], here[:, 1:], here[:, :-1])
                here[:, -1] = -1
                ids[live] = here
                rest = ranks[live]
                rest[:, :-1] = np.where(step[:, :-1] > k[:, None], rest[:, 1:], rest[:, :-1])
                rest[:, -1] = _NONE
                n = np.arange(len(live))
                rest[n, k] = self._pair_ranks(here[n, k], here[n, k + 1])
                b = np.flatnonzero(k > 0)
                rest[b, k[b] - 1] = self._pair_ranks(here[b, k[b] - 1], here[b, k[b]])
                ranks[live] = rest
            ends = np.cumsum((ids >= 0).sum(1)) * 4
            flat = ids[ids >= 0].astype("<u4").tobytes()
            out.update((w, flat[a:b]) for w, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        return out

    def words_of(self, wanted: list[str]) -> list[list[str | int]]:
        """The normal words of each piece; special tokens are ids."""
        out: list[list[str | int]] = [[] for _ in wanted]
        texts: list[tuple[int, str]] = []
        for k, piece in enumerate(wanted):
            if "<|" in piece:
                for x in self.split_special.split(piece):
                    if x in self.special:
                        out[k].append(self.special[x])
                    elif x:
                        out[k] += self._library_words([x])[0]
            else:
                texts.append((k, piece))
        for (k, _), found in zip(texts, self._library_words([x for _, x in texts]), strict=True):
            out[k] = found
        return out

    def _library_words(self, texts: list[str]) -> list[list[str]]:
        normal = [self.library.normalizer.normalize_str(x) for x in texts]
        spans = self.library.pre_tokenizer.pre_tokenize_str(" ".join(normal))
        ends = np.cumsum([len(x) + 1 for x in normal])
        out: list[list[str]] = [[] for _ in texts]
        for k, (w, _) in zip(np.searchsorted(ends, [s for _, (s, _) in spans], "right").tolist(), spans, strict=True):
            out[k].append(w.translate(self.bytes_of).encode("latin-1").decode())
        return out


class Encoder:
    """Ids of whole texts, word by word or piece by piece, with a bounded table
    of both. ``walk``: through the trie of new words; else by plain merging."""

    def __init__(self, path: str, walk: bool = True):
        self.vocabulary = Vocabulary(path)
        self.walk = walk
        self.table: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def _learn(self, words: set[str], parts: list[str]) -> None:
        v = self.vocabulary
        found = v.words_of(parts)
        words |= {w for f in found for w in f if isinstance(w, str) and w not in self.table}
        as_bytes = {w if w.isascii() else w.encode().decode("latin-1"): w for w in words}
        if self.walk:
            strings = v.strings
            for b, ids in v.encode_words(set(as_bytes)).items():
                self.table[as_bytes[b]] = np.array(ids, "<u4").tobytes()
                self.decoded[as_bytes[b]] = " ".join([strings[i] for i in ids])
        else:
            # merging is quadratic in a word's length, the walk linear
            long = {b for b in as_bytes if len(b) > LONG}
            self.table.update((as_bytes[b], np.array(ids, "<u4").tobytes()) for b, ids in v.encode_words(long).items())
            self.table.update((as_bytes[b], ids) for b, ids in v.merge_words(set(as_bytes) - long).items())
        for piece, f in zip(parts, found, strict=True):
            self.table[piece] = b"".join([self.table[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in f])
            if self.walk:
                self.decoded[piece] = " ".join([self.decoded[w] if isinstance(w, str) else v.strings[w] for w in f])

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The words, or else the pieces, of texts; the table then holds all."""
        split, words, parts = [], set(), set()
        for t in texts:
            simple = "<|" not in t and _SIMPLE.fullmatch(t)
            split.append(_SIMPLE_WORD.findall(t.lower()) if simple else pieces(t))
            (words if simple else parts).update(split[-1])
        table = self.table
        new, rest = {w for w in words if w not in table}, [p for p in parts if p not in table and p not in words]
        if len(table) + len(new) + len(rest) > KEPT:
            self.table = {p: table[p] for both in (words, parts) for p in both if p in table}
            self.decoded = {p: self.decoded[p] for p in self.table} if self.walk else {}
        if new or rest:
            self._learn(new, rest)
        return split

    def ids(self, split: list[str]) -> bytes:
        return b"".join(map(self.table.__getitem__, split))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, walk: bool = True) -> Encoder:
    """One encoder a worker: vocabularies take a second to read."""
    if (path, walk) not in _encoders:
        _encoders[path, walk] = Encoder(path, walk)
    return _encoders[path, walk]


def text_runs(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts) of runs of about ``limit`` characters at most."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > limit:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text."""
    e = encoder(path)
    return [np.frombuffer(e.ids(s), "<u4") for _, run in text_runs(texts) for s in e.cut(run)]


def decode(path: str, ids: list[int]) -> str:
    """As the library does without a decoder: tokens with spaces between."""
    strings = encoder(path).vocabulary.strings
    return " ".join(strings[int(i)] for i in ids if int(i) in strings)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:
        counts, first, second = [], [], []
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for _, run in text_runs(texts):
            for split in e.cut(run):
                ids = e.ids(split)
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(" ".join(d for d in map(e.decoded.__getitem__, split) if d).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = encode(path, [t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.astype(np.int64) for i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])


def _texts(documents: DataFrame) -> DataFrame:
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_ids(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text."""
    return _texts(documents).mapInArrow(partial(_ids, path=path), "doc_id long, ids array<long>")


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian, 32 bits) and of the
    decoded text."""
    return _texts(documents).mapInArrow(partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
