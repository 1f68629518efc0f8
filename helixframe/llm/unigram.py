"""Token counts of a unigram model: Viterbi that keeps scores and counts alone.

An Aho-Corasick automaton gives all vocabulary pieces that end at each place of
a chunk; the best score and its number of pieces go forward, no path is stored.
Ties follow the tokenizer: of equal scores the piece that begins first stays, an
unknown character costs ten less than the worst piece where no piece is exactly
that character, and unknowns in a row are one token. Chunks begin at spaces,
which are written as U+2581, as is the text's beginning.

The registered query has no public unigram model to read: it takes the pieces
of a BPE model, whose scores are the negatives of their ranks, as a unigram
vocabulary.

Nulls: a null text is empty and has no tokens; a null id is carried along. Texts
are counted whole, however long. Repeated rows each give a row; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_runs
from .common import prepare

SPACE = "▁"
#: Most chunks that a task keeps counts of, and their greatest length.
KEPT, LONGEST = 400_000, 64


def model_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's normal pieces, unknown first."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    unknown = p.unk_id()
    plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return [(p.id_to_piece(unknown), 0.0), *((p.id_to_piece(i), p.get_score(i)) for i in plain)]


class Counter:
    """Counts tokens of chunks under (piece, score) pairs; the first is unknown."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.table: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        n = len(text)
        best, count, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text):
            found[last + 1].append(match)
        for end in range(1, n + 1):
            top, from_ = None, 0
            for length, score in sorted(found[end], reverse=True):
                total = score + best[end - length]
                if top is None or total > top:
                    top, from_ = total, end - length
            unknown = False
            if text[end - 1] not in self.single:
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    top, from_, unknown = total, end - 1, True
            best[end], fused[end] = top, unknown
            count[end] = count[from_] + (0 if unknown and fused[from_] else 1)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        table, total = self.table, 0
        for part in text[text.startswith(SPACE) :].split(SPACE):
            n = table.get(part)
            if n is None:
                n = self.chunk(SPACE + part)
                if len(part) <= LONGEST:
                    if len(table) >= KEPT:
                        table.clear()
                    table[part] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(model_pieces(path))
    return _counters[path]


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n = [c.text(t) for _, run in text_runs([t or "" for t in texts]) for t in run]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_tokens"])


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars (of the text itself) and n_tokens of each whole text."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(partial(_counts, path=path), "doc_id long, n_chars long, n_tokens long")
