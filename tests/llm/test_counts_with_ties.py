"""Token counts against the library where many scores are equal."""

import random

import pytest
from helixframe.llm import bpe, unigram
from helixframe.llm.queries import tokenizer_file


def test_random_texts_and_ties(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_file("piece_bpe_32k.model")
    lib = Tokenizer(models.Unigram(unigram.model_pieces(path), 0, False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    g = random.Random(3)
    draw = lambda: "".join(g.choice([*"aaabbbee  ", "ab", "abab", "ing", "▁", "é", "日", "\U0001f600", chr(g.randrange(0x20, 0x3000))]) for _ in range(g.randrange(0, 60)))
    texts = [draw() for _ in range(300)] + ["a" * n for n in (1, 63, 64, 65, 129, 1000)] + ["ab" * 400, "  a  ", "word " * 3000]
    got = {r.doc_id: r[2] for r in unigram.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert [got[k] for k in range(len(texts))] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("size", [300, 5000])
def test_long_words_of_both_ways(size):
    path = tokenizer_file("word_bpe_49k.json")
    g = random.Random(size)
    word = "".join(g.choice("abcdeéß日") for _ in range(size))
    walk, merging = bpe.Encoder(path), bpe.Encoder(path, walk=False)
    want = walk.vocabulary.library.encode(word, add_special_tokens=False).ids
    for e in (walk, merging):
        assert list(memoryview(e.ids(e.cut([word])[0])).cast("I")) == want
