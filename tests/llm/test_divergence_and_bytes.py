"""Source divergence by brute force; byte-level BPE against the library."""

import base64
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from helixframe.llm import byte_bpe, divergence
from helixframe.llm.queries import tokenizer_file, tokenizer_pattern

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})


def awkward():
    g = random.Random(5)
    letters = "aàéßœñЖя語𝒳👍🏽ª²½٣   \x1c\x1f\x85\t\n\r'|.,-_0123456789xyz"
    texts = ["".join(g.choices(letters, k=g.randrange(60))) for _ in range(300)]
    texts += ["", None, " ", "\n\n \n x", "don't I'LL we've 'd", "a" * 3000, "ab" * 40_000, "é" * 5000, "-" * 700, "the quick " * 3000, "<|endoftext|>"]
    return texts


def test_byte_bpe_is_the_library(spark, library):
    texts = awkward()
    rows = [(i if i % 40 else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, bucket int").repartition(3)
    got = byte_bpe.token_digests(table, RANKS, tokenizer_pattern())
    assert got.schema == byte_bpe.token_digests(table.coalesce(1), RANKS, tokenizer_pattern(), stable=True).schema
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert byte_bpe.token_ids(table.limit(0), RANKS, tokenizer_pattern()).count() == 0


def test_words_over_the_limit_merge_alike(library):
    table = byte_bpe.Ranks(RANKS)
    g = random.Random(1)
    for n in (2, 3, 17, 200, 256, 257, 400):
        for alphabet in ("ab", "aeiou tn", "abcdefghijklmnopqrstuvwxyz", "\x00\xff\x80é"):
            word = "".join(g.choices(alphabet, k=n)).encode()
            want = library._core_bpe.encode_single_piece(word)
            assert [*memoryview(table.encode_bytes({word})[word]).cast("I")] == want
            if word not in table.ids:
                assert [*memoryview(table.merge_long(word)).cast("I")] == want


def test_decoding_joins_the_token_table(spark):
    ids = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.data and bytes(r.data) for r in byte_bpe.decoded(ids, RANKS).collect()} == {1: b"Hello world", 2: b"", 3: None}
    with pytest.raises(Exception, match="no token has"):
        byte_bpe.decoded(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()


def brute_audit(rows, least, top):
    term = re.compile(divergence.TERM)
    docs = [(lang or "", source or "", term.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        n = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                n[s].update(w for w in words if w in kept)
        whole = sum(n.values(), Counter())
        p = lambda c, t, kept=kept: 1 + int(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(kept)))
        for s in n:
            pairs = [(-sum(abs(p(n[s], t) - p(n[o], t)) for t in kept), o.encode()) for o in n if o != s]
            terms = [(p(whole, t) - p(n[s], t), t.encode()) for t in kept if n[s][t] and p(n[s], t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit_is_brute_force(spark, monkeypatch):
    g = random.Random(3)
    words = ["alpha", "Beta", "gamma", "Ünit", "ünit", "語", "x", "delta", "rare", "ÉTÉ", "z"]
    rows = [(g.choice(["en", "de", None, ""]), g.choice(["s0", "s0", "s0", "s1", "S2", None, "é"]), " ".join(g.choices(words, k=g.randrange(30))) + g.choice([".", "1", ""])) for _ in range(250)]
    rows += [("en", "none", None), ("en", "none2", ""), ("lone", "s", "a word"), ("two", "a", "q"), ("two", "b", None)] + rows[:5]
    rows += [("en", "long", "alpha beta " * 50_000)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n long, term long").repartition(5)
    for held, block in ((divergence.HELD, divergence.BLOCK), (3, 2)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "BLOCK", block)
        assert sorted(map(tuple, divergence.audit(table, least_docs=4, top=3).collect())) == brute_audit(rows, 4, 3)
    assert divergence.audit(table.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 3 * 10**17
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big + 1), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 1 + 35)
