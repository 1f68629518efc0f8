"""The Jaccard join on groups of near copies, against brute force."""

import random

import numpy as np
import pytest
from helixframe.llm import ngram_jaccard

WORDS = [f"w{k}" for k in range(3000)]


def texts(seed, groups):
    """Groups of (copies, words changed in each) of texts of 120 words."""
    g, out = random.Random(seed), []
    for copies, changes in groups:
        base = [g.choice(WORDS) for _ in range(120)]
        for _ in range(copies):
            w = list(base)
            for p in g.sample(range(120), g.randint(*changes)):
                w[p] = g.choice(WORDS)
            out.append(" ".join(w))
    g.shuffle(out)
    return out


def components(rows, n, percent):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(rows))]


@pytest.mark.parametrize(("n", "percent", "changes"), [(5, 80, (2, 6)), (3, 90, (1, 4))])
@pytest.mark.parametrize("unit", [ngram_jaccard.UNIT, 3000])
def test_groups_about_the_threshold(spark, n, percent, changes, unit):
    rows = texts(n, [(260, changes), (40, (1, 9)), (5, (0, 2)), (30, (30, 60))])
    want = components(rows, n, percent)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(d, n, percent, unit).collect()}
    assert [got[k] for k in range(len(rows))] == want and len(set(want)) > 40


def test_texts_of_one_id_share_a_component(spark):
    a, b, c = texts(9, [(1, (0, 0)), (1, (0, 0)), (1, (0, 0))])
    d = spark.createDataFrame([(1, a), (7, a), (7, b), (9, b), (11, c), (12, ""), (13, None), (None, c)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_components(d, 5, 80).collect()), key=repr)
    assert got == sorted([(1, 116, 1), (7, 116, 1), (7, 116, 1), (9, 116, 1), (11, 116, 11), (12, 0, 12), (13, 0, 13), (None, 116, None)], key=repr)


def test_every_scheme_finds_linked_sets():
    g = np.random.default_rng(3)
    used = set()
    for size in [2, 5, 9, 14, 20, 30, 45, 60, 90, 150, 400]:
        for percent in (70, 80, 90):
            for _ in range(6):
                a = np.unique(g.integers(0, 2**63, size, dtype=np.uint64))
                gone = size * (100 - percent) // 100
                b = np.unique(np.concatenate([a[gone:], g.integers(0, 2**63, 0, dtype=np.uint64)]))
                for step in (0, 1):
                    used.add(ngram_jaccard.scheme(int(ngram_jaccard.cut([a], percent, step).most[0]))[1])
                both = [ngram_jaccard.tagged([a, b], percent, step) for step in (0, 1)]
                of, sig = (np.concatenate([x[k] for x in both]) for k in (0, 1))
                common = set(sig[of == 0]) & set(sig[of == 1])
                if gone:
                    assert common
                    # under one of the tags as many are shared as the count asks for
                    assert any(sum(s in common for s in x[1][x[0] == 0]) >= x[2][0] for x in both)
    assert used == {2, 4, 6}


def test_shared_signatures_are_counted_once():
    # (sig, name, least): groups 5 (two names), 7 (one, twice), 9 (known), 11 (one)
    rows = [(10, 2, 0), (10, 4, 0), (14, 6, 0), (14, 6, 0), (18, 8, 0), (19, 8, 0), (22, 12, 0), (25, 12, 3), (25, 12, 3)]
    for order in (rows, rows[::-1]):
        sig, name, least = (np.array(x) for x in zip(*order, strict=True))
        names, count = ngram_jaccard.shared_count(sig.astype(np.uint64), name.astype(np.uint64), least)
        assert dict(zip(names.tolist(), count.tolist(), strict=True)) == {2: 1, 4: 1, 8: 1, 12: -3}
    # of a group of this chunk, one row keeps the signature and all know
    met = ngram_jaccard._met(np.array([8, 8, 8, 20], np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert sorted(x & np.uint64(1) for x in met) == [0, 1, 1, 1] and sum(x >> np.uint64(1) == 4 for x in met) == 1


def test_counting_a_bucket_holds_little():
    import tracemalloc

    rng = np.random.default_rng(5)
    sig, name = rng.integers(0, 1 << 63, ngram_jaccard.BUCKET, np.uint64), rng.integers(0, 1 << 16, ngram_jaccard.BUCKET).astype(np.uint64)
    sig[1::2], name[1::2] = sig[::2] ^ np.uint64(1), name[::2] + np.uint64(1)
    least = np.zeros(ngram_jaccard.BUCKET, np.int64)
    least[::512] = 3
    tracemalloc.start()
    names, count = ngram_jaccard.shared_count(sig, name, least)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6
    want = dict.fromkeys(names.tolist(), 0)
    for n, m in zip(name.tolist(), least.tolist(), strict=True):
        want[n] += -m if m else 1
    assert want == dict(zip(names.tolist(), count.tolist(), strict=True))
