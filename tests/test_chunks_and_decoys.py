"""Chunked references, exact shuffles, dense units."""

import random
from collections import Counter
from itertools import permutations

from helixframe.operators import motifs, scans, simulate
from helixframe.sources import chunks
from pyspark.sql import functions as F


def test_windows_of_chunks_are_substrings(spark):
    g = random.Random(6)
    records = {"a": "".join(g.choices("ACGT", k=1000)), "b": "".join(g.choices("ACGT", k=37)), "c": "ACGT" * 5}
    lines = []
    for name, s in records.items():
        at = 0
        while at < len(s):
            n = g.choice([1, 7, 60, 200])
            lines.append((name, len(lines), s[at : at + n]))
            at += n
    lines += [("a", -1, None), ("b", -2, ""), ("d", 1, None)]
    g.shuffle(lines)
    table = spark.createDataFrame(lines, "record_id string, place long, bases string").repartition(3)
    sites = [(k, g.choice("abcd"), g.randrange(-3, 1010), g.choice(["A", "ac", "", "G"])) for k in range(300)]
    for size, before, length in ((16, 10, 25), (7, 3, 40), (5000, 2, 8)):
        made = chunks.chunked(table, size)
        assert {(r.record_id, r.chunk): r.bases for r in made.collect()} == {(n, k): s[k * size : (k + 1) * size] for n, s in records.items() for k in range(-(-len(s) // size))}
        got = chunks.windows(spark.createDataFrame(sites, "id long, record_id string, start long, ref string"), made, before, length, size).collect()
        assert len(got) == len(sites)
        by_id = {r.id: (r.window, r.fault) for r in got}
        for k, name, start, ref in sites:
            s, lo = records.get(name), start - before
            if s is None:
                want = (None, "no record")
            elif lo < 0 or lo + length > len(s):
                want = (None, "off the end")
            elif s[start : start + len(ref)] != ref.upper():
                want = (None, "reference differs")
            else:
                want = (s[lo : lo + length], None)
            assert by_id[k] == want


def test_all_shuffles_are_equally_likely():
    s = "AACABCBA"
    pairs = Counter(zip(s, s[1:], strict=False))
    walks = {"".join(p) for p in permutations(s) if p[0] == "A" and p[-1] == "A" and Counter(zip(p, p[1:], strict=False)) == pairs}
    draws = 6000
    seen = Counter(simulate.dinucleotide_shuffle(s, k) for k in range(draws))
    assert set(seen) == walks and len(walks) > 4
    # each within five standard deviations of its share
    share = draws / len(walks)
    assert all(abs(n - share) < 5 * share**0.5 for n in seen.values())


def test_long_shuffles_of_many_letters_end():
    g = random.Random(3)
    s = "".join(g.choices([chr(c) for c in range(200, 900)], k=10_000))
    t = simulate.dinucleotide_shuffle(s, "seed")
    assert t != s and Counter(zip(s, s[1:], strict=False)) == Counter(zip(t, t[1:], strict=False)) and (s[0], s[-1]) == (t[0], t[-1])


def test_decoy_p_is_that_of_a_loop(spark):
    g = random.Random(8)
    rows = [(k, "".join(g.choices("ACGT", k=30))) for k in range(12)] + [(50, "AC"), (51, None)]
    matrix = motifs.drawn_matrices(1, 2)
    d = spark.createDataFrame(rows, "id long, sequence string")
    drawn = simulate.decoys(d, "id", "sequence", 9, "x").withColumnRenamed("decoy", "sequence").cache()
    rated = lambda x: motifs.motif_endpoints(x, matrix).withColumn("v", F.col("potential")[0])
    got = {r.id: r.p for r in scans.empirical_p(rated(d.filter("sequence is not null")), rated(drawn), ["id"], "v").collect()}
    value = lambda s: motifs.endpoints([s], motifs.families(matrix), 1.0)[0, 0]
    of = {}
    for r in drawn.collect():
        of.setdefault(r.id, []).append(r.sequence)
    for k, s in rows[:-1]:
        assert len(of[k]) == 9
        assert abs(got[k] - (1 + sum(value(x) >= value(s) for x in of[k])) / 10) < 1e-12
    drawn.unpersist()


def test_units_are_dense_in_order(spark):
    groups = spark.createDataFrame([("b", 2), ("a", 3), ("c", 0), ("d", 1), ("e", None)], "k string, n long")
    got = scans.created(groups, ["k"], "n", {"level": F.lit(1.5)}).orderBy("unit").collect()
    assert [(r.unit, r.k, r.ordinal, r.level) for r in got] == [(0, "a", 0, 1.5), (1, "a", 1, 1.5), (2, "a", 2, 1.5), (3, "b", 0, 1.5), (4, "b", 1, 1.5), (5, "d", 0, 1.5)]
