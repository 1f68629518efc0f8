"""Inverse design, second sites and graphs of records against plain loops."""

import hashlib
import random
from itertools import combinations

from helixframe.operators import inverse, lineage


def response(ratio, signal):
    return ratio * signal / (1 + ratio * signal)


def test_edit_sets_are_the_best_of_all(spark):
    g = random.Random(4)
    edits = [(locus, k, g.randrange(4), g.choice([0.1, 0.5, 1.5, 2.0, 3.0, g.uniform(0.2, 4)])) for locus in "abcdef" for k in range(14)]
    edits += [("a", 50, 1, 0.0), ("a", 51, 2, None)]
    loci = [("a", 0.3, True), ("b", 0.08, True), ("c", 4.0, False), ("d", 3.0, True), ("e", 1.2, False), ("f", 0.0001, True)]
    table = spark.createDataFrame([(*e, 0) for e in edits], "locus string, id long, place int, ratio double, gain int")
    got = inverse.edit_sets(table, spark.createDataFrame(loci, "locus string, signal double, wanted boolean"), response, 0.5, 2, 3).collect()
    want = []
    for locus, signal, wanted in loci:
        if (response(1.0, signal) > 0.5) == wanted:
            continue
        mine = [(k, p, r) for x, k, p, r in edits if x == locus and r]
        for size in (1, 2):
            sets = []
            for s in combinations(mine, size):
                if len({p for _, p, _ in s}) == size:
                    ratio = s[0][2] * (s[1][2] if size == 2 else 1)
                    change = round(response(ratio, signal) - response(1.0, signal), 9)
                    if (response(ratio, signal) > 0.5) == wanted:
                        sets.append((-change if wanted else change, sorted(k for k, _, _ in s), change))
            if sets:
                want += [(locus, size, ids, round(change, 8), n + 1) for n, (_, ids, change) in enumerate(sorted(sets)[:3])]
                break
    assert sorted((r.locus, r["size"], r.ids, round(r.change, 8), r["rank"]) for r in got) == sorted(want)
    assert {w[1] for w in want} == {1, 2} and not {w[0] for w in want} & {"d", "f"}
    rated = inverse.compiled_edits(spark.createDataFrame(got), response, 0.5, 25, "s", 0.4).collect()
    assert len(rated) == len(got) and sum(r.best for r in rated) == len({r.locus for r in got})
    for r in rated:
        assert r.best == ((-r.probability, r["rank"]) == min((-x.probability, x["rank"]) for x in rated if x.locus == r.locus))


def test_three_edits_where_two_do_not_reach(spark):
    edits = spark.createDataFrame([("x", k, k, 1.0 + k / 10) for k in range(12)], "locus string, id long, place int, ratio double")
    loci = spark.createDataFrame([("x", 0.15, True)], "locus string, signal double, wanted boolean")
    got = inverse.edit_sets(edits, loci, response, 0.5, 3, 1).collect()
    assert [(r["size"], r.ids) for r in got] == [(3, [9, 10, 11])]
    assert inverse.edit_sets(edits.limit(0), loci, response, 0.5).count() == 0


def test_nearest_products_are_the_nearest(spark):
    g = random.Random(2)
    first = [(g.choice("hhhhab"), k, g.choice([0.5, 0.25, 2.0, g.uniform(0.1, 9)])) for k in range(300)] + [("h", 900, 0.0), ("h", 901, None)]
    second = [(x, k, r) for x, k, r in first if k % 3 == 0] + [("h", 7, 2.0), ("h", 7, 2.0)]
    kind = "locus string, id long, ratio double"
    for target in (1.0, 2.5):
        got = {(r.locus, r.id): [] for r in inverse.nearest_products(spark.createDataFrame(first, kind), spark.createDataFrame(second, kind), 3, target).collect()}
        for r in sorted(inverse.nearest_products(spark.createDataFrame(first, kind), spark.createDataFrame(second, kind), 3, target).collect(), key=lambda r: r["rank"]):
            got[r.locus, r.id].append((r.gap, r.other_id))
        for locus, k, ratio in first:
            if ratio:
                all_ = sorted({(abs(ratio * v - target), v, o) for x, o, v in second if x == locus and v and o != k})[:3]
                assert got.get((locus, k), []) == [(gap, o) for gap, _, o in all_]


def test_levels_and_circles(spark):
    # 1-2 a circle of two; 3-4-5-6 one of four that also reaches it; 7 and 8 below; 10-20 a chain with a shortcut
    edges = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 6), (6, 3), (4, 1), (7, 3), (8, 7), (9, 9), (None, 1), (1, None)]
    edges += [(k, k + 1) for k in range(10, 20)] + [(10, 20), (12, 18)] * 2
    nodes = spark.createDataFrame([(k,) for k in range(1, 22)], "id long")
    got = {r.node: (r.level, r.above, r.fault) for r in lineage.levels(nodes, "id", spark.createDataFrame(edges, "child long, parent long"), "child", "parent").collect()}
    want = {k: (None, None, "cycle") for k in (1, 2, 3, 4, 5, 6, 9)} | {k: (None, None, "below a cycle") for k in (7, 8)}
    want |= {k: (20 - k, 20 - k, None) for k in range(10, 21)} | {21: (0, 0, None)}
    assert got == want


def test_replay_names_each_fault_once(spark):
    sha = lambda payload, parts: hashlib.sha256(f"{payload}\n{','.join(parts)}".encode()).hexdigest()
    payload = {k: f"p{k}" for k in "abcdefghijkl"}
    refs = {"b": "a", "c": "ab", "d": "c", "e": "a", "f": "e", "h": "g", "g": "h", "i": "h", "j": "xa", "k": "j", "l": ""}
    digest = {}
    for k in "abcdefl":
        if k in payload and all(x in digest for x in refs.get(k, "")):
            digest[k] = sha(payload[k], [digest[x] for x in refs.get(k, "")])
    stated = {k: digest.get(k, "0") for k in payload}
    digest_now = dict(digest)
    payload["b"] = "changed after it was sealed"
    stated["e"] = "f" * 64
    stated["l"] = None
    for k in "bcd":
        digest_now[k] = sha(payload[k], [digest_now[x] for x in refs[k]])
    a = spark.createDataFrame([(k, v, stated[k], "x") for k, v in payload.items()], "id string, payload string, stated string, level string")
    r = spark.createDataFrame([(k, x) for k, v in refs.items() for x in v] * 2, "id string, ref string")
    got = {x.id: (x.level, x.digest, x.fault) for x in lineage.replayed(a, r).collect()}
    assert {k: v[2] for k, v in got.items() if v[2]} == {"b": "stated digest", "e": "stated digest", "l": "stated digest", "g": "cycle", "h": "cycle", "i": "below a fault", "j": "missing reference", "k": "below a fault"}
    assert {k: v[1] for k, v in got.items() if v[1]} == digest_now
    assert [got[k][0] for k in "abcdefl"] == [0, 1, 2, 3, 1, 2, 0]


def test_replay_writes_what_is_known_once(spark, monkeypatch):
    # 1,000 leaves below a chain of four: what is known may not be written again each round
    written = []

    def counted(f):
        def write(df):
            written.append((out := f(df)).count())
            return out

        return write

    monkeypatch.setattr(lineage, "stored", counted(lineage.stored))
    monkeypatch.setattr(lineage, "checkpointed", counted(lineage.checkpointed))
    chain = [("c0", f"leaf{k}") for k in range(1000)] + [(f"c{k + 1}", f"c{k}") for k in range(4)]
    ids = [f"leaf{k}" for k in range(1000)] + [f"c{k}" for k in range(5)]
    a = spark.createDataFrame([(k, k, None) for k in ids], "id string, payload string, stated string")
    out = lineage.replayed(a, spark.createDataFrame(chain, "id string, ref string")).collect()
    assert len(out) == 1005 and max(r.level for r in out) == 5 and all(r.digest for r in out)
    assert sum(written) < 2000


def test_records_compile_to_numbered_units(spark):
    def attributes(**tags):
        return [{"tag": k, "values": v} for k, v in tags.items()]

    rows = [("gene", attributes(ID=["g"])), ("mRNA", attributes(ID=["t1"], Parent=["g"])), ("mRNA", attributes(ID=["t2"], Parent=["g"]))]
    rows += [("exon", attributes(ID=["e"], Parent=["t1", "t2"]))] * 2 + [("exon", attributes(Parent=["t1"])), ("protein", attributes(ID=["p"], Derives_from=["t2"], Parent=["g"]))]
    rows += [("x", attributes(ID=["a"], Parent=["b"])), ("x", attributes(ID=["b"], Derives_from=["a"])), ("x", attributes(ID=["c"], Parent=["a"]))]
    rows += [("x", attributes(ID=["lost"], Parent=["gone"])), ("x", attributes(ID=["two"])), ("y", attributes(ID=["two"]))]
    records = spark.createDataFrame(rows, "type string, attributes array<struct<tag:string,values:array<string>>>")
    units, edges = lineage.compiled_graph(records, {"Parent": "part_of", "Derives_from": "derives_from"})
    got = {r.id: r for r in units.collect()}
    assert [(k, got[k].unit, got[k].level, got[k].above) for k in ("g", "t1", "t2", "e", "p")] == [("g", 0, 0, 0), ("t1", 1, 1, 1), ("t2", 2, 1, 1), ("e", 3, 2, 3), ("p", 4, 2, 2)]
    assert {k: r.fault for k, r in got.items() if r.fault} == {"a": "cycle", "b": "cycle", "c": "below a cycle", "lost": "missing parent", "two": "several kinds"}
    assert all(r.unit is None for r in got.values() if r.fault)
    want = {(1, 0, "part_of"), (2, 0, "part_of"), (3, 1, "part_of"), (3, 2, "part_of"), (4, 2, "derives_from"), (4, 0, "part_of")}
    assert sorted(tuple(e) for e in edges.collect()) == sorted(want)
    assert lineage.compiled_graph(records.limit(0), {"Parent": "part_of"})[0].count() == 0
