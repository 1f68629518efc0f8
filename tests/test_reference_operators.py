"""Sequence, identity, join, statistics and simulation operators."""

import gzip
import json
import math
from collections import Counter

import numpy as np
import pytest
from helixframe.functions import identity as I
from helixframe.functions import sequence as S
from helixframe.operators import joins as J
from helixframe.operators import simulate as X
from helixframe.operators import statistics as Q
from helixframe.sources import formats
from helixframe.sources import sinks, tables
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_public_vrs_digests(spark):
    location = I.vrs_location(F.lit("SQ.IIB53T8CNeJJdUqzn9V_JnRtQadwWCbl"), F.lit(44908821), F.lit(44908822))
    assert one(spark, location) == "wIlaGykfwHIpPY2Fcxtbx4TINbbODFVz"
    assert one(spark, I.vrs_allele(location, F.lit("T"))) == "0AePZIWZUNsUlQTamyLrjm2HWUw2opLt"


def test_sequence_laws(spark):
    seqs = ["ACGT", "A", "GATTACA", "ACGTNRY", "TTTTTTTTTT"]
    d = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in d.select("s", S.reverse_complement(S.reverse_complement("s")).alias("b"), S.kmers("s", 3).alias("k")).collect():
        assert r.b == r.s and r.k == [r.s[i : i + 3] for i in range(len(r.s) - 2)]
    e = spark.createDataFrame([("ACGT", "AGGT"), ("ACGT", "ACGGT"), ("AAAA", "AA"), ("AC", "AC")], "r string, a string")
    spans = [tuple(x.s) for x in e.select(S.edit_span("r", "a").alias("s")).collect()]
    assert spans == [(1, 2, "C", "G"), (3, 3, "", "G"), (2, 4, "AA", ""), (2, 2, "", "")]
    assert one(spark, S.parse_edit(F.lit("12:A>T"))) == (11, 12, "A", "T")
    assert one(spark, S.translate_frame(F.lit("ATGGCCTAAGGG"))) == "MA"
    assert one(spark, S.coding_effect(F.lit("ATGGCC"), F.lit("ATGGAC"))) == "missense"
    assert one(spark, S.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2


def test_canonical_json_and_seal(tmp_path, spark):
    assert I.canonical_json({"b": 1e21, "a": [1.0, 1e-7, 0.1, -0.0, True, None], "é": "€\n"}) == '{"a":[1,1e-7,0.1,0,true,null],"b":1e+21,"é":"€\\n"}'
    assert I.canonical_json(333333333.33333329) == "333333333.3333333" and I.canonical_json(1e-6) == "0.000001"
    sealed = sinks.write_sealed(spark, {"x": 1}, str(tmp_path / "s"))
    assert I.seal_holds(sealed) and not I.seal_holds(sealed | {"x": 2})


def test_hex_modulo_uses_all_digits(spark):
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    assert one(spark, I.hex_modulo(F.lit(h), 10)) == int(h, 16) % 10


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one first\r\nACGT\r\nac\r\n>two\nNN\n")
    rows = formats.read(spark, "fasta", str(tmp_path / "a.fa")).orderBy("ordinal").collect()
    assert [(r.record_id, r.bases, r.sequence) for r in rows] == [("one", 6, "ACGTAC"), ("two", 2, "NN")]
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">one\nAC") + gzip.compress(b"GT\n"))
    assert formats.read(spark, "fasta", str(tmp_path / "a.fa.gz"), "gzip").first().sequence == "ACGT"
    for bad in (gzip.compress(b">a\nA")[:-3], gzip.compress(b">a\nA") + b"\0\0"):
        with pytest.raises(formats.FormatError):
            formats.unpack(bad)
    (tmp_path / "r.fq").write_bytes(b"@r1 x\nGATTACA\n+\nIIIIIII\n@r2\nACGTN\n+\nIIIII\n")
    assert formats.read(spark, "fastq", str(tmp_path / "r.fq")).count() == 2
    (tmp_path / "f.gff").write_bytes(b"##gff-version 3\n##sequence-region c 1 90\nc\ts\tgene\t5\t20\t.\t+\t.\tID=g;Note=a%2Cb,c\n")
    f = formats.read(spark, "gff3", str(tmp_path / "f.gff")).first()
    assert (f.seqid, f.start, f.end, f.score) == ("c", 5, 20, None) and f.attributes[1]["values"] == ["a,b", "c"]
    for bad in (b">x\n", b"ACGT\n", b">x\nAC-T\n", b">x\nA\n>x\nA\n"):
        with pytest.raises(formats.FormatError):
            list(formats.parse_fasta(bad))


def test_genbank(spark, tmp_path):
    text = """LOCUS       X1          12 bp    DNA     circular BCT 21-JUN-1999
VERSION     X1.1
FEATURES             Location/Qualifiers
     source          1..12
                     /organism="Some ""thing""
                     more"
     CDS             complement(join(2..4,8..>10))
                     /codon_start=1
                     /pseudo
ORIGIN
        1 acgtacgtac gt
//
"""
    (tmp_path / "x.gb").write_text(text)
    r = formats.read(spark, "genbank", str(tmp_path / "x.gb")).first()
    assert (r.record_id, r.length, r.topology, str(r.date), r.sequence) == ("X1.1", 12, "circular", "1999-06-21", "ACGTACGTACGT")
    assert r.features[0].qualifiers[0].value == 'Some "thing" more'
    assert [(s.start, s.end, s.orientation, s.end_fuzz) for s in r.features[1].segments] == [(7, 10, -1, ">"), (1, 4, -1, None)]


def test_json_keys(spark):
    d = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":1,"b":2}',), ("3",)], "j string")
    assert [r.x for r in d.select(tables.repeated_keys("j").alias("x")).collect()] == [True, False, None]
    assert [r.x for r in d.select(tables.closed_schema("j", ["b", "a"]).alias("x")).collect()] == [False, True, False]


def test_joins_against_loops(spark):
    g = np.random.default_rng(1)
    a = [(int(k), int(g.integers(0, 3)), float(g.integers(0, 200))) for k in range(60)]
    b = [(int(k), int(g.integers(0, 3)), float(g.integers(0, 200))) for k in range(40)]
    l, r = (spark.createDataFrame(x, "id long, k int, v double") for x in (a, b))
    semi = {x.id for x in J.within(l, r, ["k"], "v", 5.0).collect()}
    assert semi == {i for i, k, v in a if any(k == q and abs(v - w) <= 5 for _, q, w in b)}
    iv = lambda rows: [(i, k, v, v + 1 + i % 17) for i, k, v in rows]
    x, y = (spark.createDataFrame(iv(z), "id long, k int, s double, e double") for z in (a, b))
    got = Counter((p.id, p.id_r) for p in J.overlaps(x, y, ["k"], "s", "e", 7.0).collect())
    assert got == Counter((i, j) for i, k, s, e in iv(a) for j, q, u, w in iv(b) if k == q and s < w and u < e)
    near = {p.id: (p.prev_value, p.next_value) for p in J.as_of(l, r.select("k", "v", F.col("v").alias("w")), ["k"], "v", "w").collect()}
    for i, k, v in a:
        before, after = [w for _, q, w in b if q == k and w <= v], [w for _, q, w in b if q == k and w >= v]
        assert near[i] == (max(before, default=None), min(after, default=None))


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (3, 9)], "a long, b long")
    assert {r.node: r.family for r in J.components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 5: 5, 6: 5}
    assert {r.node: r.hops for r in J.hops(e, 1, "a", "b").collect()} == {1: 0, 2: 1, 3: 2, 9: 3, 8: 4}
    assert not J.has_cycle(e, "a", "b")
    assert J.has_cycle(e.unionByName(spark.createDataFrame([(3, 1)], "a long, b long")), "a", "b")


def test_family_weight_ignores_copies(spark):
    rows = [("a", 1.0), ("b", 3.0)]
    d = spark.createDataFrame(rows + [("a", 1.0)] * 5, "f string, v double")
    assert Q.two_level_mean(d, "f", "v").first()["mean"] == 2.0
    assert math.isclose(Q.family_weight(d, "f").agg(F.sum(F.col("weight") * F.col("v"))).first()[0], 2.0)
    assert Q.panel(d.withColumn("i", F.monotonically_increasing_id()), "f", "v", "i", 2).count() == 2
    with pytest.raises(Exception, match="fewer than"):
        Q.panel(d.withColumn("i", F.monotonically_increasing_id()), "f", "v", "i", 3).collect()
    assert d.filter("f = 'b'").agg(Q.pearson("v", "v").alias("r")).first().r is None


def test_logistic_finds_the_optimum(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(200, 2))
    y = (g.random(200) < 1 / (1 + np.exp(-(x @ [1.0, -2.0])))).astype(float)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    b = Q.logistic(d, ["a", "b"], "y", 0.5)
    p = 1 / (1 + np.exp(-(x @ b)))
    assert np.abs(x.T @ (p - y) + 0.5 * b).max() < 1e-6


def test_simulators():
    s = "ACGTTGCAACGGTCA" * 4
    t = X.dinucleotide_shuffle(s, 7)
    assert t != s and Counter(zip(t, t[1:])) == Counter(zip(s, s[1:])) and (t[0], t[-1]) == (s[0], s[-1])
    f = lambda y: -y
    assert abs(X.adaptive_rk4(np.array([[0.8]]), f, 3.0)[0, 0] - 0.8 * math.exp(-3)) < 1e-7
    out = X.spikes([0, 1], [(0, 1)], [(1.0, 0, 0.6), (1.0, 0, 0.6)])
    assert out == [(1.0, 0)]
    assert X.validate_trace([{"event": "cell", "step": 0, "cell": 1}, {"event": "segment", "step": 1, "cell": 2}]) == ["segment of unknown cell 2"]
    w = np.log(np.array([[2.0], [1.0], [1.0], [0.5]]))
    assert math.isclose(X.motif_sums(["A"], w, 1.0)[0], math.log(1 + 2 + 0.5))


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 55
    json.dumps(sorted(e.queries()))
