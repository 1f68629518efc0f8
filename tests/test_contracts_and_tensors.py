"""Contracts, replays, units of features and tensors."""

import hashlib
import io

import numpy as np
import pytest
from helixframe.functions import tensors as X
from helixframe.operators import collections as C
from helixframe.operators import contracts as K
from helixframe.operators import simulate
from helixframe.sources import formats
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_contracts(spark):
    good = '{"name":"t","units":3,"fields":[{"name":"x","kind":"i64","fraction_bits":8}],"rules":["r"]}'
    d = spark.createDataFrame([(good,), (good.replace('"units":3,', ""),), (good.replace("3", '"q"'),), (good[:-1] + ',"z":1}',), ("[]",), (None,)], "t string")
    assert [r.x is not None for r in d.select(K.parse_target("t").alias("x")).collect()] == [True, False, False, False, False, False]
    p = spark.createDataFrame([('{"version":1,"limits":{"a":5},"operations":["o"]}',)], "t string").select(K.parse_policy("t").alias("x")).first().x
    assert p.limits == {"a": 5}
    v = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (2.25,), (1e30,)], "v double").select(K.fixed_point("v", 0, -100, 100).alias("x")).collect()
    assert [r.x for r in v] == [0, 2, 0, 2, 100]


def test_chains_and_bundles(spark):
    m = spark.createDataFrame([(sha("m"), "m"), (sha("n"), "other")], "digest string, body string")
    r = spark.createDataFrame([(sha(b), b, man) for b, man in (("1", sha("m")), ("2", "none"), ("3", sha("n")), ("4", sha("m")), ("5", sha("m")), ("6", sha("m")))], "digest string, body string, manifest string")
    a = spark.createDataFrame([(sha("a1"), "a1", sha("1")), (sha("a2"), "a2", sha("2")), (sha("a3"), "a3", sha("3")), (sha("a5"), "a5", sha("5")), (sha("b5"), "b5", sha("5")), ("x", "a6", sha("6"))], "digest string, body string, request string")
    got = {x.request: x.fault for x in K.broken_chain(m, r, a).collect()}
    assert got == {sha("2"): "no manifest", sha("3"): "manifest's digest", sha("4"): "no response", sha("5"): "two responses", sha("6"): "response's digest"}
    b = spark.createDataFrame([("b", "source", "1"), ("b", "graph", "9"), ("b", "graph", "9"), ("c", "source", "7"), ("c", "odd", "1")], "bundle string, role string, digest string")
    got = sorted(tuple(x) for x in K.bundle_faults(b, spark.createDataFrame([("1",), ("9",)], "digest string"), ["source", "graph"]).collect())
    assert got == [("b", "graph", "twice"), ("c", "graph", "missing"), ("c", "odd", "unknown role"), ("c", "source", "no such part")]
    t = spark.createDataFrame([(1, [0.5], "d1"), (2, [0.1], "d9")], "k int, numbers array<double>, digest string")
    d = spark.createDataFrame([(1, "d1"), (2, "d2")], "k int, own string")
    assert K.joined_tensors(d.filter("k = 1"), t, "k", "own").first().numbers == [0.5]
    with pytest.raises(Exception, match="no tensor for 2"):
        K.joined_tensors(d, t, "k", "own").collect()


def test_replay_finds_what_was_changed(spark):
    r = spark.createDataFrame([("r", "ACGTACGT")], "record_id string, sequence string")
    v = spark.createDataFrame([("a", "r", 1, 2, "C", "T"), ("b", "r", 4, 4, "", "GG")], "id string, record_id string, start int, end int, ref string, alt string")
    c = C.compile_variants(v, r)
    assert K.replay_variants(c, r).count() == 0
    changed = c.withColumn("alt", F.when(F.col("id") == "a", "G").otherwise(F.col("alt"))).withColumn("mutated_refget_id", F.when(F.col("id") == "b", "x").otherwise(F.col("mutated_refget_id")))
    assert sorted(map(tuple, K.replay_variants(changed, r).collect())) == [("a", "mutated sequence"), ("b", "refget id")]


def test_insdc_units(spark, tmp_path):
    (tmp_path / "x.gb").write_text('LOCUS       X1          12 bp    DNA     circular BCT 21-JUN-1999\nVERSION     X1.1\nFEATURES             Location/Qualifiers\n     source          1..12\n     CDS             complement(join(2..4,8..>10))\n                     /gene="g"\n                     /pseudo\nORIGIN\n        1 acgtacgtac gt\n//\n')
    got = [tuple(r)[2:] for r in K.insdc_units(formats.read(spark, "genbank", str(tmp_path / "x.gb"))).orderBy("ordinal").collect()]
    assert got == [("source", 1, 12, 0, 12, 1, 0, 0, 0, 0), ("CDS", 2, 6, 1, 10, 2, 0, 1, 2, 9)]


def test_variant_comparison(spark):
    spec = {"genes": ["a", "b"], "basal": [0.1, 0.2], "input": [1.0, 0.5], "binding": [2.0, 0.0], "production": [0.5, 0.5], "decay": [0.5, 0.5], "repression": [[0, 2], [2, 0]], "cooperativity": [[1, 2], [2, 1]]}
    d = spark.createDataFrame([("same", 1.0), ("lost", 0.0), ("more", 3.0)], "k string, q double")
    got = {r.k: r for r in K.compare_variants(d, "q", spec, 0, 0.5, 1e-3).collect()}
    assert got["same"].reporter_change == 0 and got["same"].endogenous_change == 0 and got["same"].category == "doubly_silent"
    s = simulate.circuit_arrays(spec)
    end = {q: simulate.adaptive_rk4(np.zeros((1, 2)), lambda x, q=q: simulate.rates(x, np.array([1.0]), np.array([q]), s), 48.0)[0] for q in (0.0, 1.0, 3.0)}
    for k, q in (("lost", 0.0), ("more", 3.0)):
        assert abs(got[k].endogenous_change - (end[q][0] - end[1.0][0])) < 1e-9 and got[k].flip == ((end[q][0] > 0.5) != (end[1.0][0] > 0.5))
        assert np.sign(got[k].reporter_change) == np.sign(q - 1)


def test_request_lines(spark):
    rows = ['{"mode":"reverse","sequence":"aac"}', '{"mode":"gc","sequence":"GC"}', '{"mode":"x","sequence":"A"}', '{"mode":"gc","sequence":"?"}', '{"mode":"gc"}', "{", '{"mode":"translate","sequence":"ATGTAA"}']
    got = [(r.ok, r.code, r.result) for r in K.answered(spark.createDataFrame([(x,) for x in rows], "value string")).collect()]
    assert got == [(True, None, "GTT"), (True, None, "1.0"), (False, "bad mode", None), (False, "bad sequence", None), (False, "bad request", None), (False, "bad request", None), (True, None, "M")]


def test_tensors_and_recipes(spark, tmp_path):
    x = np.array([[1.5, -2.0], [0.0, 1e-300]])
    assert (X.unpacked(X.packed(x, "f64"), "f64", [2, 2]) == x).all() and X.packed(np.array([-0.0]), "f64") == bytes(8)
    for bad in (lambda: X.packed(np.array([np.nan]), "f64"), lambda: X.unpacked(b"\x02", "bool", [1]), lambda: X.unpacked(bytes(7), "i64", [1]), lambda: X.unpacked(np.array([-0.0]).tobytes(), "f64", [1])):
        with pytest.raises(ValueError):
            bad()
    assert X.unpacked(X.packed(np.array([2**64 - 1], np.uint64), "u64"), "u64", [1])[0] == 2**64 - 1
    d = spark.createDataFrame([([1.0, 2.5],), (None,), ([],)], "v array<double>")
    assert [r.x for r in d.select(X.unpack(X.pack("v", "f64")).alias("x")).collect()] == [[1.0, 2.5], None, []]
    assert X.numbers_of(X.bases_of([1.5, -2.25e10])) == [1.5, -2.25e10] and len(X.bases_of([0.0])) == 32
    buffer = io.BytesIO()
    np.savez(buffer, w=np.arange(6).reshape(2, 3), b=np.array([0.5]))
    (tmp_path / "m.npz").write_bytes(buffer.getvalue())
    got = {r.name: (r.shape, r.numbers) for r in X.read_arrays(spark, str(tmp_path / "m.npz")).collect()}
    assert got == {"w": ([2, 3], [0.0, 1, 2, 3, 4, 5]), "b": ([1], [0.5])}
    heads = spark.createDataFrame([(b'{"a":1}',), (b"id,reference,pos\n",), (b">x\nAC",), (b"\x00\x01",)], "h binary")
    assert [r.k for r in heads.select(X.kind_of("h").alias("k")).collect()] == ["receipt", "edits", "sequence", "other"]
    p = X.class_projection(spark.createDataFrame([([2.0, 1.0, 1.0],)], "x array<double>"), "x", [[1, 0, 0], [0, 1, 1]], [1, 2], 4.0).first().classes
    assert np.allclose(p, np.array([2.0, 4.0]) / np.sqrt(20))
