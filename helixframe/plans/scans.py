"""Queries over scans, motif features and compiled features, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import motifs as M
from ..operators import scans as X
from .registry import DNA_SQL, EDITS_SQL, dna, edits, mutants, query, t

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
#: Scores of a motif of four bases, by a rule that both engines can compute.
RULE = "(((instr('ACGT', {base}) * ({j} + {k} + 2)) % 7) - 3) / 2.0"


def rule(base: int, j: int, k: int) -> float:
    return (((base + 1) * (j + k + 2)) % 7 - 3) / 2.0


RULED = [np.array([[rule(b, j, k) for j in range(4)] for b in range(4)]) for k in range(3)]


def _score(word: str, k: str) -> str:
    return "(" + " + ".join(RULE.format(base=f"{word}[{j + 1}]", j=j, k=k) for j in range(4)) + ")"


def _potential(word: str, k: str) -> str:
    return f"(ln(1 + (exp({_score(word, k)}) + exp({_score('rc', k)})) / 2) - ln(2))"


@query(f"with {DNA_SQL}, w as (select doc_id, dna[i + 1:i + 4] as w, {RC.format('dna[i + 1:i + 4]')} as rc from (select doc_id, dna, unnest(range(0, 61)) as i from dna)), k as (select *, unnest(range(0, 3)) as k from w) select doc_id, k::int as motif, round(sum({_potential('w', 'k')}), 6) as potential from k group by 1, 2")
def motif_endpoints(spark, d):
    e = M.motif_endpoints(dna(spark, d).select("doc_id", F.col("dna").alias("sequence")), RULED)
    return e.select("doc_id", F.posexplode("potential").alias("motif", "p")).select("doc_id", "motif", F.round("p", 6).alias("potential"))


@query(f"with {EDITS_SQL}, s as (select doc_id, unnest([dna, mutant]) as x, unnest([-1, 1]) as sign from seqs), w as (select doc_id, sign, x[i + 1:i + 4] as w, {RC.format('x[i + 1:i + 4]')} as rc from (select doc_id, sign, x, unnest(range(0, 61)) as i from s)), k as (select *, unnest(range(0, 3)) as k from w), g as (select doc_id, k, sum(sign * {_potential('w', 'k')}) as delta, sum({_potential('w', 'k')}) as total from k group by 1, 2) select doc_id, k::int as motif, round(delta, 6) + 0.0 as delta, round(delta * total, 5) + 0.0 as quadratic from g")
def motif_deltas(spark, d):
    m = mutants(spark, d).select("doc_id", F.col("dna").alias("reference"), F.col("mutant").alias("sequence"))
    e = M.motif_deltas(m, RULED, quadratic=True).select("doc_id", F.posexplode(F.arrays_zip("delta", "quadratic")).alias("motif", "z"))
    return e.select("doc_id", "motif", (F.round("z.delta", 6) + 0.0).alias("delta"), (F.round("z.quadratic", 5) + 0.0).alias("quadratic"))


@query()
def motif_features_532(spark, d):
    """532 motifs of 6 to 20 bases for every document's edit: the sum and the
    greatest change, so that rows are compared and not 532 columns."""
    m = mutants(spark, d).select("doc_id", F.col("dna").alias("reference"), F.col("mutant").alias("sequence"))
    total = F.round(F.aggregate("delta", F.lit(0.0), lambda s, x: s + x), 6)
    largest = F.round(F.array_max(F.transform("delta", lambda x: F.abs(x))), 6)
    return M.motif_deltas(m, M.drawn_matrices(532), summary={"total": total, "largest": largest}).select("doc_id", "total", "largest")


@query("with m as (select distinct p_type as motif, length(p_type)::int % 8 + 5 as width from part) select motif, array_to_string(list_transform(list_sort(list_transform(range(width), lambda k: {'h': sha256(motif || ':' || k), 'k': k})), lambda x: x.k), ',') as columns from m")
def scrambled_motif(spark, d):
    """A motif for each type of part, its columns in a scrambled order."""
    m = t(spark, d, "part").select(F.col("p_type").alias("motif"), (F.length("p_type") % 8 + 5).alias("width")).distinct()
    kept = F.filter(M.scrambled_columns(12, F.col("motif")), lambda k: k < F.col("width"))
    return m.select("motif", F.array_join(kept.cast("array<string>"), ",").alias("columns"))


def _weight(letter, j):
    return F.lit(0.2) + (F.instr(F.lit("ACGT"), letter) * (j + 2) % 5).cast("double") / 4


WEIGHT = "(0.2 + ((instr('ACGT', {w}[{j} + 1]) * ({j} + 2)) % 5) / 4.0)"


def _product(word: str) -> str:
    return "(" + " * ".join(WEIGHT.format(w=word, j=j) for j in range(4)) + ")"


@query(f"with {EDITS_SQL}, s as (select doc_id, unnest([dna, mutant]) as x, unnest([-1, 1]) as sign from seqs), w as (select doc_id, sign, x[i + 1:i + 4] as w, {RC.format('x[i + 1:i + 4]')} as rc from (select doc_id, sign, x, unnest(range(0, 61)) as i from s)) select doc_id, round(sum(sign * ({_product('w')} + {_product('rc')})), 6) + 0.0 as delta from w group by 1")
def partition_deltas(spark, d):
    return edits(spark, d).select("doc_id", (F.round(X.partition_delta("dna", "pos", "alt", _weight, 4), 6) + 0.0).alias("delta"))


@query(f"with {EDITS_SQL}, s as (select doc_id, unnest([dna, mutant]) as x, unnest([-1, 1]) as sign from seqs), w as (select doc_id, sign, x[i + 1:i + 4] as w, {RC.format('x[i + 1:i + 4]')} as rc from (select doc_id, sign, x, unnest(range(0, 61)) as i from s)) select doc_id, round(sum(sign * (1 / (1 + pow(2, 1.5 - {_score('w', '0')})) + 1 / (1 + pow(2, 1.5 - {_score('rc', '0')})))), 6) + 0.0 as delta from w group by 1")
def occupancy_deltas(spark, d):
    score = lambda letter, j: ((F.instr(F.lit("ACGT"), letter) * (j + 2) % 7) - 3) / 2.0
    return edits(spark, d).select("doc_id", (F.round(X.occupancy_delta("dna", "pos", "alt", score, 4, 1.5), 6) + 0.0).alias("delta"))


EXONS = [(4, 19), (30, 42), (50, 60)]


@query(f"with {DNA_SQL}, c as (select doc_id, {RC.format('dna[5:19] || dna[31:42] || dna[51:60]')} as cds, (doc_id % 40)::int as p from dna) select doc_id, cds, p as position, (case when p >= 37 then null when 36 - p < 15 then 36 - p + 4 when 36 - p < 27 then 36 - p - 15 + 30 else 36 - p - 27 + 50 end)::bigint as place from c")
def spliced_coding(spark, d):
    p = (F.col("doc_id") % 40).cast("int")
    return dna(spark, d).select("doc_id", X.spliced("dna", EXONS, True).alias("cds"), p.alias("position"), X.genome_place(p, EXONS, True).alias("place"))


RATIO = "(0.25 + (p_partkey % 13) / 4.0)"


def parts(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("locus"), (0.25 + (F.col("p_partkey") % 13) / 4.0).alias("ratio"), ((F.col("p_partkey") % 7) / 2.0 - 1.2).alias("truth"))


def _response(ratio, signal):
    return ratio * signal / (1 + ratio * signal)


SCAN = f"e as (select p_partkey as id, p_brand as locus, {RATIO} as ratio, (p_partkey % 7) / 2.0 - 1.2 as truth, unnest([0.2, 0.5, 1.0, 2.0]) as signal from part), s as (select *, ratio * signal / (1 + ratio * signal) as a, signal / (1 + signal) as b from e)"


@query(f"with {SCAN}, c as (select signal, a - b as change, (a > 0.5) <> (b > 0.5) as flip from s) select signal, case when abs(change) <= 0.05 and not flip then 'doubly_silent' when abs(change) <= 0.05 then 'reporter_silent' when flip then 'concordant' else 'reporter_only' end as category, count(*) as n from c group by 1, 2")
def regime_scan(spark, d):
    s = X.regime_scan(parts(spark, d), "ratio", [0.2, 0.5, 1.0, 2.0], _response, 0.5, 0.05)
    return s.groupBy("signal", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SCAN}, c as (select locus, id, a - b as change, truth from s where signal = 1.0) select locus, count(*) as edits, count(truth) filter (id % 3 = 0) as measured, round(avg((sign(change) = sign(truth))::int) filter (id % 3 = 0), 8) as agreement from c group by 1")
def locus_benchmark(spark, d):
    s = X.regime_scan(parts(spark, d), "ratio", [1.0], _response, 0.5, 0.05)
    return X.benchmark(s.select("locus", "id", "change"), "locus", parts(spark, d).filter("id % 3 = 0").select("locus", "id", "truth"), ["id"], "change", "truth").withColumn("agreement", F.round("agreement", 8))


@query("with g as (select n_nationkey as key, 0.1 + n_regionkey / 5.0 as length, unnest(range(0, 41)) / 40.0 as x from nation), s as (select key, x, exp(-x / length) * 2 / (1 + exp(-x / length) * 2) > 0.5 as on_ from g) select key, min(x) filter (on_) as first, max(x) filter (on_) as last, count(*) filter (on_) as n from s group by 1")
def gradient_domains(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), (0.1 + F.col("n_regionkey") / 5.0).alias("length"))
    return X.profile(n, "key", "length", 41, lambda s: s * 2 / (1 + s * 2))


@query("with a as (select l_suppkey as k, l_orderkey // 4 as t, max(l_quantity) as v from lineitem group by 1, 2), b as (select l_suppkey as k, l_orderkey // 4 as t, max(l_extendedprice) as v from lineitem where l_orderkey % 4 = 0 group by 1, 2) select k, round(max(abs(a.v - b.v)), 4) as largest, count(*) filter (a.v is null or b.v is null) as missing from a full join b using (k, t) group by 1")
def trajectory_differences(spark, d):
    """Suppliers' quantities by every fourth order against prices at four times
    the steps, of which the fourth ones are compared."""
    x = t(spark, d, "lineitem")
    a = x.groupBy(F.col("l_suppkey").alias("k"), F.expr("l_orderkey div 4").alias("t")).agg(F.max("l_quantity").alias("v"))
    b = x.groupBy(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("t")).agg(F.max("l_extendedprice").alias("v"))
    return X.trajectory_difference(a, b, ["k"], "t", "v", 4).select("k", F.round("largest", 4).alias("largest"), "missing")


UNIFORM = "(('0x' || sha256('{seed}:' || {id}::varchar || ':' || draw::varchar)[1:12])::bigint::double / 281474976710656.0)"


@query(f"with d as (select n_nationkey as id, unnest(range(0, 64)) as draw from nation), f as (select id, 0.8 + 0.4 * {UNIFORM.format(seed='e', id='id')} as f from d), s as (select id, f * (0.5 + id / 20.0) / (1 + f * (0.5 + id / 20.0)) as s from f) select id, avg((s > 0.5)::int) as probability, round(quantile_cont(s, 0.05), 8) as p05, round(quantile_cont(s, 0.95), 8) as p95 from s group by 1")
def parameter_ensemble(spark, d):
    n = X.jittered(t(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "id", 64, "e", 0.2)
    r = F.col("factor") * (0.5 + F.col("id") / 20.0)
    e = X.ensemble(n.withColumn("s", r / (1 + r)), ["id"], "s", 0.5)
    return e.select("id", "probability", F.round("p05", 8).alias("p05"), F.round("p95", 8).alias("p95"))


@query(f"with c as (select c_nationkey as k, max(c_acctbal) / 10000 as o from customer group by 1), d as (select k, o, unnest(range(0, 99)) as draw from c), p as (select k, {UNIFORM.format(seed='n', id='k')} >= o as ge from d) select k, count(*) as n, round((1 + count(*) filter (ge)) / (1.0 + count(*)), 10) as p from p group by 1")
def null_controls(spark, d):
    o = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.max("c_acctbal") / 10000).alias("v"))
    decoys = X.jittered(o.select("k"), "k", 99, "n", 0.5).select("k", (F.col("factor") - 0.5).alias("v"))
    return X.empirical_p(o, decoys, ["k"], "v").withColumn("p", F.round("p", 10))


@query("with g as (select l_returnflag as k, l_linenumber as n, l_quantity / 25 - 1 as p, l_discount * 20 - 1 as o from lineitem), r as (select k, n, sqrt(avg((p - o) * (p - o))) as rmse, avg((sign(round(p, 9)) = sign(round(o, 9)))::int) as agreement from g group by 1, 2) select k, n, round(rmse, 6) as rmse, round(agreement, 8) as agreement, rmse > 0.85 or agreement < 0.5 as falsified from r")
def observation_falsified(spark, d):
    g = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("n"), F.round(F.col("l_quantity") / 25 - 1, 9).alias("p"), F.round(F.col("l_discount") * 20 - 1, 9).alias("o"))
    return X.falsified(g, ["k", "n"], "p", "o", 0.85, 0.5).select("k", "n", F.round("rmse", 6).alias("rmse"), F.round("agreement", 8).alias("agreement"), "falsified")


@query("with p as (select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2), c as (select * from p where n > 0) select (row_number() over (order by l_partkey, l_suppkey, k) - 1)::bigint as unit, l_partkey % 7 as kind, 0.5::double as level, k::bigint as ordinal from (select *, unnest(range(n)) as k from c)")
def created_units(spark, d):
    """As many units for each part of a supplier as it has lines."""
    n = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return X.created(n, ["l_partkey", "l_suppkey"], "n", {"kind": F.col("l_partkey") % 7, "level": F.lit(0.5)}).select("unit", "kind", "level", "ordinal")


@query("select l_linenumber as phase, l_suppkey % 40 as field, count(distinct l_returnflag) as rules from lineitem group by 1, 2 having count(distinct l_returnflag) > 1")
def rule_conflicts(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("phase"), (F.col("l_suppkey") % 40).alias("field"), F.col("l_returnflag").alias("rule"))
    return X.write_conflicts(x, "phase", "field", "rule")


@query("with g as (select l_orderkey as port, count(*) as n, count(distinct l_linenumber) as d, max(l_linenumber) as hi from lineitem group by 1), p as (select o_orderkey as port, o_orderkey % 8 as size from orders) select p.port, case when n is null then 'unbound' when n <> d then 'bound twice' else 'out of range' end as reason from p left join g using (port) where n is null or n <> d or hi >= size")
def port_faults(spark, d):
    """Orders as ports that their lines bind."""
    from ..operators.collections import unbound_ports

    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("port"), (F.col("o_orderkey") % 8).alias("size"))
    b = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("port"), F.col("l_linenumber").alias("i"))
    return unbound_ports(p, b, "port", "i", "size")


@query("with f as (select 'f' || c_custkey::varchar as id, 'f' || (c_custkey // 3)::varchar as parent, c_mktsegment as kind from customer), n as (select id, row_number() over (order by id) - 1 as unit from f) select a.unit, f.id, f.kind, case when p.unit is null then []::bigint[] else [p.unit] end as parents from f join n a on a.id = f.id left join n p on p.id = f.parent")
def compiled_features(spark, d):
    parent = F.expr("c_custkey div 3")
    f = t(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.concat(F.lit("f"), parent.cast("string"))).alias("parents"), F.col("c_mktsegment").alias("kind"))
    return X.compiled_features(f.withColumnRenamed("parents", "up"), "id", "up", "kind")


@query("with f as (select 'f' || c_custkey::varchar as id, 'f' || (c_custkey // 3 + c_custkey % 2 * 5000)::varchar as parent, c_mktsegment as kind from customer) select f.kind, count(*) as n, count(*) filter (p.id is not null) as closed from f left join f p on p.id = f.parent group by 1")
def feature_closure(spark, d):
    p = F.expr("c_custkey div 3 + c_custkey % 2 * 5000")
    f = t(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.concat(F.lit("f"), p.cast("string"))).alias("up"), F.col("c_mktsegment").alias("kind"))
    return X.feature_edges(f, "id", "up", "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("closed").alias("closed"))


@query(f"with {SCAN} select locus, id, round(a - b, 8) as change, sha256(locus || ':' || id::varchar || ':' || round((a - b) * 1e6)::bigint::varchar) as seal from s where signal = 1.0")
def sealed_predictions(spark, d):
    s = X.regime_scan(parts(spark, d), "ratio", [1.0], _response, 0.5, 0.05)
    return X.sealed_scan(s, "locus", "id", "change").withColumn("change", F.round("change", 8))


@query(f"with {SCAN}, t as (select locus, id, ratio, (row_number() over (partition by locus order by round(abs(a - b), 9) desc, id))::int as rank from s where signal = 1.0), d as (select locus, rank, id, ratio, unnest(range(0, 50)) as draw from t where rank <= 5), f as (select locus, rank, id, ratio * (0.7 + 0.6 * {UNIFORM.format(seed='r', id='id')}) as q from d) select locus, rank, id, avg((q / (1 + q) > 0.5)::int) as probability from f group by 1, 2, 3")
def robust_edits(spark, d):
    s = X.regime_scan(parts(spark, d), "ratio", [1.0], _response, 0.5, 0.05).withColumn("change", F.round("change", 9))
    return X.robust_edits(s, "locus", "id", "ratio", "change", _response, 0.5, 5, 50, "r", 0.3)


@query(f"with {SCAN}, c as (select locus, id, abs(a - b) <= 0.05 and not ((a > 0.5) <> (b > 0.5)) as silent, (a > 0.5) <> (b > 0.5) as flip from s where signal = 1.0), r as (select p.locus, min(abs(p.ratio * b.other - 1)) as best from (select p_brand as locus, p_partkey as id, {RATIO} as ratio from part) p join (select p_brand as locus, p_partkey as id, {RATIO} as other from part where p_size < 6) b on p.locus = b.locus and p.id <> b.id group by 1) select c.locus, count(*) as edits, count(*) filter (flip) as flips, round(avg(silent::int), 8) as silent, round(any_value(r.best), 8) as best_gap from c left join r on r.locus = c.locus group by 1")
def locus_report(spark, d):
    from . import design  # its queries stand on this module's

    s = X.regime_scan(parts(spark, d), "ratio", [1.0], _response, 0.5, 0.05)
    return X.report(s, design.second_site_rescues(spark, d), "locus").select("locus", "edits", "flips", F.round("silent", 8).alias("silent"), F.round("best_gap", 8).alias("best_gap"))
