"""Queries over column functions, keyed joins and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sequence as S
from ..operators import joins as J
from ..operators import models as L
from ..operators import statistics as Q
from .registry import DNA_SQL, EDITS_SQL, dna, edits, query, t


@query("select p_partkey, round(least(greatest(1.5 + 0.02 * p_retailprice, 20), 40), 8) as state, floor(least(greatest(1.5 + 0.02 * p_retailprice, 20), 40) + 0.5)::bigint as whole from part")
def lowered_states(spark, d):
    low = lambda integer: A.lower_state("p_retailprice", 1.5, 0.02, 20.0, 40.0, integer)
    return t(spark, d, "part").select("p_partkey", F.round(low(False), 8).alias("state"), low(True).cast("long").alias("whole"))


@query("select event_id, round(1 / (1 + exp(-value / 10)), 8) as s, round(ln(1 + exp(value / 10)), 8) as l, round(log2((value + 0.5) / (abs(value) + 1.5)), 8) as r from events where value is not null")
def logistic_columns(spark, d):
    z = F.col("value") / 10
    return t(spark, d, "events").filter("value is not null").select("event_id", F.round(A.sigmoid(z), 8).alias("s"), F.round(A.log1p_exp(z), 8).alias("l"), F.round(A.log2_ratio("value", F.abs("value") + 1), 8).alias("r"))


@query("select c_custkey, (abs(c_acctbal) >= 100)::int + (abs(c_acctbal) >= 1000)::int + (abs(c_acctbal) >= 5000)::int as bin from customer")
def distance_bins(spark, d):
    return t(spark, d, "customer").select("c_custkey", A.distance_bin("c_acctbal", [100.0, 1000.0, 5000.0]).alias("bin"))


@query("select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 6) as dot, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as distance, round(acos(least(1, greatest(-1, list_cosine_similarity(a.embedding::double[], b.embedding::double[])))), 6) as angle from embeddings a, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) b where len(a.embedding) = 64")
def vector_measures(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    first = e.agg(F.min_by("a", "vec_id").alias("b"))
    x = e.filter(F.size("a") == 64).crossJoin(F.broadcast(first))
    return x.select("vec_id", F.round(A.dot("a", "b"), 6).alias("dot"), F.round(A.distance("a", "b"), 6).alias("distance"), F.round(A.angle("a", "b"), 6).alias("angle"))


@query("with g as (select o_custkey as k, list(o_orderkey % 10) as a, list(o_totalprice order by o_orderkey) as v from orders group by 1) select k, list_sum(list_transform(list_distinct(a), lambda x: pow(2, x)::bigint))::bigint as mask, round(v[1] - list_avg(v), 4) as centred from g")
def masks_and_centred(spark, d):
    g = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list((F.col("o_orderkey") % 10).cast("int")).alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("v"))
    return g.select("k", A.bit_mask("a").alias("mask"), F.round(A.centred("v")[0], 4).alias("centred"))


@query("select p_partkey, round(greatest(least((p_retailprice - 1000) / 400, 0.8), -0.5), 8) as clipped, round(tanh((p_retailprice - 1000) / 400), 8) as context from part")
def clipped_context(spark, d):
    x = (F.col("p_retailprice") - 1000) / 400
    return t(spark, d, "part").select("p_partkey", F.round(A.clamp(x, -0.5, 0.8), 8).alias("clipped"), F.round(F.tanh(x), 8).alias("context"))


@query(f"with {EDITS_SQL} select doc_id, (repeat('N', 5) || dna || repeat('N', 5))[pos + 1:pos + 11] as w, list_transform(string_split(dna[1:4], ''), lambda c: instr('ACGT', c) - 1) as codes from edits")
def edit_windows(spark, d):
    code = F.transform(S.one_hot(F.col("dna").substr(1, 4)), lambda x: F.array_position(x, F.lit(1.0)) - 1)
    return edits(spark, d).select("doc_id", S.window_around("dna", "pos", 5).alias("w"), code.alias("codes"))


@query("select doc_id, upper(regexp_replace(text, '[\\s0-9]', '', 'g')) as cleaned from documents where text is not null and regexp_matches(text, '^[\\x00-\\x7F]*$')")
def cleaned_texts(spark, d):
    return t(spark, d, "documents").filter(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", S.clean("text").alias("cleaned"))


@query("select o_orderkey, c_mktsegment from orders join customer on c_custkey = o_custkey")
def strictly_joined(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return J.strict_join(o, t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"]).select("o_orderkey", "c_mktsegment")


@query("with i as (select l_suppkey as k, l_orderkey % 5000 as s, l_orderkey % 5000 + l_quantity as e, l_extendedprice as v from lineitem), p as (select o_orderkey, o_custkey % 100 + 1 as k, o_orderkey % 5000 as at from orders) select o_orderkey, max(v) as max_value from p left join i on i.k = p.k and i.s <= p.at and p.at < i.e group by 1")
def signals_at_points(spark, d):
    i = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") % 5000).alias("s"), (F.col("l_orderkey") % 5000 + F.col("l_quantity")).alias("e"), F.col("l_extendedprice").alias("v"))
    p = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("k"), (F.col("o_orderkey") % 5000).alias("at"))
    return J.points_in_intervals(p, i, ["k"], "at", "s", "e", "v", 50.0).select("o_orderkey", "max_value")


@query("with a as (select l_partkey as g, list(l_linenumber order by l_linenumber) as m from lineitem where l_returnflag = 'R' group by 1), b as (select l_partkey as g, list(l_linenumber order by l_linenumber) as m from lineitem where l_returnflag <> 'R' group by 1) select a.g as left_group, b.g as right_group from a join b on a.m = b.m")
def equal_multisets(spark, d):
    """Parts of which the returned lines have the numbers that another's other
    lines have."""
    x = t(spark, d, "lineitem")
    one = x.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("g"), "l_linenumber")
    two = x.filter("l_returnflag <> 'R'").select(F.col("l_partkey").alias("g"), "l_linenumber")
    return J.same_sets(one, two, "g", "l_linenumber").select("left_group", "right_group")


@query("with n as (select c_nationkey as f, c_mktsegment as c, count(*) as n from customer group by 1, 2), k as (select f, count(*) as k from n group by 1) select c_custkey, 1.0 / ((select count(*) from k) * k.k * n.n) as weight from customer join n on n.f = c_nationkey and n.c = c_mktsegment join k on k.f = c_nationkey")
def three_level_weights(spark, d):
    return Q.three_level_weight(t(spark, d, "customer"), "c_nationkey", "c_mktsegment").select("c_custkey", "weight")


ERR = "e as (select l_returnflag as k, l_quantity - 25 as p, round(l_discount * 500 - 25, 6) as o from lineitem)"


@query(f"with {ERR} select k, round(avg((p - o) * (p - o)), 6) as mse, round(sqrt(avg((p - o) * (p - o))), 6) as rmse, round(avg(abs(p - o)), 6) as mae, round(avg((sign(p) = sign(o))::int), 8) as sign_agreement, round(avg(case when p = 0 then 0.5 else (sign(p) = sign(o))::int end), 8) as half_credit from e group by 1")
def error_metrics(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") - 25).alias("p"), F.round(F.col("l_discount") * 500 - 25, 6).alias("o"))
    g = e.groupBy("k").agg(*Q.errors("p", "o"), Q.sign_accuracy("p", "o").alias("half_credit"))
    return g.select("k", *[F.round(c, n).alias(c) for c, n in (("mse", 6), ("rmse", 6), ("mae", 6), ("sign_agreement", 8), ("half_credit", 8))])


@query("with p as (select a.l_suppkey as k, count(*) as n, avg((sign(a.l_quantity - b.l_quantity) = sign(a.l_discount - b.l_discount))::int) as accuracy from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_linenumber < b.l_linenumber where a.l_quantity <> b.l_quantity group by 1) select k, n, round(accuracy, 8) as accuracy from p")
def pairwise_accuracy(spark, d):
    x = t(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_suppkey").alias("g"), F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("truth"), F.col("l_discount").alias("score"))
    return Q.pairwise_accuracy(x, "g", "i", "score", "truth", ["k"]).select("k", "n", F.round("accuracy", 8).alias("accuracy"))


@query("with s as (select c_nationkey as study, avg(c_acctbal) as r from customer group by 1) select study, round((select sum(r) from s) / 24 - r / 24, 6) as others from s where (select count(*) from s) = 25")
def leave_one_study_out(spark, d):
    s = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("study")).agg(F.avg("c_acctbal").alias("r"))
    return Q.leave_one_out(s, "r").select("study", F.round("others", 6).alias("others"))


@query("with s as (select sum(w * l_quantity * l_quantity) + 2 as a, sum(w * l_quantity * l_discount) as b, sum(w * l_discount * l_discount) + 5 as c, sum(w * l_quantity * l_extendedprice) as u, sum(w * l_discount * l_extendedprice) as v from (select *, 1.0 / l_linenumber as w from lineitem)) select round((c * u - b * v) / (a * c - b * b), 4) as quantity, round((a * v - b * u) / (a * c - b * b), 4) as discount from s")
def weighted_ridge(spark, d):
    b = L.ridge_from_gram(t(spark, d, "lineitem").withColumn("w", 1 / F.col("l_linenumber")), ["l_quantity", "l_discount"], "l_extendedprice", [2.0, 5.0], "w")
    return spark.range(1).select(F.round(F.lit(float(b[0])), 4).alias("quantity"), F.round(F.lit(float(b[1])), 4).alias("discount"))


@query("with m as (select l_returnflag as k, count(*) as n, avg(l_quantity) as m, stddev_pop(l_quantity) + 1e-8 as s, sum(l_quantity * l_extendedprice) as qe, sum(l_extendedprice) as e, sum(l_quantity * l_quantity) as qq from lineitem group by 1) select k, round(((qe - m * e) / s) / ((qq - n * m * m) / (s * s) + 10), 4) as coefficient from m")
def standardised_ridges(spark, d):
    found = L.moments(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", "l_returnflag")
    rows = [(k, round(float(L.standardised_ridge(m, 10.0)[0][0]), 4)) for k, m in sorted(found.items())]
    return spark.createDataFrame(rows, "k string, coefficient double")


@query(f"with {DNA_SQL} select doc_id, instr(dna, 'GATT')::int - 1 as first, dna[1:10] = reverse(translate(dna[1:10], 'ACGT', 'TGCA')) as palindrome, regexp_matches(dna, '^[ACGT]+$') as valid from dna")
def alphabet_checks(spark, d):
    head = F.col("dna").substr(1, 10)
    return dna(spark, d).select("doc_id", (F.instr("dna", F.lit("GATT")) - 1).alias("first"), (head == S.reverse_complement(head)).alias("palindrome"), S.valid_alphabet("dna").alias("valid"))
