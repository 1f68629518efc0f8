"""The registered queries over the driver's tables, each with its SQL.

DNA is derived alike in both engines: the SHA-256 of a text with hexadecimal
digits read as bases, and one edit a document at place doc_id modulo 64."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import identity as I
from ..functions import sequence as S
from ..operators import joins as J
from ..operators import simulate as X
from ..operators import statistics as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HEX, BASES, NEXT = "0123456789abcdef", "ACGTACGTACGTACGT", "CGTA"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dna(spark: SparkSession, d: str) -> DataFrame:
    s = F.translate(F.sha2(F.col("text").cast("binary"), 256), HEX, BASES)
    return t(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("family"), s.alias("dna"))


def edits(spark: SparkSession, d: str) -> DataFrame:
    pos = (F.col("doc_id") % 64).cast("int")
    ref = F.col("dna").substr(pos + 1, F.lit(1))
    return dna(spark, d).select("doc_id", "family", "dna", pos.alias("pos"), ref.alias("ref"), F.translate(ref, "ACGT", NEXT).alias("alt"))


DNA_SQL = f"dna as (select doc_id, source || ':' || lang as family, translate(sha256(text), '{HEX}', '{BASES}') as dna from documents)"
EDITS_SQL = DNA_SQL + f", edits as (select doc_id, family, dna, (doc_id % 64)::int as pos, dna[(doc_id % 64) + 1] as ref, translate(dna[(doc_id % 64) + 1], 'ACGT', '{NEXT}') as alt from dna), seqs as (select *, dna[1:pos] || alt || dna[pos + 2:64] as mutant from edits)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
WORD_SQL = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"


def mutants(spark: SparkSession, d: str) -> DataFrame:
    return edits(spark, d).withColumn("mutant", S.apply_edit("dna", "pos", F.col("pos") + 1, "ref", "alt"))


# Sequence words and linear scores


@query(f"with {DNA_SQL}, k as (select unnest(list_transform(range(1, 61), lambda i: dna[i:i + 4])) as w from dna) select {WORD_SQL} as word, count(*) as n from k group by 1")
def kmer5_canonical_counts(spark, d):
    words = dna(spark, d).select(F.explode(S.kmers("dna", 5)).alias("w"))
    return words.groupBy(S.canonical("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {DNA_SQL}, k as (select unnest(list_transform(range(1, 63), lambda i: dna[i:i + 2])) as w from dna), b as (select w from k union all select {RC.format('w')} from k) select w as word, count(*) / 2 as n from b group by 1")
def kmer3_both_strands(spark, d):
    words = dna(spark, d).select(F.explode(F.concat(S.kmers("dna", 3), S.kmers(S.reverse_complement("dna"), 3))).alias("word"))
    return words.groupBy("word").agg((F.count(F.lit(1)) / 2).alias("n"))


def word_delta(spark, d, k: int = 5) -> DataFrame:
    """Only words that cover the edit differ, so only those are counted."""
    m = mutants(spark, d)
    at = F.greatest(F.col("pos") - k + 2, F.lit(1))
    size = F.least(F.col("pos") + k, F.lit(64)) - at + 1
    part = lambda c, sign: m.select("doc_id", "family", F.explode(S.kmers(F.col(c).substr(at, size), k)).alias("w"), F.lit(sign).alias("s"))
    both = part("mutant", 1).unionByName(part("dna", -1))
    return both.groupBy("doc_id", "family", S.canonical("w").alias("word")).agg(F.sum("s").alias("delta")).filter("delta <> 0")


DELTA_SQL = EDITS_SQL + f""", k as (select doc_id, family, unnest(list_transform(range(1, 61), lambda i: mutant[i:i + 4])) as w, 1 as s from seqs
 union all select doc_id, family, unnest(list_transform(range(1, 61), lambda i: dna[i:i + 4])), -1 from seqs),
 delta as (select doc_id, family, {WORD_SQL} as word, sum(s)::bigint as delta from k group by all having sum(s) <> 0)"""
#: A word's weight, from its digest: multiples of 1/1000 in [-0.5, 0.5).
WEIGHT_SQL = "((('0x' || sha256(word)[1:8])::bigint % 1000) - 500) / 1000.0"


@query(f"with {DELTA_SQL} select doc_id, word, delta from delta")
def kmer_delta_sparse(spark, d):
    return word_delta(spark, d).select("doc_id", "word", "delta")


def linear_score(spark, d) -> DataFrame:
    w = (F.conv(F.substring(I.sha256_hex("word"), 1, 8), 16, 10).cast("long") % 1000 - 500) / 1000.0
    return word_delta(spark, d).groupBy("doc_id", "family").agg((F.round(F.sum(F.col("delta") * w), 6) + 0.0).alias("score"))


SCORE_SQL = DELTA_SQL + f", scores as (select doc_id, family, round(sum(delta * ({WEIGHT_SQL})), 6) + 0.0 as score from delta group by all)"


@query(f"with {SCORE_SQL} select doc_id, score from scores")
def kmer_linear_score(spark, d):
    return linear_score(spark, d).select("doc_id", "score")


@query(f"with {SCORE_SQL}, b as (select *, row_number() over (partition by family order by abs(score) desc, doc_id) as r from scores) select family, doc_id, score, (row_number() over (order by abs(score) desc, doc_id))::int as rank from b where r = 1 qualify rank <= 20")
def family_distinct_panel(spark, d):
    return Q.panel(linear_score(spark, d), "family", "score", "doc_id", 20).select("family", "doc_id", "score", "rank")


@query(f"with {SCORE_SQL} select doc_id, score from scores order by score, doc_id limit 25")
def top_k_down(spark, d):
    return linear_score(spark, d).orderBy("score", "doc_id").limit(25).select("doc_id", "score")


@query(f"with {SCORE_SQL}, b as (select *, row_number() over (partition by family order by abs(score) desc, doc_id) as r from scores), o as (select *, row_number() over (order by abs(score) desc, doc_id) as k from b where r = 1) select round(sum(sign(score) * (doc_id % 7 - 3)) / 30.0, 6) as utility, count(*)::bigint as used from o where k <= 30")
def topk_signed_utility(spark, d):
    one = linear_score(spark, d).withColumn("truth", F.col("doc_id") % 7 - 3).withColumn("copies", F.lit(1))
    return Q.top_k_utility(one, "family", "score", "truth", "doc_id", "copies", 30).select(F.round("utility", 6).alias("utility"), F.col("used").cast("long").alias("used"))


# Row transforms and identities


@query(f"with {DNA_SQL} select doc_id, {RC.format('dna')} as rc, {RC.format(RC.format('dna'))} = dna as same, least(dna, {RC.format('dna')}) as canonical from dna")
def revcomp_roundtrip(spark, d):
    rc = S.reverse_complement("dna")
    return dna(spark, d).select("doc_id", rc.alias("rc"), (S.reverse_complement(rc) == F.col("dna")).alias("same"), S.canonical("dna").alias("canonical"))


@query(f"with {EDITS_SQL} select doc_id, mutant, mutant[1:pos] || ref || mutant[pos + 2:64] = dna as reverted from seqs")
def variant_apply_revert(spark, d):
    return mutants(spark, d).select("doc_id", "mutant", (S.revert_edit("mutant", "pos", "ref", "alt") == F.col("dna")).alias("reverted"))


@query(f"with {EDITS_SQL} select doc_id, pos as start, pos + 1 as \"end\", ref, alt from seqs")
def minimal_edit_span(spark, d):
    return mutants(spark, d).select("doc_id", S.edit_span("dna", "mutant").alias("s")).select("doc_id", "s.*")


@query(f"with {DNA_SQL}, e as (select dna[1:(doc_id % 3)::int] as ref, dna[5:4 + ((doc_id // 3) % 3)::int] as alt from dna), f as (select len(ref) as r, len(alt) as a from e where ref <> alt) select case when r = 1 and a = 1 then 'snv' when r = 0 then 'insertion' when a = 0 then 'deletion' when r = a then 'mnv' else 'delins' end as kind, count(*) as n from f group by 1")
def edit_kind_counts(spark, d):
    e = dna(spark, d).select(F.col("dna").substr(F.lit(1), (F.col("doc_id") % 3).cast("int")).alias("ref"), F.col("dna").substr(F.lit(5), (F.floor(F.col("doc_id") / 3) % 3).cast("int")).alias("alt")).filter("ref <> alt")
    return e.groupBy(S.edit_kind("ref", "alt").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {DNA_SQL}, p as (select doc_id, dna, unnest(range(0, 64)) as pos from dna), e as (select doc_id, pos, dna[pos + 1] as ref, unnest(['A','C','G','T']) as alt from p) select pos::int as pos, alt, count(*) as n, sum((alt in ('G','C'))::int - (ref in ('G','C'))::int)::bigint as gc_gain from e where ref <> alt group by 1, 2")
def saturation_scan_gc(spark, d):
    """Edits of one place and reference base are alike, so those are counted
    before the alternatives are enumerated."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("pos"), F.col("dna").substr(i + 1, F.lit(1)).alias("ref")))
    p = dna(spark, d).select(F.explode(letters).alias("l")).groupBy("l.pos", "l.ref").agg(F.count(F.lit(1)).alias("n"))
    e = p.withColumn("alt", F.explode(F.array(*map(F.lit, "ACGT")))).filter("ref <> alt")
    gain = F.col("alt").isin("G", "C").cast("int") - F.col("ref").isin("G", "C").cast("int")
    return e.groupBy("pos", "alt").agg(F.sum("n").alias("n"), F.sum(F.col("n") * gain).alias("gc_gain"))


@query(f"with {DNA_SQL} select doc_id, 64::bigint as bases, round((64 - len(replace(replace(dna, 'G', ''), 'C', ''))) / 64.0, 12) as gc from dna")
def sequence_statistics(spark, d):
    return dna(spark, d).select("doc_id", F.length("dna").cast("long").alias("bases"), S.gc_fraction("dna").alias("gc"))


@query()
def refget_vrs_ids(spark, d):
    e = edits(spark, d).withColumn("sequence_id", I.refget("dna"))
    e = e.withColumn("location_id", I.vrs_location("sequence_id", "pos", F.col("pos") + 1))
    return e.select("doc_id", "sequence_id", "location_id", I.vrs_allele("location_id", "alt").alias("allele_id"))


MOD = "list_reduce(list_prepend(0, list_transform(string_split(sha256('{0}' || c_custkey::varchar), ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint)), lambda x, y: (x * 16 + y) % {1})"


@query(f"select c_custkey, {MOD.format('split:', 10)}::int as bucket, case when bucket < 7 then 'train' when bucket < 8 then 'val' else 'test' end as split from customer")
def hash_split_mod10(spark, d):
    b = I.hash_bucket("split:", "c_custkey", 10)
    return t(spark, d, "customer").select("c_custkey", b.alias("bucket")).withColumn("split", F.when(F.col("bucket") < 7, "train").when(F.col("bucket") < 8, "val").otherwise("test"))


@query(f"select {MOD.format('fold:', 5)}::int as fold, count(*) as n from customer group by 1")
def hash_fold_mod5(spark, d):
    return t(spark, d, "customer").groupBy(I.hash_bucket("fold:", "c_custkey", 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


CODONS = ", ".join(f"('{a}{b}{c}', '{S.AMINO_ACIDS[16 * i + 4 * j + k]}')" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG"))


@query(f"with {DNA_SQL}, code(codon, aa) as (values {CODONS}), c as (select doc_id, i, aa from (select doc_id, dna, unnest(range(0, 21)) as i from dna) join code on codon = dna[3 * i + 1:3 * i + 3]) select doc_id, split_part(string_agg(aa, '' order by i), '*', 1) as protein from c group by doc_id")
def translate_orf(spark, d):
    return dna(spark, d).select("doc_id", S.translate_frame("dna").alias("protein"))


@query(f"with {DNA_SQL}, p as (select a.doc_id as doc_id, b.doc_id as other, hamming(a.dna, b.dna) as distance from dna a join dna b on a.doc_id <> b.doc_id and a.dna <> b.dna where a.doc_id % 50 = 0) select doc_id, other, distance::int as distance from p qualify rank() over (partition by doc_id order by distance) = 1")
def hamming_nearest(spark, d):
    """For every document whose id is divisible by 50, the nearest of all."""
    rows = dna(spark, d).select("doc_id", "dna")
    return J.nearest_hamming(rows.filter("doc_id % 50 = 0"), rows, "doc_id", "dna")


@query("select p_brand, (dense_rank() over (order by p_brand) - 1)::int as code, n from (select p_brand, count(*) as n from part group by 1)")
def dictionary_encode(spark, d):
    n = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1).cast("long"))
    return Q.running_total(n, "p_brand", "one", "code").select("p_brand", (F.col("code") - 1).cast("int").alias("code"), "n")


@query("select user_id, bit_or(1 << (case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else 3 end))::bigint as mask, count(*) as n from events group by 1")
def feature_masks(spark, d):
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 4).otherwise(8)
    return t(spark, d, "events").groupBy("user_id").agg(F.bit_or(code).cast("long").alias("mask"), F.count(F.lit(1)).alias("n"))


@query("select event_id, len(json_keys(props)) <> len(list_distinct(json_keys(props))) as repeated from events where json_valid(props)")
def json_duplicate_keys(spark, d):
    from ..sources.tables import repeated_keys

    return t(spark, d, "events").select("event_id", repeated_keys("props").alias("repeated")).filter("repeated is not null")


@query(f"with {DNA_SQL} select sum(regexp_full_match(dna, '[ACGT]+')::int)::bigint as acgt, sum(regexp_full_match(text, '[ACGT]+')::int)::bigint as plain, count(*) as n from dna join documents using (doc_id)")
def strict_alphabet(spark, d):
    both = dna(spark, d).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.agg(F.sum(S.valid_alphabet("dna").cast("int")).alias("acgt"), F.sum(S.valid_alphabet("text").cast("int")).alias("plain"), F.count(F.lit(1)).alias("n"))


# Family statistics and rank metrics


@query("with m as (select l_suppkey, avg(l_discount - l_tax) as m, avg(power(l_discount - l_tax, 2)) as q from lineitem group by 1) select round(avg(m), 8) as mean, round(avg(q), 8) as mse, count(*) as families from m")
def family_mse(spark, d):
    x, e = t(spark, d, "lineitem"), F.col("l_discount") - F.col("l_tax")
    m = Q.two_level_mean(x, "l_suppkey", e).select(F.round("mean", 8).alias("mean"), "families")
    return m.crossJoin(F.broadcast(Q.two_level_mean(x, "l_suppkey", e * e).select(F.round("mean", 8).alias("mse"))))


@query("""with n as (select l_suppkey, count(*) as n from lineitem group by 1), w as (select l_quantity as x, l_extendedprice as y, 1.0::double / ((select count(*) from n) * n) as w from lineitem join n using (l_suppkey)),
 s as (select sum(w) as n, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * y) as sxy, sum(w * x * x) as sxx, sum(w * y * y) as syy from w) select round((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 8) as r from s""")
def family_weighted_corr(spark, d):
    w = Q.family_weight(t(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), "l_suppkey")
    return w.agg(F.round(Q.pearson("l_quantity", "l_extendedprice", "weight"), 8).alias("r"))


LAB = "j as (select n_chars as x, quality + 2 * toxic as y, doc_id from documents join labels using (doc_id))"


def labelled(spark, d):
    return t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("x")).join(t(spark, d, "labels").select("doc_id", "quality", (F.col("quality") + 2 * F.col("toxic")).alias("y")), "doc_id")


@query(f"with {LAB}, r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as a, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as b from j) select round(corr(a, b), 8) as rho, count(*) as n from r")
def spearman_avg_rank(spark, d):
    return Q.spearman(labelled(spark, d), "x", "y").select(F.round("rho", 8).alias("rho"), "n")


@query(f"with {LAB}, r as (select row_number() over (order by x, doc_id) as a, row_number() over (order by y, doc_id) as b from j) select round(corr(a, b), 8) as rho, count(*) as n from r")
def spearman_ordinal(spark, d):
    return Q.spearman(labelled(spark, d), "x", "y", ties="ordinal", order="doc_id").select(F.round("rho", 8).alias("rho"), "n")


@query("with j as (select n_chars as x, quality as y from documents join labels using (doc_id)), r as (select y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as a from j) select round((sum(a) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 8) as auroc, count(*) filter (y = 1) as positives, count(*) filter (y = 0) as negatives from r")
def auroc_rank_sum(spark, d):
    return Q.auroc(labelled(spark, d), "x", "quality").select(F.round("auroc", 8).alias("auroc"), "positives", "negatives")


@query("with m as (select l_orderkey, max(l_quantity) as m from lineitem group by 1) select l_orderkey, avg((l_returnflag = 'R')::int::double) as share from lineitem join m using (l_orderkey) where l_quantity = m group by 1")
def top1_tie_share(spark, d):
    return Q.top1_shared(t(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_orderkey", "l_quantity", "y")


@query("select l_orderkey, l_linenumber, round(exp(l_quantity / 10 - max(l_quantity / 10) over w) / sum(exp(l_quantity / 10 - m)) over w, 8) as p from (select *, max(l_quantity / 10) over (partition by l_orderkey) as m from lineitem) window w as (partition by l_orderkey)")
def segment_softmax(spark, d):
    s = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("s"))
    return Q.softmax_by(s, "l_orderkey", "s").select("l_orderkey", "l_linenumber", F.round("p", 8).alias("p"))


CALL = "case when l_tax < 0.01 then 'qc_filtered' when {0} then 'active' else 'silent' end"


@query(f"select {CALL.format('l_quantity >= 25')} as before, {CALL.format('l_quantity * (1 - l_discount) >= 25')} as after, count(*) as n from lineitem group by 1, 2")
def transition_matrix(spark, d):
    call = lambda v: A.window_call(F.array(v), 25.0, 1, 1, "l_tax", 0.01)
    return t(spark, d, "lineitem").groupBy(call(F.col("l_quantity")).alias("before"), call(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("with m as (select median(value) as m from events where value > 0) select event_id, round(asinh(value / m) / ln(2), 8) as y from events, m where value is not null")
def median_scale_asinh(spark, d):
    e = t(spark, d, "events").filter("value is not null").select("event_id", "value")
    m = Q.exact_quantiles(e.filter("value > 0"), "value", {"m": 0.5})
    return e.crossJoin(F.broadcast(m)).select("event_id", F.round(A.asinh_log2("value", "m"), 8).alias("y"))


@query("with s as (select user_id, sum(value) filter (event_type = 'click') as a, sum(value) filter (event_type = 'view') as b, sum(value) filter (event_type = 'purchase') as c, count(*) as n from events group by 1) select user_id, n, case when a > 0 and b > 0 and c > 0 then round(log2(a) - log2(b) - log2(c) + log2(n), 6) end as contrast from s")
def paired_positive_contrast(spark, d):
    v = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    s = t(spark, d, "events").groupBy("user_id").agg(v("click").alias("a"), v("view").alias("b"), v("purchase").alias("c"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "n", F.round(A.log2_contrast("a", "b", "c", "n"), 6).alias("contrast"))


@query("select percentile as q, round(value, 6) as value from (select unnest([0.05, 0.5, 0.95]) as percentile, unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])) as value from lineitem)")
def linear_quantiles(spark, d):
    q = Q.exact_quantiles(t(spark, d, "lineitem"), "l_extendedprice", {"a": 0.05, "b": 0.5, "c": 0.95})
    return q.select(F.expr("stack(3, 0.05D, a, 0.5D, b, 0.95D, c) as (q, value)")).select("q", F.round("value", 6).alias("value"))


@query("select c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean, round(stddev_pop(c_acctbal), 6) as sd, max(c_acctbal) as top, round(median(c_acctbal), 6) as middle from customer group by 1")
def mean_pstdev_median(spark, d):
    b, c = F.col("c_acctbal"), t(spark, d, "customer")
    g = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(b), 6).alias("mean"), F.round(F.stddev_pop(b), 6).alias("sd"), F.max(b).alias("top"))
    return g.join(Q.exact_quantiles(c, "c_acctbal", {"middle": 0.5}, ["c_mktsegment"]), "c_mktsegment").withColumn("middle", F.round("middle", 6))


@query("with g as (select n_regionkey, c_nationkey, count(*) as n, avg(c_acctbal) as m from customer join nation on c_nationkey = n_nationkey group by 1, 2) select n_regionkey, round(avg(m), 6) as mean, sum(n)::bigint as n from g group by 1 union all select null, round(avg(m), 6), sum(n)::bigint from g")
def study_group_rollup(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_regionkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    return g.rollup("n_regionkey").agg(F.round(F.avg("m"), 6).alias("mean"), F.sum("n").alias("n"))


REV = "rev as (select c_nationkey as k, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by 1)"


def revenue(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))


@query(f"with {REV} select round(min((s - v) / (n - 1)), 2) as low, round(max((s - v) / (n - 1)), 2) as high from rev, (select sum(v) as s, count(*) as n from rev)")
def leave_one_out_range(spark, d):
    return Q.leave_one_out(revenue(spark, d), "v").agg(F.round(F.min("others"), 2).alias("low"), F.round(F.max("others"), 2).alias("high"))


@query("select l_quantity, round(sum(n) over (order by l_quantity) / sum(n) over (), 10) as cdf from (select l_quantity, count(*) as n from lineitem group by 1)")
def prefix_cdf(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return Q.running_total(n, "l_quantity", "n", "to").crossJoin(F.broadcast(total)).select("l_quantity", F.round(F.col("to") / F.col("t"), 10).alias("cdf"))


@query("""with h as (select l_quantity as x, count(*)::double as m from lineitem group by 1), p as (select x, m / (select sum(m) from h) as p from h)
 select round((select sum(p * abs(x - 20)) from p) - 0.5 * (select sum(a.p * b.p * abs(a.x - b.x)) from p a, p b), 8) as crps""")
def crps_discrete(spark, d):
    h = t(spark, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).cast("double").alias("m"))
    return Q.crps(h, "l_quantity", "m", 20.0).select(F.round("crps", 8).alias("crps"))


@query("select l_returnflag, round(power(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 6) as effective from lineitem group by 1")
def effective_particles(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(Q.effective_size("l_quantity"), 6).alias("effective"))


@query("select strftime(l_shipdate, '%Y-%m-%d') as day, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def distinct_families(spark, d):
    return t(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


# Joins, islands, graphs


EV = "e as (select event_id, user_id, epoch_us(ts) / 1e6 as s, event_type, value from events)"


def timed(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "event_type", "value")


@query(f"with {EV} select event_id from e where event_type = 'purchase' and not exists (select 1 from e o where o.user_id = e.user_id and o.event_type = 'click' and abs(o.s - e.s) <= 86400)")
def heldout_anti_range(spark, d):
    e = timed(spark, d).select("event_id", "user_id", "s", "event_type")
    return J.within(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), ["user_id"], "s", 86400.0, "left_anti").select("event_id")


ORD = "i as (select o_orderkey as k, o_custkey as c, epoch(o_orderdate) / 86400.0 as s, epoch(o_orderdate) / 86400.0 + 30 + o_orderkey % 60 as f from orders)"


@query(f"with {ORD} select a.k as k, b.k as other from i a join i b on a.c = b.c and a.k < b.k and a.s < b.f and b.s < a.f")
def interval_overlap_pairs(spark, d):
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400.0
    i = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), day.alias("s"), (day + 30 + F.col("o_orderkey") % 60).alias("f"))
    return J.overlaps(i, i, ["c"], "s", "f", 60.0).filter("k < k_r").select("k", F.col("k_r").alias("other"))


@query(f"with {EV}, c as (select * from e where event_type = 'click'), p as (select * from e where event_type = 'purchase') select p.event_id as event_id, round(a.s, 3) as prev_s, round(b.s, 3) as next_s from p asof left join (select distinct user_id, s from c) a on p.user_id = a.user_id and p.s >= a.s asof left join (select distinct user_id, s from c) b on p.user_id = b.user_id and p.s <= b.s")
def nearest_prev_next(spark, d):
    e = timed(spark, d)
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "s")
    c = e.filter("event_type = 'click'").select("user_id", "s", F.col("s").alias("v"))
    return J.as_of(p, c, ["user_id"], "s", "v").select("event_id", F.round("prev_value", 3).alias("prev_s"), F.round("next_value", 3).alias("next_s"))


@query(f"with {EV}, n as (select *, case when s - lag(s) over w > 7200 then 1 else 0 end as new from e window w as (partition by user_id order by s, event_id)), g as (select user_id, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding) as g from n) select user_id, g::bigint as island, count(*) as n from g group by 1, 2")
def gap_islands(spark, d):
    return Q.islands(timed(spark, d).select("user_id", "s"), ["user_id"], "s", 7200.0).groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"))


GRAPH = "g as (select distinct l_partkey as a, -l_suppkey - 1 as b from lineitem)"


@query(f"with recursive {GRAPH}, u as (select a as x, b as y from g union select b, a from g), r(node, family) as (select x, least(x, y) from u union select u.y, r.family from r join u on u.x = r.node where r.family < u.y) select node, min(family) as family from r group by 1")
def connected_families(spark, d):
    g = t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey") - 1).alias("b")).distinct()
    return J.components(g, "a", "b")


@query("with n as (select n_nationkey as a, 1000 + n_regionkey as b from nation union all select 1000 + r_regionkey, 2000 from region) select 0 as node, 0 as hops union all select 1000 + n_regionkey, 1 from nation where n_nationkey = 0 union all select 2000, 2 union all select n_nationkey, 2 from nation where n_nationkey <> 0 and n_regionkey = (select n_regionkey from nation where n_nationkey = 0) union all select 1000 + r_regionkey, 3 from region where r_regionkey <> (select n_regionkey from nation where n_nationkey = 0) union all select n_nationkey, 4 from nation where n_regionkey <> (select n_regionkey from nation where n_nationkey = 0)")
def bfs_hops(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 1000).alias("b"))
    r = t(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("a"), F.lit(2000).alias("b"))
    return J.hops(n.unionByName(r), 0, "a", "b")


@query("select source, lang, doc_id, n_chars from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id) = 1")
def best_row_per_key(spark, d):
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", -F.col("doc_id")))
    return t(spark, d, "documents").groupBy("source", "lang").agg(best.alias("b")).select("source", "lang", "b.doc_id", "b.n_chars")


@query("select sha256(text) as digest, min(doc_id) as doc_id, count(*) as n from documents group by 1")
def dedup_first_wins(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("with s as (select o_custkey as c, list_sort(list(distinct o_orderpriority)) as members from orders group by 1) select members[1] as first, len(members)::int as size, count(*) as n from s group by 1, 2")
def multiset_groups(spark, d):
    s = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("m"))
    return s.groupBy(F.col("m")[0].alias("first"), F.size("m").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as missing from customer where c_custkey not in (select o_custkey from orders)")
def missing_parents(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.unmatched(t(spark, d, "customer"), o, ["c_custkey"]).agg(F.count(F.lit(1)).alias("missing"))


# Resampling and fits


DRAWS = "('0x' || sha256('s1:' || draw::varchar || ':' || slot::varchar)[1:12])::bigint % (select count(*) from f)"


@query(f"with f as (select c_nationkey as k, avg(c_acctbal) as m, row_number() over (order by c_nationkey) - 1 as i from customer group by 1), g as (select draw, slot, {DRAWS} as i from (select unnest(range(0, 200)) as draw), (select i as slot from f)) select draw, round(avg(m), 6) as mean from g join f using (i) group by 1")
def bootstrap_family_draws(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal")
    return Q.bootstrap(c, "k", "c_acctbal", 200, "s1").select("draw", F.round("mean", 6).alias("mean"))


@query(f"with f as (select c_nationkey as k, avg(c_acctbal) as m, row_number() over (order by c_nationkey) - 1 as i from customer group by 1), g as (select draw, slot, {DRAWS} as i from (select unnest(range(0, 200)) as draw), (select i as slot from f)), b as (select avg(m) as mean from g join f using (i) group by draw), s as (select list_sort(list(round(mean, 6))) as a from b) select a[6] as low, a[195] as high from s")
def bootstrap_family_ci(spark, d):
    return Q.order_interval(bootstrap_family_draws(spark, d), "mean", 5, 194)


@query("""with c as (select c_custkey as k, c_acctbal as v, c_mktsegment = 'BUILDING' as y from customer), n as (select count(*) filter (y) as n, avg(v) filter (y) as m from c),
 p as (select draw, v, row_number() over (partition by draw order by sha256('p:' || draw::varchar || ':' || k::varchar)) as r from c, (select unnest(range(0, 50)) as draw)),
 q as (select draw, avg(v) as m from p, n where r <= n.n group by 1) select round((1 + count(*) filter (q.m >= n.m)) / (1.0 + count(*)), 8) as p from q, n""")
def permutation_p(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), (F.col("c_mktsegment") == "BUILDING").alias("y"))
    n = c.agg(F.count_if("y").alias("n"), F.avg(F.when(F.col("y"), F.col("v"))).alias("m"))
    # a row is hashed 50 times, so rows of a small file are dealt to all cores
    dealt = c.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")
    draws = dealt.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("draw"))
    key = F.sha2(F.concat_ws(":", F.lit("p"), "draw", "k").cast("binary"), 256)
    q = Q.smallest_means(draws.withColumn("h", key), ["draw"], "h", "v", n.first()["n"]).crossJoin(F.broadcast(n))
    return q.agg(F.round((1 + F.count_if(F.col("q") >= F.col("m"))) / (1 + F.count(F.lit(1))), 8).alias("p"))


@query("select round(sum(l_quantity * l_quantity), 2) as qq, round(sum(l_quantity * l_discount), 4) as qd, round(sum(l_discount * l_discount), 6) as dd, round(sum(l_quantity * l_tax), 4) as qt, round(sum(l_discount * l_tax), 6) as dt from lineitem")
def gram_matrix(spark, d):
    g, y = Q.gram(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_tax")
    # one row of five sums, whatever the table
    row = (round(float(g[0, 0]), 2), round(float(g[0, 1]), 4), round(float(g[1, 1]), 6), round(float(y[0]), 4), round(float(y[1]), 6))
    return spark.createDataFrame([row], "qq double, qd double, dd double, qt double, dt double")


@query("""with s as (select sum(l_quantity * l_quantity) + 1 as a, sum(l_quantity * l_discount) as b, sum(l_discount * l_discount) + 1 as c, sum(l_quantity * l_extendedprice) as u, sum(l_discount * l_extendedprice) as v from lineitem)
 select round((c * u - b * v) / (a * c - b * b), 4) as quantity, round((a * v - b * u) / (a * c - b * b), 4) as discount from s""")
def ridge_2feature(spark, d):
    b = Q.ridge(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 1.0)
    return spark.range(1).select(F.round(F.lit(float(b[0])), 4).alias("quantity"), F.round(F.lit(float(b[1])), 4).alias("discount"))


@query("""with g as (select l_returnflag as k, sum(l_quantity * l_quantity) as a, sum(l_quantity * l_extendedprice) as u from lineitem group by 1), s as (select sum(a) as a, sum(u) as u from g)
 select k as held_out, round((s.u - g.u) / (s.a - g.a + 1), 6) as slope from g, s""")
def loo_group_ridge(spark, d):
    g = Q.leave_group_out_ridge(t(spark, d, "lineitem"), "l_returnflag", ["l_quantity"], "l_extendedprice", 1.0)
    return g.select(F.col("group").alias("held_out"), F.round(F.col("coefficients")[0], 6).alias("slope"))


# Simulators: rows are checked by invariants in the tests

SPEC = {
    "genes": ["a", "b", "c"], "basal": [0.1, 0.05, 0.2], "input": [2.0, 1.0, 0.0], "binding": [1.0, 0.5, 0.0], "production": [0.5, 0.5, 0.5], "decay": [0.5, 0.5, 0.5],
    "repression": [[0, 1, 2], [2, 0, 1], [3, 1, 0]], "cooperativity": [[1, 2, 2], [2, 1, 2], [2, 2, 1]],
}


@query()
def ode_steady_state(spark, d):
    """The circuit's state for each supplier's signal and each ratio of its parts;
    equal ones are solved once."""
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_suppkey") % 11 / 10).alias("signal"), (0.5 + F.col("l_partkey") % 5 / 4).alias("ratio")).distinct()
    s = X.steady_states(x, SPEC)
    return s.select("key", "ratio", "signal", F.transform("state", lambda x: F.round(x, 6)).alias("state"), A.label_of_max("state", SPEC["genes"], 0.2).alias("fate"))


@query()
def lif_spikes(spark, d):
    """A network for each nation: its customers' balances stimulate cells."""
    c = t(spark, d, "customer")
    jumps = c.select(F.col("c_nationkey").alias("network"), (F.col("c_custkey") % 60).cast("double").alias("time"), (F.col("c_custkey") % 5).alias("cell"), F.lit(0.7).alias("jump"))
    pairs = t(spark, d, "nation").select(F.col("n_nationkey").alias("network"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("source")).withColumn("target", (F.col("source") + F.col("network") + 1) % 5)
    return X.network_spikes(jumps, pairs.filter("source <> target"))


@query()
def dinuc_shuffle(spark, d):
    return dna(spark, d).select("doc_id", "dna", X.dinucleotide_shuffle_udf("dna", "doc_id").alias("shuffled"))


@query()
def motif_log_partition(spark, d):
    w = np.log(np.array([[0.7, 0.1, 0.1, 0.7], [0.1, 0.1, 0.7, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.1, 0.1]]) / 0.25).tolist()
    both = X.motif_log_z(X.motif_log_z(mutants(spark, d).select("doc_id", "dna", "mutant"), "dna", w).withColumnRenamed("log_z", "z0"), "mutant", w)
    return both.select("doc_id", F.round("z0", 8).alias("log_z"), F.round(F.col("log_z") - F.col("z0"), 8).alias("delta"))


# Event-time extras


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def events_tumbling(spark, d):
    from ..streaming.events import tumbling

    e = tumbling(t(spark, d, "events"), "1 hour", ["event_type"])
    return e.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("with n as (select user_id, ts, case when ts - lag(ts) over w > interval '2 hours' then 1 else 0 end as new from events window w as (partition by user_id order by ts)), g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from n) select user_id, min(ts) as session_start, count(*) as n from g group by user_id, g")
def events_session(spark, d):
    from ..streaming.events import sessions

    s = sessions(t(spark, d, "events"), "2 hours", ["user_id"])
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")
