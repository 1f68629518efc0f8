"""Queries over assay-like operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sequence as S
from ..operators import assays as Y
from ..operators import collections as C
from ..operators import statistics as Q
from ..operators.joins import checkpointed
from .registry import DNA_SQL, EDITS_SQL, dna, edits, query, t

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query(f"with {DNA_SQL} select doc_id, case when dna[6] = 'A' then null else dna[1:5] || 'TT' || dna[7:20] || 'ACG' || dna[21:40] || dna[43:64] end as mutated, 3::bigint as n_edits from dna")
def multi_edit_records(spark, d):
    x = dna(spark, d)
    edit = lambda s, e, alt, ref=None: x.select("doc_id", "dna", F.lit(s).alias("s"), F.lit(e).alias("e"), (ref if ref is not None else F.col("dna").substr(s + 1, e - s)).alias("r"), F.lit(alt).alias("a"))
    # the first edit names the wrong base where the letter is an A
    wrong = F.when(F.col("dna").substr(6, 1) == "A", "C").otherwise(F.col("dna").substr(6, 1))
    every = edit(5, 6, "TT", wrong).unionByName(edit(20, 20, "ACG")).unionByName(edit(40, 42, ""))
    return Y.apply_edits(every, "doc_id", "dna", "s", "e", "r", "a")


@query(f"with {EDITS_SQL} select doc_id, dna[greatest(pos - 9, 0) + 1:least(pos + 10, 64)] as sequence, (pos - greatest(pos - 9, 0))::int as position from edits")
def cropped_edits(spark, d):
    return edits(spark, d).select("doc_id", Y.crop("dna", "pos", 9).alias("c")).select("doc_id", "c.*")


@query(f"with {EDITS_SQL}, p as (select doc_id, pos as locked, dna, unnest(range(0, 64)) as pos from edits), e as (select doc_id, pos, dna[pos + 1] as ref, unnest(['A','C','G','T']) as alt from p where pos <> locked) select ref, alt, count(*) as n, sum(pos)::bigint as places from e where ref <> alt group by 1, 2")
def second_site_edits(spark, d):
    e = edits(spark, d).select("doc_id", "dna", F.col("pos").alias("locked"))
    return Y.second_sites(e, "dna", "locked").groupBy("ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query(f"with {DNA_SQL}, w as (select doc_id, dna, unnest(range(0, 62)) as i from dna), h as (select doc_id, i, case when dna[i + 1:i + 3] = 'GAT' then '+' when dna[i + 1:i + 3] = {RC.format(chr(39) + 'GAT' + chr(39))} then '-' end as strand from w) select doc_id, min(i)::int as start, min(strand) as strand from h where strand is not null group by 1 having count(*) = 1")
def unique_motif_places(spark, d):
    return dna(spark, d).select("doc_id", Y.unique_place("dna", F.lit("GAT")).alias("p")).filter("p is not null").select("doc_id", "p.start", "p.strand")


@query(f"with {DNA_SQL}, a as (select doc_id, dna, dna[9:16] as l, dna[21:28] as r from dna), w as (select *, unnest(range(0, 57)) as i from a), n as (select doc_id, any_value(dna) as dna, count(*) filter (dna[i + 1:i + 8] = l) as nl, count(*) filter (dna[i + 1:i + 8] = r) as nr from w group by 1) select doc_id, 16 as start, 20 as \"end\", dna[17:20] as ref, 'ACGTA' as alt from n where nl = 1 and nr = 1")
def donor_edits(spark, d):
    e = Y.donor_edit("dna", F.col("dna").substr(9, 8), F.lit("ACGTA"), F.col("dna").substr(21, 8))
    return dna(spark, d).select("doc_id", e.alias("e")).filter("e is not null").select("doc_id", "e.*")


@query("with c as (select doc_id, (doc_id * 7) % 64 + 1 as s, (doc_id * 7) % 64 + 1 + doc_id % 40 as e from documents) select doc_id, s - 1 as start, least(e, 64)::bigint as \"end\" from c union all select doc_id, 0, e - 64 from c where e > 64")
def circular_intervals(spark, d):
    s = (F.col("doc_id") * 7) % 64 + 1
    c = t(spark, d, "documents").select("doc_id", F.explode(Y.half_open(s, s + F.col("doc_id") % 40, F.lit(64))).alias("i"))
    return c.select("doc_id", "i.start", "i.end")


@query("with b as (select 'c' || (p_partkey // 100 % 3)::varchar as chrom, min(p_partkey) as s, min(p_partkey) + 60 as e, 'c' || (p_partkey // 100 % 2)::varchar as to_chrom, min(p_partkey) * 2 + 7 as to_start from part group by p_partkey // 100, 1, 4), p as (select distinct 'c' || (l_partkey // 100 % 3)::varchar as chrom, l_partkey as at from lineitem) select p.chrom, p.at, case when b.to_chrom = p.chrom then b.to_start + p.at - b.s end as lifted from p left join b on p.chrom = b.chrom and b.s <= p.at and p.at < b.e")
def lifted_points(spark, d):
    block = F.floor(F.col("p_partkey") / 100)
    name = lambda c, m: F.concat(F.lit("c"), (F.floor(F.col(c) / 100) % m).cast("string"))
    chain = t(spark, d, "part").groupBy(block.alias("ordinal"), name("p_partkey", 3).alias("chrom"), name("p_partkey", 2).alias("to_chrom")).agg(F.min("p_partkey").alias("start"))
    chain = chain.withColumn("end", F.col("start") + 60).withColumn("to_start", F.col("start") * 2 + 7)
    p = t(spark, d, "lineitem").select(name("l_partkey", 3).alias("chrom"), F.col("l_partkey").alias("at")).distinct()
    return Y.lift_over(p, chain, "chrom", "at", 100.0)


@query("with c as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal end as v from customer) select c_custkey, round(coalesce(v, (select avg(v) from c where c_custkey % 10 < 7)), 6) as v from c")
def training_mean_fill(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("v"))
    return Y.fill_with_training_mean(c, "v", F.col("c_custkey") % 10 < 7).withColumn("v", F.round("v", 6))


@query("select case when o_totalprice < 1000 then 'too_small' when o_totalprice > 300000 then 'too_large' when o_orderstatus not in ('F', 'O') then 'bad_status' end as code, count(*) as n from orders group by 1")
def refusal_codes(spark, d):
    p = F.col("o_totalprice")
    code = Y.first_refusal([("too_small", p < 1000), ("too_large", p > 300000), ("bad_status", ~F.col("o_orderstatus").isin("F", "O"))])
    return t(spark, d, "orders").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("with s as (select stddev_pop(c_acctbal) as a, stddev_pop(c_custkey % 97) as b from customer) select c_custkey, round(0.3 * c_acctbal / a + 0.7 * (c_custkey % 97) / b, 6) as blend from customer, s")
def blended_scores(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 97).alias("k"))
    return Y.scaled_blend(c, "c_acctbal", "k", 0.3).select("c_custkey", F.round("blend", 6).alias("blend"))


@query("with f as (select c_custkey, c_acctbal as y, 1.0 / (count(*) over (partition by c_nationkey) * (select count(distinct c_nationkey) from customer)) as w from customer), m as (select sum(w * y) as m from f), s as (select sqrt(sum(w * (y - m) * (y - m))) as s from f, m) select c_custkey, round((y - m) / s, 6) as standardised from f, m, s")
def standardised_response(spark, d):
    from ..operators.statistics import family_weight

    c = family_weight(t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey")
    return Y.standardised(c, "c_acctbal", "weight").select("c_custkey", F.round("standardised", 6).alias("standardised"))


@query("select l_linenumber, count(*) as n from lineitem where 0 <= l_linenumber and l_linenumber <= l_quantity and l_quantity <= 40 group by 1")
def in_bounds(spark, d):
    return t(spark, d, "lineitem").filter((F.col("l_linenumber") >= 0) & (F.col("l_linenumber") <= F.col("l_quantity")) & (F.col("l_quantity") <= 40)).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("select l_partkey, sum(l_quantity) as support from lineitem group by 1 having sum(l_quantity) >= 500")
def supported_parts(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("support")).filter("support >= 500")


@query("with v as (select user_id, event_type, var_samp(value) as noise, count(*) as n from events group by 1, 2) select user_id, event_type, n from v where event_type <> 'click' or noise <= 400")
def noise_filtered(spark, d):
    v = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.var_samp("value").alias("noise"), F.count(F.lit(1)).alias("n"))
    return v.filter((F.col("event_type") != "click") | (F.col("noise") <= 400)).select("user_id", "event_type", "n")


@query("select l_orderkey, l_returnflag, count(*) as n from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(distinct l_returnflag) = 1) group by 1, 2")
def unambiguous_orders(spark, d):
    return Y.unambiguous(t(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("select case when abs(round(l_discount - 0.05, 6)) <= 0.01 and l_returnflag = 'N' then 'doubly_silent' when abs(round(l_discount - 0.05, 6)) <= 0.01 then 'reporter_silent' when l_returnflag <> 'N' then 'concordant' else 'reporter_only' end as category, count(*) as n from lineitem group by 1")
def cell_categories(spark, d):
    c = C.category(F.round(F.col("l_discount") - 0.05, 6), F.col("l_returnflag") != "N", 0.01)
    return t(spark, d, "lineitem").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey from orders where o_orderkey % 11 = 0 or o_orderkey % 13 = 0")
def replay_differences(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    again = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 13 == 0, 1e-3).otherwise(1e-11))
    return Y.replay_differs(o, again, ["o_orderkey"], ["o_totalprice"])


@query("with m as (select l_suppkey, count(*) as n, sum(l_discount) as a, sum(l_discount * l_discount) as b from lineitem group by 1) select l_suppkey, a >= 0 and a <= n * 0.07 * (1 + 1e-12) and b <= 0.07 * a * (1 + 1e-12) and b + 1e-9 >= a * a / n as admissible from m")
def moment_checks(spark, d):
    m = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_discount").alias("a"), F.sum(F.col("l_discount") * F.col("l_discount")).alias("b"))
    return m.select("l_suppkey", Y.admissible_moments("a", "b", F.col("n"), 0.07).alias("admissible"))


IV = "iv as (select l_suppkey as k, (l_orderkey % 5000)::bigint as s, (l_orderkey % 5000 + l_quantity)::bigint as e from lineitem)"


def intervals(spark, d):
    at = (F.col("l_orderkey") % 5000).cast("long")
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), at.alias("s"), (F.col("l_orderkey") % 5000 + F.col("l_quantity")).cast("long").alias("e"))


@query(f"with {IV}, p as (select k, s, e, coalesce(max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding), 0) as b from iv), g as (select k, b as gap_start, s as gap_end from p where s > b union all select k, max(e), 6000 from iv group by k having max(e) < 6000) select k, gap_start, gap_end::bigint as gap_end from g")
def source_gaps(spark, d):
    return Y.uncovered(intervals(spark, d).withColumn("n", F.lit(6000).cast("long")), "k", "s", "e", "n")


@query(f"with {IV}, p as (select k, s, e, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as b from iv) select k, count(*) as n, sum(s)::bigint as places from p where b > s group by 1")
def overlap_detection(spark, d):
    return Y.overlapping(intervals(spark, d), "k", "s", "e").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("places"))


@query("select c.c_custkey, coalesce(a.v, b.v) as parent_value from customer c left join (select s_suppkey as k, min(s_acctbal) as v from supplier where s_suppkey % 2 = 0 group by 1) a on a.k = c.c_custkey left join (select s_nationkey as k, min(s_acctbal) as v from supplier group by 1) b on b.k = c.c_nationkey")
def parents_by_name_or_region(spark, d):
    s = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("name"), F.col("s_nationkey").alias("region"), "s_acctbal")
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    return Y.with_parent(c, s, "c_custkey", "c_nationkey", "name", "region", "s_acctbal").select("c_custkey", "parent_value")


@query("with a as (select l_partkey % 50 as chrom, l_suppkey as pos, case when l_linenumber % 2 = 0 then 'Ref' else 'Alt' end as allele, sum(l_quantity) as rna, sum(l_linenumber) as dna from lineitem group by all), r as (select * from a where allele = 'Ref'), b as (select * from a where allele = 'Alt') select r.chrom, r.pos, round(log2((b.rna + 0.5) / (b.dna + 0.5)) - log2((r.rna + 0.5) / (r.dna + 0.5)), 6) as effect from r join b on r.chrom = b.chrom and r.pos = b.pos where r.dna >= 10 and b.dna >= 10")
def allele_effects(spark, d):
    allele = F.when(F.col("l_linenumber") % 2 == 0, "Ref").otherwise("Alt")
    a = t(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("chrom"), F.col("l_suppkey").alias("pos"), allele.alias("allele"), F.col("l_quantity").alias("rna"), F.col("l_linenumber").alias("dna"))
    return Y.allele_effect(a, ["chrom", "pos"], "allele", "rna", "dna", 10).select("chrom", "pos", F.round("effect", 6).alias("effect"))


@query("with e as (select 'G' || (c_custkey % 40)::varchar || '.' || (c_custkey % 3)::varchar as gene_id, c_nationkey % 3 as chrom from customer), g as (select 'G' || s_suppkey::varchar as gene, s_nationkey % 3 as chrom, s_suppkey * 10 as tss from supplier) select split_part(gene_id, '.', 1) as gene, count(*) as n, max(tss) as tss from e join g on split_part(gene_id, '.', 1) = gene and e.chrom = g.chrom group by 1")
def genes_of_same_chromosome(spark, d):
    gene = F.concat(F.lit("G"), (F.col("c_custkey") % 40).cast("string"), F.lit("."), (F.col("c_custkey") % 3).cast("string"))
    e = t(spark, d, "customer").select(Y.versionless(gene).alias("gene"), (F.col("c_nationkey") % 3).alias("chrom"))
    g = t(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene"), (F.col("s_nationkey") % 3).alias("chrom"), (F.col("s_suppkey") * 10).alias("tss"))
    return e.join(g, ["gene", "chrom"]).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max("tss").alias("tss"))


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 7 <> 0)")
def broken_relationships(spark, d):
    return Y.missing_targets(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").filter("c_custkey % 7 <> 0"), "o_custkey", "c_custkey")


@query("select l_suppkey as sample, sum(l_quantity)::bigint as dna, sum(l_linenumber)::bigint as rna, count(*) as support from lineitem group by 1")
def paired_bincount(spark, d):
    return C.paired_counts(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("long").alias("dna"), F.col("l_linenumber").cast("long").alias("rna")), ["sample"], "dna", "rna")


@query("with s as (select l_partkey as locus, l_returnflag as culture, l_linestatus as time, sum(l_quantity) as counts from lineitem group by all) select locus, culture, time, counts from s")
def pooled_parents(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_partkey").alias("locus"), F.col("l_returnflag").alias("culture"), F.col("l_linestatus").alias("time"), "l_quantity")
    return s.groupBy("locus", "culture", "time").agg(F.sum("l_quantity").alias("counts"))


@query("select c_custkey, 1.0::double / count(*) over (partition by c_nationkey, c_mktsegment) as weight from customer")
def inverse_frequency_weights(spark, d):
    return Y.inverse_frequency(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "weight")


@query("with s as (select avg(value) as m, stddev_pop(value) as s from events where value is not null), w as (select event_id, value, 1 / (1 + exp(-2 * (value - m) / s)) as w from events, s where value is not null), q as (select quantile_cont(w, 0.8) as q from w) select event_id, round(w, 6) as multiplier from w, q where w >= q - 1e-12")
def conserved_top_fifth(spark, d):
    w = Y.conservation_multiplier(t(spark, d, "events").filter("value is not null").select("event_id", "value"), "value")
    q = Q.exact_quantiles(w, "multiplier", {"q": 0.8})
    return w.crossJoin(F.broadcast(q)).filter("multiplier >= q - 1e-12").select("event_id", F.round("multiplier", 6).alias("multiplier"))


CDF = "m as (select p_size as k, count(*) as n from part group by 1), c as (select k, sum(n) over (order by k) / (select sum(n) from m) as f from m), b as (select k, greatest(f - 0.02, 0) as lo, least(f + 0.02, 1) as hi from c)"


def cdf(spark, d):
    m = t(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = m.agg(F.sum("n").alias("total"))
    # sizes are few, whatever the number of parts
    f = F.sum("n").over(Window.orderBy("k")) / F.col("total")
    return m.crossJoin(F.broadcast(total)).select("k", F.greatest(f - 0.02, F.lit(0.0)).alias("lo"), F.least(f + 0.02, F.lit(1.0)).alias("hi"))


@query(f"with {CDF} select round(avg(case when k < 25 then lo * lo else (1 - hi) * (1 - hi) end), 8) as low, round(avg(case when k < 25 then hi * hi else (1 - lo) * (1 - lo) end), 8) as high from b")
def cdf_enclosure(spark, d):
    return Y.enclosure_loss(cdf(spark, d), "k", "lo", "hi", 25).select(F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query("with m as (select l_suppkey as k, sum(l_discount) as a, sum(l_discount * l_discount) as b from lineitem group by 1), v as (select k, a, greatest(0, (b - a * a / 2000) / 1999) as v from m) select k, round(greatest(0, a / 2000 - sqrt(2 * v * 3 / 2000) - 7 * 0.1 * 3 / (3 * 1999)), 8) as low, round(least(0.1, a / 2000 + sqrt(2 * v * 3 / 2000) + 7 * 0.1 * 3 / (3 * 1999)), 8) as high from v")
def bernstein_intervals(spark, d):
    m = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_discount").alias("a"), F.sum(F.col("l_discount") * F.col("l_discount")).alias("b"))
    i = Y.bernstein_interval("a", "b", 2000, 0.1, 3.0)
    return m.select("k", F.round(i["low"], 8).alias("low"), F.round(i["high"], 8).alias("high"))


@query("with p as (select n_regionkey as k, 1 + count(*) as a, 2 + sum(n_nationkey % 3) as b from nation group by 1), g as (select k, a, b, unnest(range(0, 7)) as i from p), l as (select k, i, coalesce(sum(ln(6 - (i - 1)) + ln(a + i - 1) - ln(i) - ln(b + 6 - i)) filter (i > 0) over (partition by k order by i), 0) as l from g where true), x as (select k, i, exp(l - max(l) over (partition by k)) as x from l) select k, i::int as i, round(x / sum(x) over (partition by k), 10) as p from x")
def beta_binomial_mass(spark, d):
    g = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg((1 + F.count(F.lit(1))).alias("a"), (2 + F.sum(F.col("n_nationkey") % 3)).alias("b"))
    return g.select("k", F.posexplode(Y.pooled_mass("a", "b", F.lit(6))).alias("i", "p")).select("k", "i", F.round("p", 10).alias("p"))


@query("with c as (select c_nationkey as col, c_mktsegment as base, avg(c_acctbal + 1100) as m from customer group by 1, 2) select col, base, round(ln(m) - avg(ln(m)) over (partition by col), 8) as centred from c")
def column_centred_logs(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("col"), F.col("c_mktsegment").alias("base")).agg(F.avg(F.col("c_acctbal") + 1100).alias("m"))
    return C.centred_logs(c, "col", "m").select("col", "base", F.round("centred", 8).alias("centred"))


@query("with r as (select c_nationkey as col, c_mktsegment as aa, avg(c_acctbal) as m, count(*) as n from customer group by 1, 2), w as (select n_nationkey as col, unnest(['BUILDING', 'NONE']) as aa from nation), f as (select col, sum(m * n) / sum(n) as m from r group by 1) select w.col, w.aa, round(coalesce(r.m, f.m), 6) as mean from w left join r using (col, aa) join f on f.col = w.col")
def conditional_means(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("col"), F.col("c_mktsegment").alias("aa"), F.col("c_acctbal").alias("v"))
    w = t(spark, d, "nation").select(F.col("n_nationkey").alias("col"), F.explode(F.array(F.lit("BUILDING"), F.lit("NONE"))).alias("aa"))
    return C.conditional_mean(w, c, "col", "aa", "v").select("col", "aa", F.round("mean", 6).alias("mean"))


@query("select user_id as trace, count(distinct event_type) as cells, count(*) as segments, round(sum(value), 4) as length, count(*) filter (event_type = 'purchase') as synapses from events group by 1")
def trace_summaries(spark, d):
    return C.trace_summary(t(spark, d, "events"), "user_id", "event_type", "value", F.col("event_type") == "purchase").withColumn("length", F.round("length", 4)).withColumnRenamed("user_id", "trace")


@query("with r as (select l_orderkey as k, string_agg(l_partkey::varchar || ':' || l_linenumber::varchar, '|' order by l_linenumber, l_partkey) as s from lineitem group by 1) select k, sha256(s) as digest from r")
def ordered_digests(spark, d):
    line = F.concat_ws(":", "l_partkey", "l_linenumber")
    return C.ordered_digest(t(spark, d, "lineitem").withColumn("x", line), "l_orderkey", ["l_linenumber", "l_partkey"], "x").withColumnRenamed("l_orderkey", "k")


DAY = "d as (select event_type as k, date_trunc('day', ts)::date as day, count(*) as n from events group by 1, 2)"


def daily(spark, d):
    return t(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {DAY}, w as (select *, lag(n) over v as b, lead(n) over v as a from d window v as (partition by k order by day)), m as (select * from w where b < n and n >= a) select k, day, n, (day - lag(day) over (partition by k order by day))::int as period from m")
def local_maxima(spark, d):
    return Y.local_maxima(daily(spark, d).withColumn("at", F.datediff("day", F.lit("1970-01-01"))), "k", "at", "n").select("k", "day", "n", "period")


@query(f"with {DAY}, w as (select k, day, n % 3 as s, lead(n % 3) over v as a, lead(day) over v as next_at from d window v as (partition by k order by day)) select k, day as at, next_at, s as before, a as after from w where a <> s")
def state_transitions(spark, d):
    return Y.transitions(daily(spark, d).withColumn("s", F.col("n") % 3), "k", "day", "s")


@query("with q as (select quantile_cont(abs(c_acctbal), 0.9) as q, median(c_acctbal) as m from customer) select c_custkey, c_acctbal > m as upper from customer, q where abs(c_acctbal) >= q")
def top_decile(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    c = c.withColumn("size", F.abs("c_acctbal"))
    q, m = Q.exact_quantiles(c, "size", {"q": 0.9}), Q.exact_quantiles(c, "c_acctbal", {"m": 0.5})
    return c.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(m)).filter(F.abs("c_acctbal") >= F.col("q")).select("c_custkey", (F.col("c_acctbal") > F.col("m")).alias("upper"))


@query("with r as (select o_custkey as k, o_totalprice as v, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) select k, round(sum(v) filter (i % 2 = 1), 4) as odd, round(coalesce(sum(v) filter (i % 2 = 0), 0), 4) as even from r group by 1")
def replicate_halves(spark, d):
    v = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"])
    h = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(Y.halves(v).alias("h"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4)
    return h.select("k", total("h.odd").alias("odd"), total("h.even").alias("even"))


@query("with p as (select l_orderkey as k, 'P' || l_partkey::varchar as part, sum(l_quantity - 25) as v from lineitem group by 1, 2), r as (select *, row_number() over (partition by k order by abs(v) desc, part) as r from p) select k, list(part order by r) as parts from r where r <= 5 group by 1")
def top_motif_parts(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part")).agg(F.sum(F.col("l_quantity") - 25).alias("v"))
    return Y.top_parts(p, "k", "part", "v", 5)


@query("select p_partkey, p_size, p_retailprice from part order by p_size % 2 <> 0, -p_size, -p_retailprice, p_partkey limit 40")
def candidate_order(spark, d):
    return C.candidate_sort(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), [F.col("p_size") % 2 != 0, -F.col("p_size"), -F.col("p_retailprice"), F.col("p_partkey")]).limit(40)


@query("select p_partkey, round(p_size + 0.05 * p_retailprice, 6) as score from part order by score, p_partkey limit 30")
def pareto_order(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(C.pareto_score("p_size", "p_retailprice"), 6).alias("score")).orderBy("score", "p_partkey").limit(30)


@query("select c_mktsegment, c_custkey from customer qualify row_number() over (partition by c_mktsegment order by c_custkey) <= 7")
def stratified_subset(spark, d):
    return Y.stratified(t(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 7)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by abs(l_quantity - 25) desc, abs(l_discount), l_linenumber, l_quantity) = 1")
def featured_edit(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_quantity") - 25).alias("delta"))
    x = x.withColumn("id", F.struct("l_linenumber", "l_quantity"))
    return Y.featured(x, ["l_orderkey"], "delta", "l_discount", "id").select("l_orderkey", "featured.l_linenumber", "featured.l_quantity")


@query("with n as (select distinct text as name from documents where text is not null) select sha256(name) as name, (row_number() over (order by encode(name)) - 1)::bigint as place from n")
def byte_order(spark, d):
    n = t(spark, d, "documents").filter("text is not null").select(F.col("text").alias("name")).distinct()
    return C.ranked(n, "name", "place").select(F.sha2(F.col("name").cast("binary"), 256).alias("name"), "place")


@query("select 'customer' as study, c_nationkey as k, round(sum(c_acctbal), 4) as total from customer group by 2 union all select 'supplier', s_nationkey, round(sum(s_acctbal), 4) from supplier group by 2")
def study_union(spark, d):
    one = lambda n, k, v: t(spark, d, n).groupBy(F.col(k).alias("k")).agg(F.round(F.sum(v), 4).alias("total")).select(F.lit(n).alias("study"), "k", "total")
    return one("customer", "c_nationkey", "c_acctbal").unionByName(one("supplier", "s_nationkey", "s_acctbal"))


@query("with u as (select c_custkey as k, c_acctbal as v from customer where c_custkey % 2 = 0 union all select c_custkey, c_acctbal + 1 from customer where c_custkey % 3 = 0 union all select c_custkey, null from customer) select k, max(v) as v from u group by 1")
def merged_shards(spark, d):
    c = t(spark, d, "customer")
    shard = lambda m, add: c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % m == 0, F.col("c_acctbal") + add).otherwise(float("nan")).alias("v"))
    return Y.merge_shards([shard(2, 0.0), shard(3, 1.0)], "k", "v")


@query(f"with {EDITS_SQL}, u as (select dna as s from seqs union select mutant from seqs) select len(s)::int as length, count(*) as n from u group by 1")
def distinct_sequences(spark, d):
    from .registry import mutants

    m = mutants(spark, d)
    return m.select(F.col("dna").alias("s")).unionByName(m.select(F.col("mutant").alias("s"))).distinct().groupBy(F.length("s").alias("length")).agg(F.count(F.lit(1)).alias("n"))


#: A nine-base consensus and weights of single substitutions: fixed values.
CONSENSUS = "GACCACCCA"


@query(f"with {DNA_SQL}, w as (select doc_id, unnest(range(0, 56)) as i, dna from dna), s as (select doc_id, i, dna[i + 1:i + 9] as site, hamming(dna[i + 1:i + 9], '{CONSENSUS}') as h from w), c as (select *, list_filter(range(1, 10), lambda j: site[j] <> '{CONSENSUS}'[j]) as chg from s where h <= 1) select doc_id, i::int as i, site, (case when len(chg) = 0 then null else chg[1] end)::int as changed, round(case when len(chg) = 0 then 1.0 else 1.0 / (1 + chg[1]) end, 8) as ratio from c")
def single_site_ratios(spark, d):
    w = dna(spark, d).select("doc_id", F.posexplode(S.kmers("dna", 9)).alias("i", "site"))
    table = [[1.0 / (2 + k)] * 4 for k in range(9)]
    p = C.site_profile("site", CONSENSUS, table)
    return w.withColumn("p", p).filter("p is not null").select("doc_id", "i", "site", "p.changed", F.round("p.ratio", 8).alias("ratio"))


@query("with x as (select p_partkey, p_size, 'name chr' || (p_partkey % 22 + 1)::varchar || ':' || p_partkey::varchar || '-' || (p_partkey + p_size)::varchar || ' rest' as s from part) select p_partkey, 'chr' || (p_partkey % 22 + 1)::varchar as chrom, p_partkey as start, p_partkey + p_size as \"end\" from x")
def parsed_loci(spark, d):
    s = F.concat(F.lit("name chr"), (F.col("p_partkey") % 22 + 1).cast("string"), F.lit(":"), F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit(" rest"))
    return t(spark, d, "part").select("p_partkey", Y.locus(s).alias("l")).select("p_partkey", "l.*")


@query("select doc_id, true as same from documents")
def shuffles_keep_pairs(spark, d):
    from ..operators.simulate import dinucleotide_shuffle_udf

    shuffled = checkpointed(dna(spark, d).select("doc_id", "dna", dinucleotide_shuffle_udf("dna", "doc_id").alias("x")))
    return shuffled.select("doc_id", C.same_pairs("dna", "x").alias("same"))


@query("select 'anon:' || sha256(coalesce(len(c_name)::varchar || ':' || c_name, '-') || '|' || coalesce(len(c_mktsegment)::varchar || ':' || c_mktsegment, '-')) as id, count(*) as n from customer group by 1")
def anonymous_ids(spark, d):
    return t(spark, d, "customer").groupBy(Y.anonymous_id("c_name", "c_mktsegment").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("with w as (select l_partkey as k, avg(asinh(l_discount * 10)) / ln(2) as m from lineitem where l_linenumber = 1 group by 1) select l_orderkey, l_linenumber, round(asinh(l_quantity / 10) / ln(2) - m, 6) as delta from lineitem join w on k = l_partkey where l_linenumber > 1")
def delta_targets(spark, d):
    x = t(spark, d, "lineitem")
    wt = x.filter("l_linenumber = 1").groupBy("l_partkey").agg(F.avg(A.asinh_log2(F.col("l_discount") * 10, F.lit(1.0))).alias("m"))
    return x.filter("l_linenumber > 1").join(wt, "l_partkey").select("l_orderkey", "l_linenumber", F.round(A.asinh_log2("l_quantity", F.lit(10.0)) - F.col("m"), 6).alias("delta"))


@query("select p_partkey, round((p_retailprice + 0.05) / (p_size + 0.05), 8) as q, round(exp(0.4 * ln((p_retailprice + 0.05) / (p_size + 0.05))), 8) as gated from part")
def gated_affinity(spark, d):
    q = C.affinity_ratio("p_size", "p_retailprice", 0.05)
    return t(spark, d, "part").select("p_partkey", F.round(q, 8).alias("q"), F.round(C.chromatin_gate(q, F.lit(0.4)), 8).alias("gated"))


@query("select o_custkey as k, round(quantile_cont(o_totalprice, 0.3), 4) as q from orders group by 1")
def array_quantiles(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(Y.array_quantile(F.collect_list("o_totalprice"), 0.3), 4).alias("q"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderdate::date end as date from orders")
def insdc_dates(spark, d):
    x = F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    bad = F.concat(F.lit("31-FEB-"), F.date_format("o_orderdate", "yyyy"))
    return t(spark, d, "orders").select("o_orderkey", Y.insdc_date(F.when(F.col("o_orderkey") % 5 == 0, bad).otherwise(x)).alias("date"))


@query("select l_suppkey, (sum(l_extendedprice::decimal(38,12)))::double as total from lineitem group by 1")
def exact_sums(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(Y.exact_sum("l_extendedprice").alias("total"))


@query("with h as (select c_nationkey as k, corr(c_acctbal, c_custkey) as r from customer group by 1) select k, round(2 * r / (1 + r), 6) as ceiling from h")
def noise_ceiling(spark, d):
    return t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.corr("c_acctbal", "c_custkey").alias("r")).select("k", F.round(Y.split_half_ceiling("r"), 6).alias("ceiling"))


# Collections and graphs

VARIANTS = f"with {DNA_SQL}, v as (select doc_id, dna, (doc_id % 50)::int as s, (doc_id % 3)::int as n, case doc_id % 4 when 0 then 'A' when 1 then 'CG' when 2 then 'TTT' else '' end as alt from dna), e as (select *, dna[s + 1:s + n] as ref from v where not (n = 0 and alt = '') and dna[s + 1:s + n] <> alt)"


def raw_variants(spark, d):
    n = (F.col("doc_id") % 3).cast("int")
    s = (F.col("doc_id") % 50).cast("int")
    alt = F.when(F.col("doc_id") % 4 == 0, "A").when(F.col("doc_id") % 4 == 1, "CG").when(F.col("doc_id") % 4 == 2, "TTT").otherwise("")
    v = dna(spark, d).select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), s.alias("start"), (s + n).alias("end"), F.col("dna").substr(s + 1, n).alias("ref"), alt.alias("alt"))
    return v.filter("not (start = `end` and alt = '') and ref <> alt")


def records(spark, d):
    return dna(spark, d).select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.col("dna").alias("sequence"))


@query(VARIANTS + " select 'v' || doc_id::varchar as id, 'r' || doc_id::varchar as record_id, case when n = 1 and len(alt) = 1 then 'snv' when n = 0 then 'insertion' when alt = '' then 'deletion' when n = len(alt) then 'mnv' else 'delins' end as edit_kind, s as start, s + n as \"end\", ref, alt, sha256(dna) as sequence_sha256, (64 - n + len(alt))::bigint as mutated_bases, sha256(dna[1:s] || alt || dna[s + n + 1:64]) as mutated_sequence_sha256 from e")
def variant_collection(spark, d):
    """Digests that DuckDB lacks (SHA-512) are checked in the tests."""
    c = C.compile_variants(raw_variants(spark, d), records(spark, d))
    return c.select("id", "record_id", "edit_kind", "start", "end", "ref", "alt", "sequence_sha256", "mutated_bases", "mutated_sequence_sha256")


_PREFIX = "coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] <> {b}[i])) - 1, least(length({a}), length({b})))"


@query(VARIANTS + ", x as (select doc_id, dna[s + 1 - 2:s + n + 3] as a, dna[s + 1 - 2:s] || alt || dna[s + n + 1:s + n + 3] as b from e where s >= 2), p as (select *, " + _PREFIX.format(a="a", b="b") + " as p from x), r as (select doc_id, p, length(a) as size, a[p + 1:] as a, b[p + 1:] as b, reverse(a[p + 1:]) as ra, reverse(b[p + 1:]) as rb from p), s as (select *, " + _PREFIX.format(a="ra", b="rb") + " as s from r) select doc_id, p::int as start, (size - s)::int as \"end\", a[1:length(a) - s] as ref, b[1:length(b) - s] as alt from s")
def padded_edit_spans(spark, d):
    """Edits written with two letters before and three behind, trimmed to what
    they change: substitutions, insertions and deletions."""
    r = raw_variants(spark, d).filter("start >= 2").join(records(spark, d), "record_id")
    before, behind = F.col("sequence").substr(F.col("start") - 1, F.lit(2)), F.col("sequence").substr(F.col("end") + 1, F.lit(3))
    span = S.edit_span(F.concat(before, "ref", behind), F.concat(before, "alt", behind))
    return r.select(F.substring("record_id", 2, 20).cast("long").alias("doc_id"), span.alias("span")).select("doc_id", "span.*")


@query("select o_orderkey as unit, count(*) as intervals, min(l_quantity)::bigint as low, max(l_quantity)::bigint as high, sum(l_quantity)::bigint as total, bool_or(l_returnflag = 'R') as reverse, bit_or(1 << (l_linenumber % 8))::bigint as mask from orders join lineitem on l_orderkey = o_orderkey group by 1")
def dense_fields(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("size"), (F.col("l_returnflag") == "R").alias("reverse"), (F.col("l_linenumber") % 8).alias("kind"))).alias("segments"))
    x = x.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("unit")), "unit", "left_semi")
    return C.dense_fields(x, "unit", "segments")


@query("with e as (select distinct l_orderkey % 500 as a, l_partkey % 700 as b from lineitem) select count(*) filter (a < 400 and b < 600) as edges, count(*) filter (a >= 400 or b >= 600) as out_of_bounds, 900::bigint as units from e")
def edge_budget(spark, d):
    e = t(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("a"), (F.col("l_partkey") % 700).alias("b")).distinct()
    return C.edge_budget(e, "a", "b", 400, 600, F.lit(900).cast("long"))
