"""Queries over inverse design and graphs of records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inverse, lineage
from ..operators.joins import stored
from ..operators.statistics import running_total
from .registry import query, t
from .scans import RATIO, UNIFORM, _response, parts

SIGNAL = "(case when right(p_brand, 1)::int % 2 = 0 then 0.4 else 0.2 end)"


@query(f"""with e as (select p_brand as locus, p_partkey as id, {RATIO} as ratio, p_size as place, {SIGNAL} as s from part),
sets as (select locus, s, [id] as ids, ratio, 1 as size from e
    union all select a.locus, a.s, [a.id, b.id], a.ratio * b.ratio, 2 from e a join e b on a.locus = b.locus and a.id < b.id and a.place <> b.place),
c as (select *, round(ratio * s / (1 + ratio * s) - s / (1 + s), 9) as change, ratio * s / (1 + ratio * s) > 0.5 as hit from sets),
least as (select locus, min(size) as size from c where hit group by 1),
r as (select c.*, (row_number() over (partition by locus order by change desc, ids))::int as rank from c join least using (locus, size) where hit qualify rank <= 8),
d as (select *, locus || ':' || array_to_string(ids, ',') as name, unnest(range(0, 40)) as draw from r),
f as (select *, 0.7 + 0.6 * {UNIFORM.format(seed='c', id='name')} as f from d),
p as (select locus, size, ids, ratio, change, rank, avg((ratio * f * s / (1 + ratio * f * s) > 0.5)::int) as probability from f group by all)
select locus, size::int as size, array_to_string(ids, ',') as ids, ratio, change, rank, round(probability, 8) as probability,
    row_number() over (partition by locus order by probability desc, rank) = 1 as best from p""")
def reprogrammed_loci(spark, d):
    """Each brand's smallest sets of parts that switch it on, and how robust."""
    edits = t(spark, d, "part").select(F.col("p_size").alias("place"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("locus"), (0.25 + (F.col("p_partkey") % 13) / 4.0).alias("ratio"))
    signal = F.when(F.substring("locus", -1, 1).cast("int") % 2 == 0, 0.4).otherwise(0.2)
    loci = edits.select("locus").distinct().select("locus", signal.alias("signal"), F.lit(True).alias("wanted"))
    found = inverse.compiled_edits(inverse.edit_sets(edits, loci, _response, 0.5), _response, 0.5, 40, "c", 0.3)
    return found.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")).withColumn("probability", F.round("probability", 8))


@query(f"with p as (select p_brand as locus, p_partkey as id, {RATIO} as ratio from part), b as (select p_brand as locus, p_partkey as other_id, {RATIO} as other from part where p_size < 6), j as (select p.locus, p.id, b.other_id, b.other, abs(p.ratio * b.other - 1) as gap from p join b on p.locus = b.locus and p.id <> b.other_id) select locus, id, other_id, round(gap, 8) as gap, (row_number() over (partition by locus, id order by gap, other, other_id))::int as rank from j qualify rank <= 3")
def second_site_rescues(spark, d):
    """The three small parts of a brand that best undo each part's ratio."""
    few = t(spark, d, "part").filter("p_size < 6").select(F.col("p_brand").alias("locus"), F.col("p_partkey").alias("id"), (0.25 + (F.col("p_partkey") % 13) / 4.0).alias("ratio"))
    return inverse.nearest_products(parts(spark, d).select("locus", "id", "ratio"), few, 3).withColumn("gap", F.round("gap", 8))


LINKS = """link as (select c_custkey as node, c_custkey // 3 as above from customer where c_custkey > 2
    union select c_custkey, c_custkey // 5 from customer where c_custkey > 4
    union select c_custkey, c_custkey * 3 from customer where c_custkey % 500 = 7 and c_custkey * 3 <= (select max(c_custkey) from customer))"""


@query(f"""with recursive {LINKS},
reach as (select node, above from link union select r.node, l.above from reach r join link l on l.node = r.above),
cyclic as (select distinct node from reach where node = above),
faulty as (select distinct node, node in (select node from cyclic) as on_cycle from reach where above in (select node from cyclic) or node in (select node from cyclic)),
path as (select c_custkey as node, c_custkey as spot, 0 as steps from customer where c_custkey not in (select node from faulty)
    union select p.node, l.above, p.steps + 1 from path p join link l on l.node = p.spot),
depth as (select node, max(steps) as level, count(distinct spot) - 1 as above from path group by 1)
select c_custkey as node, depth.level::bigint as level, depth.above::bigint as above, case when on_cycle then 'cycle' when not on_cycle then 'below a cycle' end as fault
from customer left join depth on depth.node = c_custkey left join faulty on faulty.node = c_custkey""")
def feature_levels(spark, d):
    """Depth and ancestors of customers as features, each part of one and derived
    from another; a few refer to what is below them."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    last = c.select(F.max("node").alias("last"))
    part = c.filter("node > 2").select("node", F.expr("node div 3").alias("above"))
    derived = c.filter("node > 4").select("node", F.expr("node div 5").alias("above"))
    back = c.filter("node % 500 = 7").join(F.broadcast(last), F.col("node") * 3 <= F.col("last")).select("node", (F.col("node") * 3).alias("above"))
    return lineage.levels(c, "node", part.unionByName(derived).unionByName(back), "node", "above")


def _tree(spark, d):
    """Lines, their orders, and groups of ten, a hundred and a thousand keys."""
    lines = stored(t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag")))
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    line = F.concat(F.lit("line "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    order = lambda key: F.concat(F.lit("order "), key.cast("string"))
    group = lambda key, h: F.concat(F.lit(f"group{h} "), F.floor(key / 10**h).cast("string"))
    o = F.col("o_orderkey")
    artifacts = lines.select(line.alias("id"), F.col("flag").alias("payload")).unionByName(orders.select(order(o).alias("id"), F.col("o_orderstatus").alias("payload")))
    refs = lines.select(order(F.col("l_orderkey")).alias("id"), line.alias("ref")).unionByName(orders.select(group(o, 1).alias("id"), order(o).alias("ref")))
    for h in (1, 2, 3):
        g = orders.select(group(o, h).alias("id"), F.lit(f"height {h}").alias("payload"), group(o, h + 1).alias("up")).distinct()
        artifacts = artifacts.unionByName(g.select("id", "payload"))
        refs = refs.unionByName(g.filter(F.lit(h < 3)).select(F.col("up").alias("id"), F.col("id").alias("ref")))
    return artifacts, refs



@query("""with line as (select 'line ' || l_orderkey || '-' || l_linenumber as id, l_orderkey as k, sha256(min(l_returnflag) || chr(10)) as digest from lineitem group by l_orderkey, l_linenumber),
refs as (select k, string_agg(digest, ',' order by id) as parts from line group by k),
ord as (select 'order ' || o_orderkey as id, o_orderkey as k, o_orderkey % 2003 = 5 as gone, sha256(o_orderstatus || chr(10) || coalesce(parts, '')) as digest, parts is null as leaf from orders left join refs on k = o_orderkey),
g1 as (select k // 10 as k, bool_or(gone) as gone, sha256('height 1' || chr(10) || string_agg(digest, ',' order by id)) as digest, max((not leaf)::int) + 1 as level from ord group by 1),
g2 as (select k // 10 as k, bool_or(gone) as gone, sha256('height 2' || chr(10) || string_agg(digest, ',' order by 'group1 ' || k)) as digest, max(level) + 1 as level from g1 group by 1),
g3 as (select k // 10 as k, bool_or(gone) as gone, sha256('height 3' || chr(10) || string_agg(digest, ',' order by 'group2 ' || k)) as digest, max(level) + 1 as level from g2 group by 1),
every as (select id, 0 as level, digest, false as gone, false as missing from line union all select id, case when leaf then 0 else 1 end, digest, gone, gone from ord
    union all select 'group1 ' || k, level, digest, gone, false from g1 union all select 'group2 ' || k, level, digest, gone, false from g2 union all select 'group3 ' || k, level, digest, gone, false from g3)
select id, case when not gone then level end::bigint as level, case when not gone then digest end as digest,
    case when missing then 'missing reference' when gone then 'below a fault' when ('0x' || digest[1:4])::int % 101 = 3 then 'stated digest' end as fault from every""")
def replayed_artifacts(spark, d):
    """A tree of sealed artifacts of which some state another digest and some
    refer to what isn't there."""
    artifacts, refs = _tree(spark, d)
    altered = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") % 101 == 3
    stated = lineage.sealed(artifacts, refs).withColumn("stated", F.when(altered, F.reverse("digest")).otherwise(F.col("digest")))
    lost = t(spark, d, "orders").filter("o_orderkey % 2003 = 5").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("id"), F.lit("line lost").alias("ref"))
    return lineage.replayed(stated, refs.unionByName(lost))


@query("""with dna as (select doc_id, translate(sha256(text), '0123456789abcdef', 'ACGTACGTACGTACGT') as dna from documents)
select 'doc' || doc_id as record_id, 64::bigint as bases, sha256(dna) as sha256 from dna where 'doc' || doc_id >= 'doc3'""")
def fasta_records(spark, d):
    """Documents' DNA written as FASTA and read by its grammar, in ranges that
    records cross, with a condition that the reader applies."""
    import uuid

    from ..operators.joins import checkpointed
    from ..sources import plugin
    from .registry import dna

    folder = f"{checkpointed(spark.range(0)).sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/fasta-{uuid.uuid4().hex}"
    record = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" of "), "family", F.lit("\n"), F.regexp_replace("dna", "(.{30})", "$1\n"))
    dna(spark, d).select(record.alias("value")).write.text(folder)
    plugin.register(spark)
    read = spark.read.format("helix_fasta").option("split", 50_000).option("pin", plugin.FASTA.digest()).option("where", plugin.where(("record_id", ">=", "doc3"))).load(folder)
    return read.select("record_id", "bases", F.sha2("sequence", 256).alias("sha256"))


SITES = """dna as (select doc_id, lang, translate(sha256(text), '0123456789abcdef', 'ACGTACGTACGTACGT') as dna from documents),
whole as (select lang, string_agg(dna, '' order by doc_id) as s from dna group by lang),
site as (select doc_id, lang, (row_number() over (partition by lang order by doc_id) - 1) * 64 + doc_id % 64 as start, case when doc_id % 9 = 0 then 'N' else dna[(doc_id % 64) + 1] end as ref from dna)"""


@query(f"""with {SITES}, w as (select doc_id, start, ref, s, s[start - 99:start + 156] as w from site join whole using (lang))
select doc_id as id, start::bigint as start, case when start < 100 or length(w) < 256 then 'off the end' when s[start + 1] <> ref then 'reference differs' end as fault,
    case when start >= 100 and length(w) = 256 and s[start + 1] = ref then sha256(w) end as sha256 from w""")
def reference_windows(spark, d):
    """256 bases about each document's edit, in a record a language that its
    documents' DNA makes, kept in chunks of 1000 bases."""
    from ..sources.chunks import chunked, windows

    lines = t(spark, d, "documents").select(F.col("lang").alias("record_id"), F.col("doc_id").alias("place"), F.translate(F.sha2(F.col("text").cast("binary"), 256), "0123456789abcdef", "ACGTACGTACGTACGT").alias("bases"))
    one = lines.withColumn("n", F.lit(1).cast("long"))
    numbered = running_total(one, ["record_id", "place"], "n", "to")
    first = numbered.groupBy("record_id").agg(F.min("to").alias("first"))
    ref = F.when(F.col("place") % 9 == 0, "N").otherwise(F.col("bases").substr((F.col("place") % 64 + 1).cast("int"), F.lit(1)))
    sites = numbered.join(first, "record_id").select(F.col("place").alias("id"), "record_id", ((F.col("to") - F.col("first")) * 64 + F.col("place") % 64).alias("start"), ref.alias("ref"))
    found = windows(sites, chunked(lines, 1000), 100, 256, 1000)
    return found.select("id", "start", "fault", F.sha2("window", 256).alias("sha256"))


@query()
def decoy_controls(spark, d):
    """Each document's DNA against 19 shuffles of its own: how many of them have
    the motif's potential or more."""
    from ..operators import motifs, scans, simulate
    from .registry import dna
    from .scans import RULED

    s = dna(spark, d).select("doc_id", F.col("dna").alias("sequence"))
    rated = lambda x: motifs.motif_endpoints(x, RULED[:1], once=False).withColumn("v", F.round(F.col("potential")[0], 9))
    drawn = simulate.decoys(s, "doc_id", "sequence", 19, "d").withColumnRenamed("decoy", "sequence")
    return scans.empirical_p(rated(s), rated(drawn), ["doc_id"], "v").withColumn("p", F.round("p", 10))


RECORDS = """rec as (select c_custkey as c, 'f' || c_custkey as id, c_mktsegment as kind from customer),
link as (select c as node, c // 3 as above from rec where c > 2 union select c, c // 5 from rec where c > 4),
path as (select c as node, c as spot, 0 as steps from rec union select p.node, l.above, p.steps + 1 from path p join link l on l.node = p.spot),
depth as (select node, max(steps) as level, count(distinct spot) - 1 as above from path group by 1),
every as (select id, lower(kind) as kind, level, above, case when c % 400 = 9 then 'missing parent' end as fault from rec join depth on node = c)"""


def _gff3_features(spark, d):
    """Customers as GFF3 features that refer to each other, written as files and
    read by the grammar."""
    import uuid

    from ..operators.joins import checkpointed
    from ..sources import plugin

    folder = f"{checkpointed(spark.range(0)).sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/gff3-{uuid.uuid4().hex}"
    c = F.col("c_custkey")
    ref = lambda n: F.when(c >= n, F.concat(F.lit("f"), F.floor(c / n).cast("string")))
    tag = lambda name, *ids: F.when(F.size(F.array_compact(F.array(*ids))) > 0, F.concat(F.lit(name + "="), F.concat_ws(",", *ids)))
    attributes = F.concat_ws(";", F.concat(F.lit("ID=f"), c.cast("string")), tag("Parent", ref(3), F.when(c % 400 == 9, "nowhere")), tag("Derives_from", ref(5)))
    line = F.concat_ws("\t", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("."), F.lower("c_mktsegment"), (c + 1).cast("string"), (c + 9).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    t(spark, d, "customer").select(F.concat(F.lit("##gff-version 3\n"), line).alias("value")).write.text(folder)
    plugin.register(spark)
    return spark.read.format("helix_gff3").option("split", 200_000).load(folder)


@query(f"""with recursive {RECORDS}
select e.id, kind, unit, level::bigint as level, above::bigint as above, fault
from every e left join (select id, (row_number() over (order by level, id) - 1)::bigint as unit from every where fault is null) n on n.id = e.id""")
def compiled_records(spark, d):
    """Units of a feature table read as GFF3, in an order that follows its edges."""
    return lineage.compiled_graph(_gff3_features(spark, d), {"Parent": "part_of", "Derives_from": "derives_from"})[0]


@query(f"""with recursive {RECORDS}, n as (select id, (row_number() over (order by level, id) - 1)::bigint as unit from every where fault is null),
e as (select 'f' || c as id, 'f' || (c // 3) as other, 'part_of' as relation from rec where c > 2 union all select 'f' || c, 'f' || (c // 5), 'derives_from' from rec where c > 4)
select a.unit as child, b.unit as parent, relation from e join n a on a.id = e.id join n b on b.id = e.other""")
def compiled_record_edges(spark, d):
    return lineage.compiled_graph(_gff3_features(spark, d), {"Parent": "part_of", "Derives_from": "derives_from"})[1]
