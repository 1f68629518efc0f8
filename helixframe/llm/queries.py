"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byte_bpe, cover_tree, divergence, graph_search, licences, lm, ngram_jaccard, packing, quality, substring_dedup, turns, unigram
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """The pattern that splits texts before the rank files' merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.event_digests(turns.replay(table(spark, sf_dir, "conversations"), batches=12, idle=3))


def op13_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), stable=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: From a relation link(a, b), both ways: the smallest id reachable from each.
_REACH = """reach(id, root) as (select a, least(a, b) from link union
  select l.b, r.root from reach r join link l on l.a = r.id where r.root < l.b),
component as (select id, min(root) as root from reach group by id)"""

SQL = {
    "op2_ngram_jaccard_join": f"""
with recursive word as (select doc_id, {_WORDS} as w from documents),
shingle as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from word),
size as (select doc_id, count(*) as n from shingle group by doc_id),
link as (select x.doc_id as a, y.doc_id as b from shingle x join shingle y on x.s = y.s and x.doc_id <> y.doc_id
    join size p on p.doc_id = x.doc_id join size q on q.doc_id = y.doc_id
    group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))),
{_REACH}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(root, d.doc_id) as component_id
from documents d left join size using (doc_id) left join component c on c.id = d.doc_id""",
}

SQL["op4_embedding_near_dedup"] = f"""
with recursive fit as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null
    and list_sum(list_transform(embedding, lambda x: x * x)) > 0),
link as (select x.vec_id as a, y.vec_id as b from fit x join fit y on x.label = y.label and x.vec_id <> y.vec_id
    where list_cosine_similarity(x.v, y.v) >= 0.93),
{_REACH},
degree as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept
from embeddings left join degree on a = vec_id left join component on id = vec_id"""

SQL["op11_source_divergence"] = r"""
with doc as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
word as (select r, lang, source, unnest(w) as term from doc),
kept as (select lang, term from word group by lang, term having count(distinct r) >= 30),
n as (select lang, source, term, count(*) as n from word join kept using (lang, term) group by all),
size as (select lang, count(*) as v from kept group by lang),
grp as (select lang, source, coalesce(sum(n.n), 0) as total, coalesce(any_value(v), 0) as v
    from (select distinct lang, source from doc) left join n using (lang, source) left join size using (lang) group by lang, source),
whole as (select lang, sum(total) as total from grp group by lang),
cell as (select lang, source, term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 5)) // (total + 5 * v) as p
    from grp join kept using (lang) left join n using (lang, source, term)),
every as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) as q
    from n join whole using (lang) join size using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from cell x join cell y using (lang, term)
    where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
    from grp a join grp b on a.lang = b.lang and a.source <> b.source),
term as (select lang, source, term as item, (p - q)::bigint as value from cell join every using (lang, term) where n > 0 and p > q),
ranked as (select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item collate "binary")::int as rank
    from (select *, 'pair' as part from pair union all by name select *, 'term' as part from term))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
