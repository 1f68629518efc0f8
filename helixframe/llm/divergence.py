"""Source divergence audit by joint count histograms.

Per language, each term that enough documents have is kept. A group is a source
within a language; p of a count is the group's smoothed share of a term in
billionths. Two sources differ by the sum of abs(p - q) over all kept terms.

That sum only depends on how often each pair of counts (a, b) occurs. Terms that
both sources have are tallied where their counts meet; the cells with a zero
follow without any term being looked at again: each source's own histogram less
what the joint cells hold gives (a, 0) and (0, b), and the number of kept terms
less all of these gives (0, 0). f is evaluated once for each combination.

Counts are summed in each batch of documents and again before each shuffle. A
term's row holds the sources that have it, and pairs of those are tallied in
blocks of bounded size, never sent as rows of their own. All arithmetic is exact:
products beyond 64 bits are decimals.

Nulls: null text, lang or source is ''. Texts are read whole, however long. Ties
in value go to the smaller item in UTF-8. A repeated row counts as a document of
its own; a table without rows has no groups and so no result; ids and other
columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct (group, term) entries a task holds before it hands them on.
HELD = 1 << 19
#: Pairs of a term's sources that are tallied at once.
BLOCK = 1 << 20
SCALE, SMOOTH = 1_000_000_000, 5


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed as far as
    a task goes without holding more than HELD of them."""
    find = re.compile(TERM).findall
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            found = find(text.lower() if text.isascii() else text.encode().lower().decode())
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from handed()
    yield from handed()


def term_counts(documents: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, sources, counts), the sources that have the term
    in order and how often, and the groups (lang, source, total, v): occurrences
    of kept terms, and kept terms of the language. Both are tables of their own."""
    prepare(documents.sparkSession)
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = docs.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
    # one shuffle for both sums: a source's rows of a term lie with the term's
    by_source = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    have = by_source.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("have"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    terms = have.select("lang", "term", F.col("have.source").alias("sources"), F.col("have.n").alias("counts")).checkpoint()
    totals = each_source(terms).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    return terms, groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v")).checkpoint()


def each_source(terms: DataFrame) -> DataFrame:
    """(lang, source, term, n) of kept terms that the group has."""
    return terms.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("z")).select("lang", F.col("z.sources").alias("source"), "term", F.col("z.counts").alias("n"))


def share(count: F.Column, total: F.Column, v: F.Column) -> F.Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * v)), exactly; of a
    group without terms, 1."""
    top = (count.cast("decimal(20,0)") + F.lit(SMOOTH)).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")
    bottom = (total.cast("decimal(20,0)") + (v * SMOOTH).cast("decimal(20,0)")).cast("decimal(21,0)")
    return F.lit(1).cast("long") + F.coalesce(F.call_function("div", top, F.nullif(bottom, F.lit(0).cast("decimal(21,0)"))), F.lit(0))


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers from 0, and how often each occurs."""
    spans = [int(c.max()) + 1 for c in columns]
    if math.prod(spans) < 1 << 62:  # a row is one number then
        key = columns[0]
        for c, span in zip(columns[1:], spans[1:], strict=True):
            key = key * span + c
        _, at, m = np.unique(key, return_index=True, return_counts=True)
        return [c[at] for c in columns], m
    cells, m = np.unique(np.stack(columns), axis=1, return_counts=True)
    return list(cells), m


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (lang, sources, counts), one a term with its sources in order:
    how often each (lang, s, t, a, b) occurs, s before t."""
    for batch in batches:
        lists = batch.column("sources")
        names = lists.flatten().dictionary_encode()
        source, count = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # every place but a term's last is paired with those behind it
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row))
        behind = starts[row] + sizes[row] - 1 - place
        at = 0
        while at < len(place):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(behind[at:]), BLOCK, "right")))
            first = np.repeat(place[at:to], behind[at:to])
            ends = np.cumsum(behind[at:to])
            second = first + 1 + np.arange(len(first)) - np.repeat(ends - behind[at:to], behind[at:to])
            at = to
            if not len(first):
                continue
            cells, m = _distinct([lang[row[first]], source[first], source[second], count[first], count[second]])
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(cells[0])), names.dictionary.take(pa.array(cells[1])), names.dictionary.take(pa.array(cells[2])), pa.array(cells[3]), pa.array(cells[4]), pa.array(m.astype(np.int64))], ["lang", "s", "t", "a", "b", "m"])


def joint_histograms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, s, t, a, b, m): of two sources s < t of a language, how many kept
    terms s has a times and t has b times, zeros included."""
    both = terms.filter(F.size("sources") > 1).select("lang", "sources", "counts")
    cells = both.mapInArrow(_tally, "lang string, s string, t string, a long, b long, m long").groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m"))
    # a cell of both takes its terms out of either side's own, and out of no side twice
    struct = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    zero, a, b, m = F.lit(0).cast("long"), F.col("a"), F.col("b"), F.col("m")
    joint = cells.select("lang", "s", "t", F.explode(F.array(struct(a, b, m), struct(a, zero, -m), struct(zero, b, -m), struct(zero, zero, m))).alias("c"))
    # all pairs of sources are the result's rows; salts spread a language of many
    salts = 16
    left = groups.select("lang", F.col("source").alias("s"), "v", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int").alias("salt"))
    right = groups.select("lang", F.col("source").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = left.join(right, ["lang", "salt"]).filter("s < t")
    own = each_source(terms).groupBy("lang", "source", F.col("n").alias("a")).agg(F.count(F.lit(1)).alias("m"))
    of_s = pairs.select("lang", "s", "t").join(own.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "t", F.explode(F.array(struct(a, zero, m), struct(zero, zero, -m))).alias("c"))
    of_t = pairs.select("lang", "s", "t").join(own.withColumnRenamed("source", "t"), ["lang", "t"]).select("lang", "s", "t", F.explode(F.array(struct(zero, a, m), struct(zero, zero, -m))).alias("c"))
    every = pairs.select("lang", "s", "t", struct(zero, zero, F.col("v")).alias("c"))
    united = joint.unionByName(of_s).unionByName(of_t).unionByName(every)
    return united.groupBy("lang", "s", "t", F.col("c.a").alias("a"), F.col("c.b").alias("b")).agg(F.sum("c.m").alias("m"))


def pair_divergences(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source against each other one of its
    language."""
    s = groups.select("lang", F.col("source").alias("s"), F.col("total").alias("ns"), "v")
    t = groups.select("lang", F.col("source").alias("t"), F.col("total").alias("nt"))
    cells = joint_histograms(terms, groups).join(s, ["lang", "s"]).join(t, ["lang", "t"])
    f = F.abs(share(F.col("a"), F.col("ns"), F.col("v")) - share(F.col("b"), F.col("nt"), F.col("v")))
    value = cells.groupBy("lang", "s", "t").agg(F.sum(F.when(F.col("m") == 0, F.lit(0)).otherwise(F.col("m") * f)).cast("long").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    return value.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def term_divergences(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source has more of than its
    language."""
    whole = terms.withColumn("all_n", F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n))
    each = whole.select("lang", "term", "all_n", F.explode(F.arrays_zip("sources", "counts")).alias("z")).select("lang", F.col("z.sources").alias("source"), "term", "all_n", F.col("z.counts").alias("n"))
    language = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    rows = each.join(groups, ["lang", "source"]).join(language, "lang")
    f = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("all_n"), F.col("all_total"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), f.alias("value")).filter("value > 0")


def audit(documents: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other
    sources of the language by how much they differ, part `term` the ``top``
    terms that stand out."""
    terms, groups = term_counts(documents, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [d.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order)) for part, d in (("pair", pair_divergences(terms, groups)), ("term", term_divergences(terms, groups)))]
    return parts[0].unionByName(parts[1].filter(F.col("rank") <= top)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
