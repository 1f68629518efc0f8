"""Contracts between tables: closed JSON documents, chains of digests, bundles,
and an independent replay of compiled variants."""

from __future__ import annotations

import hashlib
from base64 import urlsafe_b64encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.sequence import col
from ..sources.tables import closed_schema

#: A target's fixed-point fields, and a policy's.
TARGET = "name string, units long, fields array<struct<name:string,kind:string,fraction_bits:int>>, rules array<string>"
POLICY = "version int, limits map<string,long>, operations array<string>"


def parsed(text, ddl: str, names: list[str]) -> Column:
    """The document as a struct; null unless it has exactly these members, each
    once, and every value has its type."""
    t = col(text)
    value = F.from_json(t, ddl, {"mode": "PERMISSIVE"})
    whole = F.lit(True)
    for n in names:
        whole &= value[n].isNotNull()
    return F.when(closed_schema(t, names) & F.coalesce(whole, F.lit(False)), value)


def parse_target(text) -> Column:
    return parsed(text, TARGET, ["name", "units", "fields", "rules"])


def parse_policy(text) -> Column:
    return parsed(text, POLICY, ["version", "limits", "operations"])


def fixed_point(value, fraction_bits: int, low: int = -(2**63), high: int = 2**63 - 1) -> Column:
    """A number as a scaled integer, to the nearest, halves to even, within the
    bounds of its kind."""
    v, one = col(value), F.lit(1 << fraction_bits).cast("decimal(19,0)")
    scaled = F.bround(v.try_cast("decimal(38,18)") * one, 0)
    rough = v.cast("double") * float(1 << fraction_bits)
    return F.when(rough <= low, F.lit(low)).when(rough >= high, F.lit(high)).otherwise(scaled.cast("long"))


def broken_chain(manifests: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request, fault) of provider exchanges: a request names its manifest's
    digest, a response its request's. Each has columns digest and body (text)
    whose SHA-256 the digest is; requests have manifest, responses request."""
    own = lambda d: d.withColumn("_ok", F.sha2(F.col("body").cast("binary"), 256) == F.col("digest"))
    m = own(manifests).select(F.col("digest").alias("manifest"), F.col("_ok").alias("_m"))
    r = own(requests).select(F.col("digest").alias("request"), "manifest", F.col("_ok").alias("_r"))
    a = own(responses).groupBy("request").agg(F.count(F.lit(1)).alias("_n"), F.min("_ok").alias("_a"))
    chain = r.join(m, "manifest", "left").join(a, "request", "left")
    fault = F.when(~F.col("_r"), "request's digest").when(F.col("_m").isNull(), "no manifest").when(~F.col("_m"), "manifest's digest").when(F.col("_n").isNull(), "no response").when(F.col("_n") > 1, "two responses").when(~F.col("_a"), "response's digest")
    return chain.withColumn("fault", fault).filter("fault is not null").select("request", "fault")


def bundle_faults(bundles: DataFrame, parts: DataFrame, required: list[str]) -> DataFrame:
    """(bundle, role, fault): roles that a bundle lacks, has twice, or whose
    digest no part has. bundles: bundle, role, digest; parts: digest."""
    want = bundles.select("bundle").distinct().withColumn("role", F.explode(F.array(*map(F.lit, required))))
    have = bundles.groupBy("bundle", "role").agg(F.count(F.lit(1)).alias("_n"), F.min("digest").alias("digest"))
    known = parts.select("digest", F.lit(True).alias("_k")).distinct()
    j = want.join(have, ["bundle", "role"], "full").join(known, "digest", "left")
    fault = F.when(~F.col("role").isin(required), "unknown role").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "twice").when(F.col("_k").isNull(), "no such part")
    return j.withColumn("fault", fault).filter("fault is not null").select("bundle", "role", "fault")


def joined_tensors(df: DataFrame, tensors: DataFrame, key: str, digest: str) -> DataFrame:
    """df with the numbers that a provider computed for its rows: key, numbers,
    digest of the row that they were computed for. A row without its tensor, or
    with one for other content, raises."""
    t = tensors.select(key, F.col("numbers"), F.col("digest").alias("_d"))
    j = df.join(t, key, "left")
    bad = F.col("_d").isNull() | (F.col("_d") != F.col(digest))
    return j.filter(F.when(bad, F.raise_error(F.concat(F.lit("no tensor for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_d")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, faults = [], []
        for r in batch.to_pylist():
            s, a, b = r["sequence"], r["start"], r["end"]
            fault = None
            if s is None or a is None or b is None or not 0 <= a <= b <= len(s) or s[a:b] != r["ref"]:
                fault = "reference"
            else:
                m = (s[:a] + r["alt"] + s[b:]).encode()
                if hashlib.sha256(m).hexdigest() != r["mutated_sequence_sha256"] or len(m) != r["mutated_bases"]:
                    fault = "mutated sequence"
                elif "SQ." + urlsafe_b64encode(hashlib.sha512(m).digest()[:24]).decode() != r["mutated_refget_id"]:
                    fault = "refget id"
            if fault:
                ids.append(r["id"])
                faults.append(fault)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(faults, pa.string())], ["id", "fault"])


def replay_variants(compiled: DataFrame, records: DataFrame) -> DataFrame:
    """(id, fault) of compiled variants that plain Python, and not the compiler's
    expressions, can't reproduce from the records."""
    j = compiled.select("id", "record_id", "start", "end", "ref", "alt", "mutated_bases", "mutated_sequence_sha256", "mutated_refget_id").join(records.select("record_id", "sequence"), "record_id", "left")
    return j.mapInArrow(_replayed, "id string, fault string")


def insdc_units(genbank: DataFrame) -> DataFrame:
    """One row of numbers for each feature of a GenBank table: place in its
    record, segments, bases, ends, strands, fuzzy ends, qualifiers, and masks of
    what its segments and qualifiers hold."""
    f = genbank.select("record_id", F.col("length").alias("record_bases"), F.explode("features").alias("f")).select("record_id", "record_bases", "f.*")
    fuzz = lambda side: F.size(F.filter("segments", lambda s: s[side].isNotNull()))
    bits = lambda pairs: sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(pairs)), F.lit(0))
    strand = lambda n: F.exists("segments", lambda s: s["orientation"] == n)
    has = lambda q: F.exists("qualifiers", lambda x: x["name"] == q)
    return f.select(
        "record_id", "ordinal", "key", F.size("segments").alias("segments"), F.aggregate("segments", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias("bases"),
        F.array_min(F.transform("segments", lambda s: s["start"])).alias("start"), F.array_max(F.transform("segments", lambda s: s["end"])).alias("end"),
        bits([strand(1), strand(-1)]).alias("strands"), fuzz("start_fuzz").alias("fuzzy_starts"), fuzz("end_fuzz").alias("fuzzy_ends"),
        F.size("qualifiers").alias("qualifiers"), bits([has(q) for q in ("gene", "locus_tag", "product", "pseudo", "translation")]).alias("mask"),
    )


def compare_variants(edits: DataFrame, ratio: str, spec: dict, gene: int, threshold: float, floor: float, signal: float = 1.0) -> DataFrame:
    """edits with the reporter's change (occupancy of the edited site on the
    reference's trajectory end), the endogenous change (the edit's own steady
    state), whether the fate flips, and the category."""
    from .collections import category
    from .simulate import steady_states

    both = edits.withColumn("_r", F.round(F.col(ratio).cast("double"), 8))
    grid = both.select(F.col("_r").alias("ratio"), F.lit(signal).alias("signal")).distinct().unionByName(edits.sparkSession.range(1).select(F.lit(1.0).alias("ratio"), F.lit(signal).alias("signal"))).distinct()
    solved = steady_states(grid, spec).select(F.col("ratio").alias("_r"), F.col("state").alias("_s"))
    wild = solved.filter("_r = 1.0").select(F.col("_s").alias("_w"))

    def occupancy(r: Column) -> Column:
        drive = spec["basal"][gene] + spec["input"][gene] * signal + spec["binding"][gene] * r * signal
        against = F.lit(1.0)
        for j in range(len(spec["genes"])):
            against = against * F.pow(1 + spec["repression"][gene][j] * F.col("_w")[j], spec["cooperativity"][gene][j])
        return drive / (drive + against)

    out = both.join(solved, "_r").crossJoin(F.broadcast(wild))
    out = out.withColumn("reporter_change", occupancy(F.col("_r")) - occupancy(F.lit(1.0))).withColumn("endogenous_change", F.col("_s")[gene] - F.col("_w")[gene])
    out = out.withColumn("flip", (F.col("_s")[gene] > threshold) != (F.col("_w")[gene] > threshold))
    return out.withColumn("category", category("reporter_change", F.col("flip"), floor)).drop("_r", "_s", "_w")


def answered(lines: DataFrame, value: str = "value") -> DataFrame:
    """One answer a request line (a JSON object with mode and sequence): ok, code
    and result. Unknown members, modes and letters are refused by code."""
    t = F.col(value)
    r = F.from_json(t, "mode string, sequence string")
    d = lines.withColumn("_r", r)
    s = F.upper(F.col("_r.sequence"))
    code = F.when(~closed_schema(t, ["mode", "sequence"]), "bad request").when(~F.col("_r.mode").isin("reverse", "gc", "translate"), "bad mode").when(~S.valid_alphabet(s), "bad sequence")
    result = F.when(F.col("_r.mode") == "reverse", S.reverse_complement(s)).when(F.col("_r.mode") == "gc", S.gc_fraction(s).cast("string")).otherwise(S.translate_frame(s))
    return d.withColumn("code", F.when(F.col("_r").isNull(), "bad request").otherwise(code)).withColumn("ok", F.col("code").isNull()).withColumn("result", F.when(F.col("ok"), result)).drop("_r")
