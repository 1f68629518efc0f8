"""Writers: tables that never overwrite, ranked CSV, sealed JSON bundles."""

from __future__ import annotations

import hashlib
import json
import zipfile
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity


def write_new(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Absent or whole: the commit protocol renames finished parts, and a path
    that exists is an error."""
    df.write.mode("errorifexists").format(format).save(path)


def write_ranked_csv(df: DataFrame, path: str, columns: list[str], rank: str = "rank") -> None:
    """One CSV file of a bounded report, in rank order and with fixed columns."""
    df.select(*columns).orderBy(rank).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_long_csv(df: DataFrame, path: str, id_: str, values: str, grid: list[float], name: str = "hour") -> None:
    """An array column as rows (id, grid value, element)."""
    hours = F.array(*[F.lit(float(x)) for x in grid])
    rows = df.select(id_, F.explode(F.arrays_zip(hours.alias(name), F.col(values).alias("value"))).alias("z")).select(id_, f"z.{name}", "z.value")
    rows.write.mode("errorifexists").csv(path, header=True)


def write_sealed(spark: SparkSession, value: dict, path: str) -> dict:
    """A JSON object with the digest of its canonical form, as one text file."""
    sealed = identity.seal(value)
    text = json.dumps(sealed, ensure_ascii=False, indent=2, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("errorifexists").text(path)
    return sealed


def write_report(spark: SparkSession, rows: DataFrame, path: str, title: str) -> dict:
    """A bounded result as sealed JSON and as an HTML table, each one text file
    below a new folder; returns what was sealed."""
    from html import escape

    found = [r.asDict(recursive=True) for r in rows.collect()]
    sealed = write_sealed(spark, {"title": title, "columns": rows.columns, "rows": [json.loads(json.dumps(r, default=str)) for r in found]}, f"{path}/json")
    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r[c]))}</td>" for c in rows.columns) + "</tr>" for r in found)
    page = f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table><p>{sealed['artifact_sha256']}</p>"
    spark.range(1).select(F.lit(page).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/html")
    return sealed


#: Columns of a trace's events.
TRACE = "trace string, seq long, event string, step long, cell long, target long, length double"


def write_trace(events: DataFrame, path: str) -> None:
    """Events as JSON lines, each trace's in order within its files."""
    events.repartition("trace").sortWithinPartitions("trace", "seq").write.mode("errorifexists").json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines under the fixed schema; a line that breaks it raises."""
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """A finished folder under its final name, all or nothing: one rename of the
    store that holds both. A name that exists is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    if store.exists(target):
        raise FileExistsError(path)
    if not store.rename(source, target):
        raise OSError(f"no rename from {staged} to {path}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files of a folder. Spark's scans pass over
    empty files, so those come from the store's listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    listed, empty = folder.getFileSystem(conf).listFiles(folder, True), []
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and name[0] not in "._":
            empty.append((name, 0, hashlib.sha256(b"").hexdigest()))
    return rows.unionByName(spark.createDataFrame(empty, "name string, bytes long, sha256 string")) if empty else rows


def manifest_differs(spark: SparkSession, path: str, pinned: DataFrame) -> DataFrame:
    """Names that are missing, unexpected or changed against a pinned manifest."""
    have = manifest(spark, path).select("name", F.col("sha256").alias("have"))
    both = pinned.select("name", F.col("sha256").alias("want")).join(have, "name", "full")
    what = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return both.select("name", what.alias("difference")).filter("difference is not null")


def write_crate(folder: str, name: str, files: dict[str, bytes]) -> None:
    """An RO-Crate 1.1 folder on the driver (kilobytes), in a fixed order."""
    import os

    os.makedirs(folder)
    parts = [{"@id": n, "@type": "File", "contentSize": str(len(b))} for n, b in sorted(files.items())]
    graph = [{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}}, {"@id": "./", "@type": "Dataset", "name": name, "hasPart": [{"@id": p["@id"]} for p in parts]}, *parts]
    for n, b in {**files, "ro-crate-metadata.json": identity.canonical_json({"@context": "https://w3id.org/ro/crate/1.1/context", "@graph": graph}).encode()}.items():
        with open(os.path.join(folder, n), "xb") as f:
            f.write(b)


def write_omex(path: str, files: dict[str, bytes]) -> None:
    """A COMBINE archive with fixed times and sorted entries; its manifest names
    the archive, itself and each file."""
    of = "http://identifiers.org/combine.specifications/"
    kinds = [(".", of + "omex"), ("./manifest.xml", of + "omex-manifest"), *((f"./{n}", "http://purl.org/NET/mediatypes/application/octet-stream") for n in sorted(files))]
    rows = "".join(f"<content location={quoteattr(n)} format={quoteattr(kind)}/>" for n, kind in kinds)
    body = f'<?xml version="1.0" encoding="UTF-8"?><omexManifest xmlns="http://identifiers.org/combine.specifications/omex-manifest">{rows}</omexManifest>'
    with zipfile.ZipFile(path, "x") as z:
        for n, b in sorted({**files, "manifest.xml": body.encode()}.items()):
            info = zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, b)
