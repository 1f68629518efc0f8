"""Readers, writers and checks that no query covers."""

import gzip
import io
import json
import math
import zipfile

import pytest
from helixframe.functions import identity as I
from helixframe.operators import assays as Y
from helixframe.operators import collections as C
from helixframe.operators import joins as J
from helixframe.operators import statistics as Q
from helixframe.sources import catalog, formats, office, sinks, strict_json, tables
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def xlsx(cells, formula=False):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = "".join(f'<row r="{r}">' + "".join(c if c.startswith("<c") else f'<c r="{chr(65 + k)}{r}"><v>{c}</v></c>' for k, c in enumerate(row)) + "</row>" for r, row in enumerate(cells, 1))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>na</t><t>me</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_office_tables(spark, tmp_path):
    good = xlsx([['<c r="A1" t="s"><v>0</v></c>', '<c r="C1" t="inlineStr"><is><t>in</t></is></c>'], ["1", "2.5"]])
    (tmp_path / "a.xlsx").write_bytes(good)
    want = [("xl/worksheets/sheet1.xml", 1, ["name", None, "in"]), ("xl/worksheets/sheet1.xml", 2, ["1", "2.5"])]
    assert [(r.sheet, r.row, r.cells) for r in office.read_tables(spark, str(tmp_path / "a.xlsx"), "xlsx").orderBy("row").collect()] == want
    (tmp_path / "b.xlsx").write_bytes(good[: good.rindex(b"PK\x01\x02") - 40])  # no central directory
    with pytest.raises(Exception, match="FormatError"):
        office.read_tables(spark, str(tmp_path / "b.xlsx"), "xlsx").collect()
    assert list(office.worksheets(good[: good.index(b"PK\x01\x02")], broken=True)) == want
    with pytest.raises(office.FormatError, match="formula"):
        list(office.worksheets(xlsx([['<c r="A1"><f>1+1</f><v>2</v></c>']])))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(out.getvalue())
    assert [tuple(r)[1:] for r in office.read_tables(spark, str(tmp_path / "c.docx"), "docx").collect()] == [("table 1", 1, ["a", ""])]


def test_reference_catalog_over_splits(spark, tmp_path):
    text = ">one first\nACGTN\nacgt\n\n>two\n" + "GGCCA\n" * 400 + ">three x\r\nTT\r\n"
    (tmp_path / "r.fa").write_text(text, newline="")
    whole = formats.catalog(formats.read(spark, "fasta", str(tmp_path / "r.fa"))).orderBy("ordinal").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = catalog.reference_catalog(spark, str(tmp_path / "r.fa")).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.record_id, r.bases, r.sha256, r.refget, r.ambiguous) for r in got] == [(r.record_id, r.bases, r.sha256, r.refget, r.ambiguous) for r in whole]
    assert [(r.ordinal, r.masked, r.gc) for r in got] == [(0, 4, 4), (1, 0, 1600), (2, 0, 0)]
    for bad in ("ACGT\n", ">a\n>b\nA\n", ">a\nAC-\n", ">a\nA\n>a\nC\n"):
        (tmp_path / "bad.fa").write_text(bad)
        with pytest.raises(Exception, match="FormatError|given twice"):
            catalog.reference_catalog(spark, str(tmp_path / "bad.fa")).collect()


def test_strict_json(spark):
    texts = {'{"a":[1,2]}': None, '{"a":1,"a":2}': "a key twice", "[NaN]": "not finite", "[1e999]": "not finite", '"\\ud800"': "a surrogate alone", "[[[1]]]": "too deep", "{": "no JSON", "x" * 60: "too large", "": "no JSON"}
    d = spark.createDataFrame(list(texts.items()) + [(None, "no text")], "t string, w string")
    assert all(r.w == r.g for r in d.select("w", strict_json.json_fault("t", 2, 50).alias("g")).collect())
    assert one(spark, strict_json.get_path(F.lit('{"a":{"b c":[1,{"d":2}]}}'), ["a", "b c"])) == '[1,{"d":2}]'
    assert strict_json.put_path({"a": {"b": 1}, "c": 2}, ["a", "x", "y"], 3) == {"a": {"b": 1, "x": {"y": 3}}, "c": 2}


def test_genbank_days(spark):
    text = "LOCUS       X1          12 bp    DNA     circular BCT 31-FEB-1999\nORIGIN\n        1 acgtacgtac gt\n//\n"
    for t in (text, text.replace("FEB", "XXX")):
        with pytest.raises(formats.FormatError, match="no such day"):
            list(formats.parse_genbank(t.encode()))


def test_variant_tables(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,reference,pos,alt\na,acgt,2,T\nb,ACGT,4,A\n")
    (tmp_path / "v.tsv").write_text("id\treference\tvariant\na\tACGT\tatgt\n")
    (tmp_path / "v.json").write_text(json.dumps([{"id": "a", "reference": "ACGT", "sequence": "ATGT"}]))
    assert [tuple(r) for r in tables.variants(spark, str(tmp_path / "v.csv"), "csv").collect()] == [("a", "ACGT", "ATGT"), ("b", "ACGT", "ACGA")]
    for kind in ("tsv", "json"):
        assert [tuple(r) for r in tables.variants(spark, str(tmp_path / f"v.{kind}"), kind).collect()] == [("a", "ACGT", "ATGT")]
    edit = {"id": "e", "record_id": "r", "start": 1, "end": 2, "ref": "C", "alt": "T"}
    for k, body in enumerate(([edit], {"variants": [edit]})):
        (tmp_path / f"l{k}.json").write_text(json.dumps(body))
        assert [tuple(r) for r in tables.variant_list(spark, str(tmp_path / f"l{k}.json")).collect()] == [("e", "r", 1, 2, "C", "T")]


def test_count_tables(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("id\trep1_h12_bc3\trep2_h6_bc1\nx\t5\t0\ny\t1\t2\n")
    d = tables.count_matrix(spark, str(tmp_path / "d.tsv"), "id", "dna")
    assert sorted(tuple(r) for r in d.collect()) == [("x", "rep1_h12_bc3", 5), ("x", "rep2_h6_bc1", 0), ("y", "rep1_h12_bc3", 1), ("y", "rep2_h6_bc1", 2)]
    s = tables.sample_coordinates(d).filter("id = 'x'").orderBy("replicate").select("replicate", "hour", "barcode").collect()
    assert [tuple(r) for r in s] == [(1, 12, 3), (2, 6, 1)]
    (tmp_path / "bad.tsv").write_text("id\ts\nx\t1.5\n")
    with pytest.raises(Exception, match="not a whole number"):
        tables.count_matrix(spark, str(tmp_path / "bad.tsv"), "id", "dna").collect()
    r = d.withColumnRenamed("dna", "rna")
    assert tables.paired_counts(d, r, ["id", "sample"]).count() == 4
    with pytest.raises(Exception, match="slots of DNA and RNA differ"):
        tables.paired_counts(d, r.filter("id = 'x'"), ["id", "sample"]).collect()


def test_annotation_tables(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('#x\nchr1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G1.4"; x "y";\nchr1\ts\texon\t11\t12\t.\t+\t.\tgene_id "G1.4";\nchr2\ts\tgene\t5\t9\t.\t-\t.\tgene_id "G2";\n')
    assert sorted(tuple(r) for r in tables.gtf_tss(spark, str(tmp_path / "g.gtf")).collect()) == [("G1", "chr1", 11, "+"), ("G2", "chr2", 9, "-")]
    (tmp_path / "p.bed").write_text("chr1\t10\t30\tp\t5\t.\t7.5\t1\t2\t4\n")
    assert [tuple(r) for r in tables.narrow_peaks(spark, str(tmp_path / "p.bed")).collect()] == [("chr1", 10, 30, 7.5)]
    (tmp_path / "c.tsv").write_text("variant\tgene_id\tpip\nchr1_5_A_G\tG1.2\t0.9\nchr1_6_AT_G\tG1.2\t0.9\nchr1_7_A_C\tG1.2\t0.1\n")
    assert [tuple(r) for r in tables.credible_rows(spark, str(tmp_path / "c.tsv"), 0.5).collect()] == [("chr1", 5, "A", "G", "G1", 0.9)]
    (tmp_path / "m.jaspar").write_text(">MA1 x\nA [ 1 3 ]\nC [ 1 0 ]\nG [ 1 0 ]\nT [ 1 1 ]\n")
    w = {(r.pos, r.base): r.weight for r in tables.motif_matrix(spark, str(tmp_path / "m.jaspar")).collect()}
    assert len(w) == 8 and math.isclose(w[1, "A"], math.log(3.25 / 5 / 0.25)) and math.isclose(w[0, "T"], 0, abs_tol=1e-12)


def test_assay_rows(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"id,h0,h1\nx,1,2\ny,3,4\n"))
    (tmp_path / "d.fa").write_text(">x\nACGT\n>y\nGG\n")
    got = sorted(tuple(r) for r in tables.assay_rows(spark, str(tmp_path / "a.csv.gz"), str(tmp_path / "d.fa"), 2).select("id", "sequence", "values").collect())
    assert got == [("x", "ACGT", [1.0, 2.0]), ("y", "GG", [3.0, 4.0])]
    (tmp_path / "e.fa").write_text(">x\nACGT\n")
    with pytest.raises(Exception, match="no partner for y"):
        tables.assay_rows(spark, str(tmp_path / "a.csv.gz"), str(tmp_path / "e.fa"), 2).collect()


def test_sinks(spark, tmp_path):
    sinks.write_crate(str(tmp_path / "crate"), "n", {"b.txt": b"xy", "a.txt": b""})
    graph = json.loads((tmp_path / "crate" / "ro-crate-metadata.json").read_text())["@graph"]
    assert [g["@id"] for g in graph] == ["ro-crate-metadata.json", "./", "a.txt", "b.txt"] and (tmp_path / "crate" / "b.txt").read_bytes() == b"xy"
    for name in ("one.omex", "two.omex"):
        sinks.write_omex(str(tmp_path / name), {"b": b"2", "a": b"1"})
    assert (tmp_path / "one.omex").read_bytes() == (tmp_path / "two.omex").read_bytes()
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x").write_bytes(b"abc")
    pinned = spark.createDataFrame(sinks.manifest(spark, str(tmp_path / "files")).collect())
    assert sinks.manifest_differs(spark, str(tmp_path / "files"), pinned).count() == 0
    (tmp_path / "files" / "x").write_bytes(b"abd")
    (tmp_path / "files" / "y").write_bytes(b"")
    assert sorted(tuple(r) for r in sinks.manifest_differs(spark, str(tmp_path / "files"), pinned).collect()) == [("x", "changed"), ("y", "unexpected")]
    sealed = sinks.write_report(spark, spark.range(2).select("id", F.lit("<b>").alias("t")), str(tmp_path / "report"), "T")
    assert I.seal_holds(sealed) and "&lt;b&gt;" in spark.read.text(str(tmp_path / "report" / "html")).first().value
    events = spark.createDataFrame([("a", 1, "cell", 0, 1, None, None), ("a", 0, "cell", 0, 2, None, 1.5)], sinks.TRACE)
    sinks.write_trace(events, str(tmp_path / "trace"))
    assert sorted(map(tuple, sinks.read_trace(spark, str(tmp_path / "trace")).collect()), key=repr) == sorted(map(tuple, events.collect()), key=repr)
    spark.range(3).write.parquet(str(tmp_path / "staged"))
    sinks.publish(spark, str(tmp_path / "staged"), str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final")).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark, str(tmp_path / "report"), str(tmp_path / "final"))


def test_points_keep_their_rows(spark):
    p = spark.createDataFrame([("a", 5, None), ("a", 5, None), ("a", 50, 1), ("b", 5, 2), (None, 5, 3)], "k string, at long, note int")
    i = spark.createDataFrame([("a", 0, 10, 1.0), ("a", 3, 6, 4.0), ("a", 7, 9, 9.0)], "k string, s long, e long, v double")
    got = sorted(((r.k, r.at, r.note, r.max_value) for r in J.points_in_intervals(p, i, ["k"], "at", "s", "e", "v", 8.0).collect()), key=repr)
    assert got == sorted([("a", 5, None, 4.0), ("a", 5, None, 4.0), ("a", 50, 1, None), ("b", 5, 2, None), (None, 5, 3, None)], key=repr)


def test_joins_and_weights_that_no_query_has(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "g int, m string")
    b = spark.createDataFrame([(7, "y"), (7, "x"), (8, "x"), (8, "x")], "g int, m string")
    assert [(r.left_group, r.right_group) for r in J.same_sets(a, b, "g", "m").collect()] == [(1, 7)]
    w = Q.three_level_weight(spark.createDataFrame([("f", "c1"), ("f", "c1"), ("f", "c2"), ("g", "c1")], "f string, c string"), "f", "c").collect()
    assert sorted(r.weight for r in w) == [0.125, 0.125, 0.25, 0.5]
    with pytest.raises(Exception, match="no partner for 2"):
        J.strict_join(a, spark.createDataFrame([(1, 0)], "g int, z int"), ["g"]).collect()


def test_variant_collection(spark):
    r = spark.createDataFrame([("r", "ACGTACGT")], "record_id string, sequence string")
    cols = "id string, record_id string, start int, end int, ref string, alt string"
    good = [("a", "r", 1, 2, "C", "T"), ("b", "r", 4, 4, "", "GG"), ("c", "r", 2, 4, "GT", ""), ("d", "r", 0, 2, "AC", "TTT")]
    got = {x.id: x for x in C.compile_variants(spark.createDataFrame(good, cols), r).collect()}
    assert [got[k].edit_kind for k in "abcd"] == ["snv", "insertion", "deletion", "delins"]
    import hashlib
    from base64 import urlsafe_b64encode

    for k, s in zip("abcd", ("ATGTACGT", "ACGTGGACGT", "ACACGT", "TTTGTACGT"), strict=True):
        assert got[k].mutated_bases == len(s) and got[k].mutated_sequence_sha256 == hashlib.sha256(s.encode()).hexdigest()
        assert got[k].mutated_refget_id == "SQ." + urlsafe_b64encode(hashlib.sha512(s.encode()).digest()[:24]).decode()
        assert len(got[k].vrs_allele_id) == 32 and got[k].refget_id.startswith("SQ.")
    bad = [("e", "q", 0, 1, "A", "C"), ("f", "r", 5, 4, "", "C"), ("g", "r", 0, 1, "AC", "C"), ("h", "r", 0, 1, "C", "A"), ("i", "r", 0, 1, "A", "A"), ("j", "r", 0, 1, "A", "x"), ("k", "r", 0, 1, "A", "C"), ("k", "r", 0, 1, "A", "C"), ("l", "r", 7, 9, "T", "C")]
    codes = {x.id: x.code for x in C.compile_variants(spark.createDataFrame(bad, cols), r, strict=False).collect()}
    assert codes == {"e": "unknown record", "f": "bad bounds", "g": "reference length", "h": "reference mismatch", "i": "identical alleles", "j": "bad letters", "k": "duplicate id", "l": "bad bounds"}
    with pytest.raises(Exception, match="variant h: reference mismatch"):
        C.compile_variants(spark.createDataFrame([bad[3]], cols), r).collect()


def test_moments_dates_and_profiles(spark):
    assert one(spark, Y.admissible_moments(F.lit(10.0), F.lit(2.0), 100, 1.0)) and not one(spark, Y.admissible_moments(F.lit(10.0), F.lit(0.5), 100, 1.0))
    i = one(spark, Y.bernstein_interval(F.lit(30.0), F.lit(12.0), 100, 1.0, 2.0))
    assert 0 <= i.low < 0.3 < i.high <= 1
    b = one(spark, Y.ratio_bounds(F.lit(0.1), F.lit(0.3), F.lit(0.5), F.lit(0.0)))
    assert b.low == 0.2 if b.low else b.low == 0.0
    assert one(spark, Y.insdc_date(F.lit("21-JUN-1999"))).isoformat() == "1999-06-21" and one(spark, Y.insdc_date(F.lit("31-FEB-1999"))) is None and one(spark, Y.insdc_date(F.lit("21-Jun-1999"))) is None
    with pytest.raises(Exception, match="a weight of zero"):
        spark.createDataFrame([("C",)], "s string").select(C.site_profile("s", "A", [[1.0, 0.0, 1.0, 1.0]])).collect()
    m = one(spark, Y.pooled_mass(F.lit(2), F.lit(3), F.lit(4)))
    beta = lambda x, y: math.gamma(x) * math.gamma(y) / math.gamma(x + y)
    assert all(math.isclose(p, math.comb(4, k) * beta(2 + k, 3 + 4 - k) / beta(2, 3), rel_tol=1e-9) for k, p in enumerate(m))
    dup = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "a int, b int")
    assert [tuple(r) for r in C.repeated_edges(dup, "a", "b").collect()] == [(1, 2, 2)]


def test_archive_manifest_names_itself_and_files_with_marks(tmp_path):
    import xml.etree.ElementTree as ET
    import zipfile

    names = ['a & b "c"<d>.txt', "it's.txt"]
    sinks.write_omex(str(tmp_path / "x.omex"), {n: b"1" for n in names})
    with zipfile.ZipFile(tmp_path / "x.omex") as z:
        found = [e.get("location") for e in ET.fromstring(z.read("manifest.xml"))]
        assert sorted(z.namelist()) == sorted([*names, "manifest.xml"])
    assert found == [".", "./manifest.xml", *(f"./{n}" for n in sorted(names))]
