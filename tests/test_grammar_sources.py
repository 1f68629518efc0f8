"""Grammars as data sources: split files, filters, pins and malformed input."""

import gzip
import random

import pytest
from helixframe.sources import plugin


def load(spark, kind, path, **options):
    plugin.register(spark)
    return spark.read.format(kind).options(**options).load(str(path))


def test_fasta_in_ranges_of_any_size(spark, tmp_path):
    g = random.Random(1)
    want, text = [], "\n"
    for k in range(60):
        s = "".join(g.choices("ACGTN", k=g.randrange(1, 300)))
        end = g.choice(["\n", "\r\n"])
        want.append((f"r{k}", len(s), s))
        text += f">r{k} of a thing{end}" + "".join(s[i : i + 40].lower() + end for i in range(0, len(s), 40)) + g.choice(["", "\n"])
    (tmp_path / "a.fasta").write_bytes(text.encode())
    (tmp_path / "b.fasta.gz").write_bytes(gzip.compress(b">z\nAC\nGT"))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    for split in (1, 7, 100, 1013, 1 << 20):
        d = load(spark, "helix_fasta", tmp_path, split=split) if split > 50 else load(spark, "helix_fasta", tmp_path / "a.fasta", split=len(text) // 40 + split)
        rows = [(r.record_id, r.bases, r.sequence) for r in d.orderBy("path", "offset").collect()]
        assert rows == want + ([("z", 4, "ACGT")] if split > 50 else [])
    assert d.rdd.getNumPartitions() == 2
    assert plugin.unique_ids(d).count() == 61


def test_fastq_begins_are_not_qualities(spark, tmp_path):
    g = random.Random(2)
    rows = [(f"q{k}", "".join(g.choices("ACGT", k=9)), "@" + "".join(g.choices("@+IJ~!", k=8))) for k in range(50)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in rows))
    for split in (13, 64, 999):
        d = load(spark, "helix_fastq", tmp_path / "a.fastq", split=split)
        assert [(r.record_id, r.sequence, r.quality) for r in d.orderBy("offset").collect()] == rows
    assert d.columns == ["path", "offset", "record_id", "header", "sequence", "quality"]


def test_conditions_are_the_readers(spark, tmp_path):
    lines = ["##gff-version 3", "# note"] + [f"c{k % 3}\tsrc\tgene\t{k + 1}\t{k + 50}\t{'.' if k % 2 else k / 4}\t+\t.\tID=g{k};Note=a%2Cb,c" for k in range(90)]
    (tmp_path / "a.gff3").write_text("\n".join(lines))
    d = load(spark, "helix_gff3", tmp_path / "a.gff3", split=500)
    some = load(spark, "helix_gff3", tmp_path / "a.gff3", split=500, where=plugin.where(("seqid", "=", "c1"), ("start", ">=", 40), ("end", "<", 120), ("score", ">", -1), ("strand", "in", ["+", "-"]), ("type", "startswith", "ge")))
    want = {(f"c{k % 3}", k + 1, k / 4) for k in range(90) if k % 3 == 1 and 39 <= k < 70 and k % 2 == 0}
    rows = [(r.seqid, r.start, r.score) for r in some.collect()]
    assert len(rows) == len(want) and set(rows) == want
    same = d.filter("seqid = 'c1' and start >= 40 and end < 120 and score is not null")
    assert {(r.seqid, r.start, r.score) for r in same.collect()} == want and d.count() == 90
    first = d.orderBy("offset").first()
    assert [(a.tag, a["values"]) for a in first.attributes] == [("ID", ["g0"]), ("Note", ["a,b", "c"])]
    with pytest.raises(Exception, match="no column"):
        load(spark, "helix_gff3", tmp_path / "a.gff3", where=plugin.where(("other", "=", 1))).collect()


@pytest.mark.parametrize(("kind", "text", "why"), [("helix_fasta", "ACGT\n>a\nAC\n", "no defline first"), ("helix_fasta", ">a\nAC\n>b\nA!\n", "IUPAC"), ("helix_fasta", "> a\nAC\n", "no record id"), ("helix_fastq", "@a\nACGT\n+\nII\n", "don't fit"), ("helix_fastq", "ACGT\n", "no record first"), ("helix_gff3", "c\ts\tgene\t1\t2\t.\t+\t.\t.\n", "no gff-version"), ("helix_gff3", "##gff-version 3\nc\ts\tgene\t5\t2\t.\t+\t.\t.\n", "bad range"), ("helix_gff3", "##gff-version 3\nc\ts\tCDS\t1\t2\t.\t+\t.\t.\n", "phase")])
def test_malformed_input_raises(spark, tmp_path, kind, text, why):
    (tmp_path / "x").write_text(text)
    with pytest.raises(Exception, match=why):
        load(spark, kind, tmp_path / "x").collect()


def test_pins_and_own_grammars(spark, tmp_path):
    def pair(lines):
        name, eq, value = lines[0].partition("=")
        return (name, int(value)) if eq else None

    (tmp_path / "x.tab").write_text("a=1\nb=2\nnot a pair\n")
    own = plugin.Grammar("own_pairs", "name string, value int", plugin._any_line, pair)
    plugin.register(spark, own)
    read = lambda pin: spark.read.format("own_pairs").option("pin", pin).load(str(tmp_path / "x.tab"))
    assert [(r.name, r.value) for r in read(own.digest()).orderBy("offset").collect()] == [("a", 1), ("b", 2)]
    assert own.digest() != plugin.Grammar("own_pairs", "name string, value long", plugin._any_line, pair).digest()
    with pytest.raises(Exception, match="pinned"):
        read("0" * 64).collect()
    with pytest.raises(Exception, match="no file"):
        load(spark, "helix_fasta", tmp_path / "gone").collect()
