"""Readers of sequence and annotation formats.

The caller names the profile; bytes and file names never choose a reader. Line
formats are one task per file over ``binaryFile``, which Spark lists and reads
from any store; a record that breaks the format raises with file and line."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FASTA = "path string, record_id string, ordinal int, bases long, sequence string"
FASTQ = "path string, record_id string, ordinal int, header string, sequence string, quality string"
GFF3 = "path string, line int, seqid string, source string, type string, start long, end long, score string, strand string, phase int, attributes array<struct<tag:string,values:array<string>>>"
SEGMENT = "struct<reference:string,start:long,end:long,orientation:int,kind:string,start_fuzz:string,end_fuzz:string>"
GENBANK = f"path string, record_id string, length long, topology string, division string, date date, sequence string, features array<struct<ordinal:int,key:string,location:string,segments:array<{SEGMENT}>,qualifiers:array<struct<name:string,value:string>>>>"
_IUPAC = re.compile("[ACGTRYSWKMBDHVN]+")


class FormatError(ValueError):
    """A file that breaks its format."""


def unpack(data: bytes, limit: int = 1 << 33) -> bytes:
    """All members of a gzip file; padding, trailing bytes and truncation are
    errors, which the permissive codec would let pass."""
    out, size = [], 0
    if not data:
        raise FormatError("empty gzip file")
    while data:
        if data[:2] != b"\x1f\x8b":
            raise FormatError("trailing bytes after a gzip member")
        d = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            part = d.decompress(data, limit - size + 1)
        except zlib.error as e:
            raise FormatError(f"bad gzip member: {e}") from None
        size += len(part)
        if size > limit:
            raise FormatError("more bytes than allowed")
        if not d.eof:
            raise FormatError("truncated gzip member")
        out.append(part)
        data = d.unused_data
    return b"".join(out)


def lines(data: bytes) -> list[str]:
    """Lines ended by LF, CRLF or CR; ASCII or UTF-8 text."""
    text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    return (text[:-1] if text.endswith("\n") else text).split("\n") if text else []


def parse_fasta(data: bytes) -> Iterator[tuple]:
    """(record_id, ordinal, bases, sequence); ids are the first token of the
    defline and unique, sequences are upper-case IUPAC letters."""
    name, parts, ordinal, seen = None, [], 0, set()

    def record():
        seq = "".join(parts).upper()
        if not _IUPAC.fullmatch(seq):
            raise FormatError(f"record {name}: empty or with letters outside IUPAC")
        return name, ordinal, len(seq), seq

    for k, line in enumerate(lines(data), 1):
        if line.startswith(">"):
            if name is not None:
                yield record()
                ordinal += 1
            head = line[1:].split()
            if not head or line[1:2].isspace():
                raise FormatError(f"line {k}: no record id")
            if head[0] in seen:
                raise FormatError(f"line {k}: record id {head[0]} again")
            name, parts = head[0], []
            seen.add(name)
        elif line.strip():
            if name is None:
                raise FormatError(f"line {k}: sequence before a defline")
            parts.append(line.strip())
    if name is None:
        raise FormatError("no record")
    yield record()


def parse_fastq(data: bytes) -> Iterator[tuple]:
    """(record_id, ordinal, header, sequence, quality) of four-line records with
    Phred+33 qualities."""
    rows, seen = lines(data), set()
    if len(rows) % 4:
        raise FormatError("the number of lines isn't a multiple of four")
    for k in range(0, len(rows), 4):
        head, seq, plus, quality = rows[k : k + 4]
        if not head.startswith("@") or not head[1:].split():
            raise FormatError(f"line {k + 1}: no header")
        name = head[1:].split()[0]
        if not plus.startswith("+") or (plus != "+" and plus[1:] != head[1:]):
            raise FormatError(f"line {k + 3}: no separator")
        if not _IUPAC.fullmatch(seq.upper()) or len(seq) != len(quality) or not all("!" <= c <= "~" for c in quality):
            raise FormatError(f"line {k + 2}: sequence and quality don't fit")
        if name in seen:
            raise FormatError(f"line {k + 1}: record id {name} again")
        seen.add(name)
        yield name, k // 4, head[1:], seq.upper(), quality


def percent_decoded(text: str) -> str:
    """Strict percent escapes whose bytes are UTF-8."""
    if "%" not in text:
        return text
    if re.search("%(?![0-9A-Fa-f]{2})", text):
        raise FormatError(f"bad escape in {text!r}")
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    return raw.decode("utf-8")


def attributes(text: str) -> list[dict]:
    """GFF3 column 9 as sorted tags with lists of values."""
    if text == ".":
        return []
    found: dict[str, list[str]] = {}
    for part in text.rstrip(";").split(";"):
        tag, eq, values = part.strip().partition("=")
        tag = percent_decoded(tag)
        if not eq or not tag or not values:
            raise FormatError(f"bad attribute {part!r}")
        if tag in found:
            raise FormatError(f"attribute {tag} again")
        found[tag] = [percent_decoded(v) for v in values.split(",")]
    return [{"tag": t, "values": v} for t, v in sorted(found.items(), key=lambda x: x[0].encode())]


def parse_gff3(data: bytes) -> Iterator[tuple]:
    """Feature rows; directives are checked, embedded FASTA is refused."""
    rows = lines(data)
    if not rows or not re.match(r"##gff-version\s+3", rows[0]):
        raise FormatError("no gff-version 3 directive")
    regions: dict[str, tuple[int, int]] = {}
    for k, line in enumerate(rows, 1):
        if line.startswith("##sequence-region"):
            part = line.split()
            if len(part) != 4 or part[1] in regions:
                raise FormatError(f"line {k}: bad sequence-region")
            regions[part[1]] = (int(part[2]), int(part[3]))
        if line.startswith("##FASTA") or line.startswith(">"):
            raise FormatError(f"line {k}: embedded FASTA")
        if not line or line.startswith("#"):
            continue
        f = line.split("\t")
        if len(f) != 9:
            raise FormatError(f"line {k}: {len(f)} columns")
        if not (f[3].isdigit() and f[4].isdigit() and 1 <= int(f[3]) <= int(f[4])):
            raise FormatError(f"line {k}: bad range")
        name = percent_decoded(f[0])
        if name in regions and int(f[3]) < regions[name][0]:
            raise FormatError(f"line {k}: outside of its sequence-region")
        if f[6] not in "+-.?" or f[7] not in ("0", "1", "2", ".") or (f[2] == "CDS" and f[7] == "."):
            raise FormatError(f"line {k}: bad strand or phase")
        if f[5] != ".":
            float(f[5])
        yield k, name, percent_decoded(f[1]), percent_decoded(f[2]), int(f[3]), int(f[4]), None if f[5] == "." else f[5], f[6], None if f[7] == "." else int(f[7]), attributes(f[8])


def _split_top(text: str) -> list[str]:
    depth, part, out = 0, "", []
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    if depth:
        raise FormatError(f"unbalanced location {text!r}")
    return [*out, part]


def location_segments(text: str, strand: int = 1, reference: str | None = None) -> list[dict]:
    """Segments of an INSDC location from 0, end excluded, in the order of the
    spliced strand: complement turns order and strand round."""
    text = text.strip()
    for name in ("join", "order", "bond", "one-of"):
        if text.startswith(name + "(") and text.endswith(")"):
            return [s for p in _split_top(text[len(name) + 1 : -1]) for s in location_segments(p, strand, reference)]
    if text.startswith("complement(") and text.endswith(")"):
        found = location_segments(text[len("complement(") : -1], strand, reference)
        return [s | {"orientation": -s["orientation"]} for s in reversed(found)]
    m = re.fullmatch(r"(?:([A-Za-z0-9_.|]+):)?([<>]?)(\d+)(?:(\.\.|\^|\.)([<>]?)(\d+))?", text)
    if not m:
        raise FormatError(f"bad location {text!r}")
    other, f1, a, sep, f2, b = m.groups()
    start, end = int(a), int(b or a)
    if start < 1 or (sep != "^" and end < start):
        raise FormatError(f"bad location {text!r}")
    kind = {"..": "range", "^": "between", ".": "within", None: "base"}[sep]
    s, e = (start, start) if sep == "^" else (start - 1, end)
    return [{"reference": other or reference, "start": s, "end": e, "orientation": strand, "kind": kind, "start_fuzz": f1 or None, "end_fuzz": (f2 if b else f1) or None}]


def parse_genbank(data: bytes) -> Iterator[tuple]:
    """Records of a GenBank flat file with normalised features."""
    import datetime

    months = {m: k for k, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
    text = "\n".join(lines(data))
    for body in re.split(r"^//[ ]*$", text, flags=re.M):
        if not body.strip():
            continue
        m = re.match(r"\s*LOCUS\s+(\S+)\s+(\d+) bp\s+(\S+)\s+(?:(linear|circular)\s+)?([A-Z]{3})\s+(\d{2})-([A-Z]{3})-(\d{4})", body)
        if not m:
            raise FormatError("no LOCUS line")
        name, size, _, topology, division, day, month, year = m.groups()
        version = re.search(r"^VERSION\s+(\S+)", body, re.M)
        try:
            date = datetime.date(int(year), months[month], int(day))
        except (KeyError, ValueError):
            raise FormatError(f"no such day: {day}-{month}-{year}") from None
        head, _, rest = body.partition("\nORIGIN")
        sequence = re.sub(r"[^A-Za-z]", "", "".join(line for line in rest.split("\n")[1:])).upper()
        if len(sequence) != int(size) or not _IUPAC.fullmatch(sequence):
            raise FormatError(f"{name}: ORIGIN has {len(sequence)} of {size} bases")
        features = []
        table = head.partition("\nFEATURES")[2].split("\n")[1:]
        blocks: list[list[str]] = []
        for line in table:
            if line[:5] == " " * 5 and line[5:6].strip():
                blocks.append([line[5:20].strip(), line[21:].strip()])
            elif blocks and line[:21].strip() == "":
                blocks[-1].append(line[21:].rstrip())
            elif line[:1].strip():
                break
        for k, (key, first, *more) in enumerate(blocks):
            location, qualifiers, in_quotes = first, [], False
            for line in more:
                if not in_quotes and line.startswith("/"):
                    qname, eq, value = line[1:].partition("=")
                    qualifiers.append([qname, value if eq else None])
                    in_quotes = value.startswith('"') and (value.count('"') % 2 == 1)
                elif qualifiers:
                    glue = "" if qualifiers[-1][0] == "translation" else " "
                    qualifiers[-1][1] = (qualifiers[-1][1] or "") + glue + line.strip()
                    in_quotes = qualifiers[-1][1].startswith('"') and qualifiers[-1][1].count('"') % 2 == 1
                else:
                    location += line.strip()
            plain = lambda v: v[1:-1].replace('""', '"') if v and v[0] == '"' and v[-1] == '"' and len(v) > 1 else v
            features.append({"ordinal": k, "key": key, "location": location, "segments": location_segments(location), "qualifiers": [{"name": a, "value": plain(b)} for a, b in qualifiers]})
        yield (version[1] if version else name), int(size), topology or "linear", division, date, sequence, features


def parse_raw(data: bytes, record_id: str) -> Iterator[tuple]:
    seq = data.decode("ascii").strip().upper()
    if not _IUPAC.fullmatch(seq):
        raise FormatError("not one run of IUPAC letters")
    yield record_id, 0, len(seq), seq


def _rows(batches: Iterator[pa.RecordBatch], parse: Callable, names: list[str], compression: str, schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows = [(path, *r) for r in parse(unpack(content) if compression == "gzip" else content)]
            except (FormatError, UnicodeDecodeError) as e:
                raise FormatError(f"{path}: {e}") from None
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[at : at + 10_000]], schema=schema)


def _read(spark: SparkSession, path: str, parse: Callable, ddl: str, compression: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], ddl).schema
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_rows, parse=parse, names=kind.names, compression=compression, schema=to_arrow_schema(kind)), ddl)


#: Readers by profile. No profile is guessed.
PROFILES: dict[str, tuple[Callable, str]] = {"fasta": (parse_fasta, FASTA), "fastq": (parse_fastq, FASTQ), "gff3": (parse_gff3, GFF3), "genbank": (parse_genbank, GENBANK)}


def read(spark: SparkSession, profile: str, path: str, compression: str = "identity", record_id: str | None = None) -> DataFrame:
    """Rows of files of a named profile; compression is identity or gzip."""
    if compression not in ("identity", "gzip"):
        raise ValueError(f"no compression {compression!r}")
    if profile == "raw":
        return _read(spark, path, partial(parse_raw, record_id=record_id or "sequence"), FASTA, compression)
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}")
    parse, ddl = PROFILES[profile]
    return _read(spark, path, parse, ddl, compression)


def catalog(fasta: DataFrame) -> DataFrame:
    """A FASTA table without the sequences: digests and counts."""
    from ..functions import identity, sequence

    s = F.col("sequence")
    return fasta.select("path", "record_id", "ordinal", "bases", identity.sha256_hex(s).alias("sha256"), identity.refget(s).alias("refget"), sequence.gc_fraction(s).alias("gc"), sequence.ambiguous_bases(s).alias("ambiguous"))


def gzip_bytes(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)
