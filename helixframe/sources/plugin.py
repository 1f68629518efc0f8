"""Record grammars as Spark data sources.

A grammar says where a record begins and what row its lines make. Registered, it
is a format of ``spark.read``: files are read by byte ranges, each by a task that
takes the records that begin in its range, so a large file is read by many.
Conditions on the grammar's columns, given as the option ``where``, are checked
before a row leaves the reader. They are an option and not Spark's own push-down,
as Spark 4.1 keeps filters once pushed with the loaded table: a second query of
the same DataFrame without them would miss rows.

Anyone's grammar can be registered. Its digest covers its name, its columns and
the source of its functions; a ``pin`` that differs from it is refused before
anything is read, so a changed grammar can't pass for the reviewed one.

Options: path (files or folders, separated by commas), split (bytes of a range,
128 MiB), pin, where (of ``where()``). Files that end in .gz are read whole, by the strict reader. Paths
may be URIs of any store that pyarrow knows. Ids that a file repeats in ranges of
their own aren't seen; ``unique_ids`` checks them."""

from __future__ import annotations

import hashlib
import inspect
import json
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .formats import FormatError, attributes, parse_fasta, parse_fastq, percent_decoded, unpack

@dataclass(frozen=True)
class Grammar:
    """``begins(lines)``: whether the first of the next ``ahead`` lines begins a
    record. ``row(lines)``: the record's columns (or None for no row), or a
    FormatError. ``head(lines)`` checks a file's first lines."""

    name: str
    columns: str
    begins: Callable[[list[str]], bool]
    row: Callable[[list[str]], tuple | None]
    ahead: int = 1
    head: Callable[[list[str]], None] | None = None

    @property
    def ddl(self) -> str:
        return f"path string, offset long, {self.columns}"

    def digest(self) -> str:
        code = [inspect.getsource(f) for f in (self.begins, self.row, self.head) if f]
        return hashlib.sha256(json.dumps([self.name, self.columns, self.ahead, code]).encode()).hexdigest()


def _fasta_row(lines: list[str]) -> tuple:
    name, _, bases, sequence = next(parse_fasta("\n".join(lines).encode()))
    return name, bases, sequence


def _fasta_begins(lines: list[str]) -> bool:
    return lines[0].startswith(">")


def _fasta_head(lines: list[str]) -> None:
    if not any(line.strip() for line in lines) or not next(line for line in lines if line.strip()).startswith(">"):
        raise FormatError("no defline first")


def _fastq_begins(lines: list[str]) -> bool:
    # a quality line may begin alike, but the line after the next is then a sequence
    return len(lines) > 2 and lines[0].startswith("@") and lines[2].startswith("+")


def _fastq_row(lines: list[str]) -> tuple:
    name, _, header, sequence, quality = next(parse_fastq("\n".join(lines).encode()))
    return name, header, sequence, quality


def _fastq_head(lines: list[str]) -> None:
    if not _fastq_begins(lines):
        raise FormatError("no record first")


def _any_line(lines: list[str]) -> bool:
    return True


def _gff3_row(lines: list[str]) -> tuple | None:
    line = lines[0]
    if line.startswith(("##FASTA", ">")):
        raise FormatError("embedded FASTA")
    if not line or line.startswith("#"):
        return None
    f = line.split("\t")
    if len(f) != 9:
        raise FormatError(f"{len(f)} columns")
    if not (f[3].isdigit() and f[4].isdigit() and 1 <= int(f[3]) <= int(f[4])):
        raise FormatError("bad range")
    if f[6] not in "+-.?" or f[7] not in ("0", "1", "2", ".") or (f[2] == "CDS" and f[7] == "."):
        raise FormatError("bad strand or phase")
    return percent_decoded(f[0]), percent_decoded(f[1]), percent_decoded(f[2]), int(f[3]), int(f[4]), None if f[5] == "." else float(f[5]), f[6], None if f[7] == "." else int(f[7]), [(a["tag"], a["values"]) for a in attributes(f[8])]


def _gff3_head(lines: list[str]) -> None:
    if lines[:1] == [] or not lines[0].startswith("##gff-version") or lines[0].split()[1:2] != ["3"]:
        raise FormatError("no gff-version 3 directive")


FASTA = Grammar("helix_fasta", "record_id string, bases long, sequence string", _fasta_begins, _fasta_row, 1, _fasta_head)
FASTQ = Grammar("helix_fastq", "record_id string, header string, sequence string, quality string", _fastq_begins, _fastq_row, 3, _fastq_head)
GFF3 = Grammar("helix_gff3", "seqid string, source string, type string, start long, end long, score double, strand string, phase int, attributes array<struct<tag:string,values:array<string>>>", _any_line, _gff3_row, 1, _gff3_head)


@dataclass
class ByteRange(S.InputPartition):
    path: str
    start: int
    end: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _lines(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from the first line on that begins at ``start`` or later."""
    at = max(0, start - 1)
    stream.seek(at)
    rest, first = b"", start > 0
    while True:
        block = stream.read(1 << 20)
        rest += block
        cut = rest.split(b"\n")
        rest = cut.pop() if block else b""
        for line in cut if block or cut[-1:] != [b""] else cut[:-1]:
            if not first:
                yield at, line
            first = False
            at += len(line) + 1
        if not block:
            return


def records(lines: Iterator[tuple[int, bytes]], end: int, grammar: Grammar) -> Iterator[tuple[int, list[str]]]:
    """(offset, lines) of records that begin before ``end``; lines before the
    first record belong to one of an earlier range."""
    window: list[tuple[int, str]] = []
    held: tuple[int, list[str]] | None = None
    more = True
    while more or window:
        while more and len(window) < grammar.ahead:
            n = next(lines, None)
            more = n is not None
            if n:
                window.append((n[0], n[1].rstrip(b"\r").decode("utf-8")))
        if not window:
            break
        if grammar.begins([t for _, t in window]):
            if held:
                yield held
                held = None
            if window[0][0] >= end:
                return
            held = (window[0][0], [])
        if held:
            held[1].append(window[0][1])
        elif window[0][0] >= end:
            return
        window.pop(0)
    if held:
        yield held


_TESTS: dict[str, Callable] = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda v, some: v in some, "startswith": str.startswith}


def where(*conditions: tuple[str, str, object]) -> str:
    """The option that keeps rows for which all conditions (column, one of _TESTS,
    value) hold; a null value holds for none."""
    for column, test, _ in conditions:
        if test not in _TESTS:
            raise FormatError(f"{column}: no test {test!r}")
    return json.dumps(conditions)


class GrammarReader(S.DataSourceReader):
    def __init__(self, grammar: Grammar, names: list[str], options: dict):
        self.grammar, self.options = grammar, options
        self.kept = []
        for column, test, value in json.loads(options.get("where", "[]")):
            if column not in names or test not in _TESTS:
                raise FormatError(f"{grammar.name} has no column {column} or no test {test!r}")
            self.kept.append((names.index(column), test, value))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        split = int(self.options.get("split", 1 << 27))
        found = []
        for path in self.options["path"].split(","):
            store, inner = _store(path)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FormatError(f"no file {path}")
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            files = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
            for x in sorted((x for x in files if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
                step = x.size if x.path.endswith(".gz") else split
                found += [ByteRange(prefix + x.path, a, min(a + step, x.size)) for a in range(0, x.size, step)]
        return found

    def read(self, partition: ByteRange):
        import io

        g = self.grammar
        store, inner = _store(partition.path)
        with store.open_input_file(inner) as stream:
            end = partition.end
            if inner.endswith(".gz"):
                data = unpack(stream.read())
                stream, end = io.BytesIO(data), len(data)
            try:
                if partition.start == 0 and g.head:
                    g.head([t.rstrip("\r") for t in stream.read(1 << 16).decode("utf-8", "ignore").split("\n")])
                for offset, lines in records(_lines(stream, partition.start), end, g):
                    try:
                        found = g.row(lines)
                    except FormatError as e:
                        raise FormatError(f"byte {offset}: {e}") from None
                    if found is not None:
                        row = (partition.path, offset, *found)
                        if all(row[k] is not None and _TESTS[test](row[k], value) for k, test, value in self.kept):
                            yield row
            except (FormatError, UnicodeDecodeError) as e:
                raise FormatError(f"{partition.path}: {e}") from None


def source(grammar: Grammar) -> type[S.DataSource]:
    """The data source of a grammar."""
    digest = grammar.digest()  # where the source of its functions is at hand

    class GrammarSource(S.DataSource):
        @classmethod
        def name(cls) -> str:
            return grammar.name

        def schema(self) -> str:
            return grammar.ddl

        def reader(self, schema: StructType) -> GrammarReader:
            if "path" not in self.options:
                raise FormatError("no path")
            pin = self.options.get("pin")
            if pin and pin != digest:
                raise FormatError(f"{grammar.name} isn't the pinned grammar: its digest is {digest}")
            return GrammarReader(grammar, schema.fieldNames(), dict(self.options))

    return GrammarSource


def register(spark: SparkSession, *grammars: Grammar) -> None:
    """Makes formats of grammars, of the three here if none is said."""
    for g in grammars or (FASTA, FASTQ, GFF3):
        spark.dataSource.register(source(g))


def unique_ids(rows: DataFrame, id_: str = "record_id") -> DataFrame:
    """rows; an id that a file has twice raises."""
    n = rows.groupBy("path", id_).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("path", id_, F.raise_error(F.concat(F.lit("record id given twice: "), F.col(id_))).cast("boolean").alias("_again"))
    return rows.join(n, ["path", id_], "left").filter("_again is null").drop("_again")
