"""Tables of xlsx and docx files, by the standard library alone.

Office files are small and can't be split, so a file is one row of
``binaryFile``; what comes out are rows of cells. Formulas are refused, as their
values depend on the program that wrote them."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .formats import FormatError

ROWS = "path string, sheet string, row int, cells array<string>"


def salvage(data: bytes) -> dict[str, bytes]:
    """Members of a zip file by their local headers, for files whose central
    directory is lost. A member without its size in the header ends where its
    deflate stream does."""
    out, at = {}, 0
    while (at := data.find(b"PK\x03\x04", at)) >= 0:
        if at + 30 > len(data):
            break
        flags, method, _, _, _, packed, _, name_size, extra = struct.unpack("<HHHHIIIHH", data[at + 6 : at + 30])
        name = data[at + 30 : at + 30 + name_size].decode("utf-8", "replace")
        begin = at + 30 + name_size + extra
        if method == 8:
            d = zlib.decompressobj(-15)
            try:
                out[name] = d.decompress(data[begin:])
            except zlib.error as e:
                raise FormatError(f"{name}: {e}") from None
            if not d.eof:
                raise FormatError(f"{name}: truncated")
            at = len(data) - len(d.unused_data)
        elif method == 0 and not flags & 8:
            out[name] = data[begin : begin + packed]
            at = begin + packed
        else:
            raise FormatError(f"{name}: method {method}")
    return out


def members(data: bytes, broken: bool = False) -> dict[str, bytes]:
    if broken:
        return salvage(data)
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n: z.read(n) for n in z.namelist()}
    except zipfile.BadZipFile as e:
        raise FormatError(str(e)) from None


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element, name: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _plain(x.tag) == name)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def worksheets(data: bytes, broken: bool = False) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of every sheet; empty cells are null."""
    parts = members(data, broken)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in parts:
        shared = [_texts(x, "t") for x in ElementTree.fromstring(parts["xl/sharedStrings.xml"]) if _plain(x.tag) == "si"]
    sheets = sorted((n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for name in sheets:
        for row in (x for x in ElementTree.fromstring(parts[name]).iter() if _plain(x.tag) == "row"):
            cells: list[str | None] = []
            for c in (x for x in row if _plain(x.tag) == "c"):
                if any(_plain(x.tag) == "f" for x in c):
                    raise FormatError(f"{name}: a formula in {c.get('r')}")
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                value = next((x.text for x in c if _plain(x.tag) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = _texts(c, "t")
                cells.append(value)
            yield name, int(row.get("r") or 0), cells


def document_tables(data: bytes, broken: bool = False) -> Iterator[tuple[str, int, list[str | None]]]:
    """(table, row from 1, cells) of a docx's tables."""
    body = members(data, broken).get("word/document.xml")
    if body is None:
        raise FormatError("no document")
    for k, table in enumerate(x for x in ElementTree.fromstring(body).iter() if _plain(x.tag) == "tbl"):
        for n, row in enumerate((x for x in table if _plain(x.tag) == "tr"), 1):
            yield f"table {k + 1}", n, [_texts(c, "t") for c in row if _plain(c.tag) == "tc"]


def _rows(batches: Iterator[pa.RecordBatch], parse, broken: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows = [(path, *r) for r in parse(content, broken)]
            except (FormatError, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
                raise FormatError(f"{path}: {e}") from None
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())], strict=True)], ["path", "sheet", "row", "cells"])


def read_tables(spark: SparkSession, path: str, profile: str, broken: bool = False) -> DataFrame:
    """Rows of xlsx sheets or docx tables; the caller names the profile.
    ``broken`` reads files whose central directory is lost."""
    if profile not in ("xlsx", "docx"):
        raise ValueError(f"no profile {profile!r}")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_rows, parse=worksheets if profile == "xlsx" else document_tables, broken=broken), ROWS)
