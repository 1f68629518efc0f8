"""Tensors as bytes: little-endian packing, NumPy files, and recipes in bases."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import col

#: Kinds of elements and their NumPy types.
KINDS = {"bool": "?", "i64": "<i8", "u64": "<u8", "f64": "<f8"}
BASES = "ACGT"


def packed(values: np.ndarray, kind: str) -> bytes:
    """Bytes of a tensor's elements; f64 must be finite, and -0.0 becomes 0.0."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}")
    x = np.asarray(values, KINDS[kind])
    if kind == "f64":
        if not np.isfinite(x).all():
            raise ValueError("not finite")
        x = x + 0.0
    return x.tobytes()


def unpacked(data: bytes, kind: str, shape: list[int]) -> np.ndarray:
    """The tensor of these bytes; a wrong length, a bool byte beyond 1, numbers
    that aren't finite and -0.0 are errors."""
    dtype = np.dtype(KINDS[kind])
    if len(data) != dtype.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError("length and shape differ")
    if kind == "bool" and any(b > 1 for b in data):
        raise ValueError("a bool beyond 0 and 1")
    x = np.frombuffer(data, dtype).reshape(shape)
    if kind == "f64" and (not np.isfinite(x).all() or (np.signbit(x) & (x == 0)).any()):
        raise ValueError("not finite, or a negative zero")
    return x


def pack(values, kind: str) -> Column:
    """Bytes of an array column."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else packed(np.asarray(x), kind))

    return run(col(values))


def unpack(data, kind: str = "f64") -> Column:
    """The array of a tensor's bytes, in row order, as doubles."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        size = np.dtype(KINDS[kind]).itemsize
        return s.map(lambda b: None if b is None else unpacked(bytes(b), kind, [len(b) // size]).astype(float).tolist())

    return run(col(data))


def bases_of(numbers: list[float]) -> str:
    """Doubles as four bases a byte, the highest two bits first."""
    raw = struct.pack(f">{len(numbers)}d", *numbers)
    return "".join(BASES[b >> s & 3] for b in raw for s in (6, 4, 2, 0))


def numbers_of(bases: str) -> list[float]:
    """The doubles that bases_of wrote."""
    if len(bases) % 32 or set(bases) - set(BASES):
        raise ValueError("no whole doubles in ACGT")
    code = [BASES.index(c) for c in bases]
    raw = bytes(code[i] << 6 | code[i + 1] << 4 | code[i + 2] << 2 | code[i + 3] for i in range(0, len(code), 4))
    return list(struct.unpack(f">{len(raw) // 8}d", raw))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if content[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    parts = {n.removesuffix(".npy"): z.read(n) for n in sorted(z.namelist())}
            else:
                parts = {"": content}
            for name, data in parts.items():
                x = np.load(io.BytesIO(data), allow_pickle=False)
                if x.dtype.kind not in "biuf":
                    raise ValueError(f"{path}: {name} holds no numbers")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([list(x.shape)], pa.list_(pa.int64())), pa.array([x.astype(float).ravel()], pa.list_(pa.float64()))], ["path", "name", "shape", "numbers"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, numbers) of NPY and NPZ files; objects are refused."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_arrays, "path string, name string, shape array<long>, numbers array<double>")


def kind_of(head) -> Column:
    """What a file's first bytes look like: receipt (JSON object), edits (a CSV
    header with id and reference) or sequence; other otherwise. For listings;
    no reader is ever chosen by it."""
    h = F.ltrim(F.substring(col(head).cast("string"), 1, 2048))
    return F.when(h.startswith("{"), "receipt").when(h.rlike(r"(?i)^[^\n]*\bid\b[^\n]*\breference\b"), "edits").when(h.rlike(r"^(>|[ACGTNacgtn\s]+$)"), "sequence").otherwise("other")


def class_projection(df: DataFrame, features: str, classes: list[list[float]], shared: list[int], middle: float) -> DataFrame:
    """df with classes: features, of which the ``shared`` columns are scaled so
    that they sum to ``middle``, times each class's weights, as a unit vector."""
    x = F.col(features)
    total = sum((x[i] for i in shared), F.lit(0.0))
    scaled = F.transform(x, lambda v, i: F.when(F.array_contains(F.array(*map(F.lit, shared)), i) & (total != 0), v * middle / total).otherwise(v))
    product = [F.aggregate(F.zip_with(F.col("_x"), F.array(*map(F.lit, map(float, w))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in classes]
    d = df.withColumn("_x", scaled).withColumn("_c", F.array(*product))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, v: s + v * v))
    return d.withColumn("classes", F.transform("_c", lambda v: F.try_divide(v, norm))).drop("_x", "_c")
