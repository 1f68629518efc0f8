"""Content identities: digests as built-in expressions, canonical JSON as a UDF."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import col


def sha256_hex(s) -> Column:
    return F.sha2(col(s).cast("binary"), 256)


def sha512t24u(s) -> Column:
    """URL-safe base64 of the first 24 bytes of SHA-512."""
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(col(s).cast("binary"), 512), 1, 48))), "+/", "-_")


def refget(s) -> Column:
    return F.concat(F.lit("SQ."), sha512t24u(s))


def vrs_location(sequence_id, start, end) -> Column:
    """Digest of a VRS 2 location; members in canonical order."""
    body = F.format_string('{"end":%d,"sequenceReference":{"refgetAccession":"%s","type":"SequenceReference"},"start":%d,"type":"SequenceLocation"}', col(end).cast("long"), col(sequence_id), col(start).cast("long"))
    return sha512t24u(body)


def vrs_allele(location, alt) -> Column:
    body = F.format_string('{"location":"%s","state":{"sequence":"%s","type":"LiteralSequenceExpression"},"type":"Allele"}', col(location), col(alt))
    return sha512t24u(body)


def seqcol_level1(names, lengths, sequences) -> Column:
    """struct of the digests of a collection's three arrays (ASCII names)."""
    text = lambda a: sha512t24u(F.concat(F.lit('["'), F.array_join(col(a), '","'), F.lit('"]')))
    numbers = sha512t24u(F.concat(F.lit("["), F.array_join(col(lengths).cast("array<string>"), ","), F.lit("]")))
    return F.struct(numbers.alias("lengths"), text(names).alias("names"), text(sequences).alias("sequences"))


def seqcol_digest(level1) -> Column:
    d = col(level1)
    return sha512t24u(F.format_string('{"lengths":"%s","names":"%s","sequences":"%s"}', d["lengths"], d["names"], d["sequences"]))


def hex_modulo(digest, n: int) -> Column:
    """A whole hexadecimal digest modulo n, digit by digit (all 256 bits count)."""
    digits = F.transform(F.split(F.lower(col(digest)), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(digits, F.lit(0), lambda t, x: (t * 16 + x) % n)


def hash_bucket(namespace: str, key, n: int) -> Column:
    return hex_modulo(sha256_hex(F.concat(F.lit(namespace), col(key).cast("string"))), n)


def _number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("not finite")
    if x == 0:
        return "0"
    sign, text = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    power = ("+" if point > 0 else "-") + str(abs(point - 1))
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + power


def canonical_json(value) -> str:
    """RFC 8785: keys in UTF-16 order, ECMAScript numbers, no white space."""
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys are strings")
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(canonical_json(k) + ":" + canonical_json(v) for k, v in items) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int):
        if abs(value) > 2**53 - 1:
            raise ValueError("integer beyond 2^53 - 1")
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, str):
        value.encode("utf-8")  # lone surrogates are errors
        return json.dumps(value, ensure_ascii=False)
    raise TypeError(type(value).__name__)


@F.pandas_udf(T.StringType())
def canonical_json_udf(texts):
    """Canonical form of JSON texts, Arrow batches at a time; null if invalid."""

    def one(t):
        try:
            return None if t is None else canonical_json(json.loads(t))
        except (ValueError, TypeError):
            return None

    return texts.map(one)


def seal(value: dict) -> dict:
    """The object with artifact_sha256 of its canonical form without that key."""
    body = {k: v for k, v in value.items() if k != "artifact_sha256"}
    return body | {"artifact_sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def seal_holds(value: dict) -> bool:
    return seal(value) == value
