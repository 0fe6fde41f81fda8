"""Payload sources: text decoding, canonical JSON, unsafe keys, compressed payloads, create-only object puts.

Defined cases: null bytes decode to a null text with the error ``missing``; a payload that is no JSON has a null
canonical form; a null reference is a bad one; rows are handled one by one, so repeated rows are kept.
"""

from __future__ import annotations

import codecs
import gzip
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Encodings in the order they are tried, forbidden metadata keys, the form of a reference.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
PLAIN = ("utf-8", "gb18030", "gbk")
UNSAFE_KEYS = "authorization proxy-authorization cookie set-cookie access_token refresh_token bearer_token token auth bearer secret password api_key x-api-key signed_url artifact_url download_url source_url headers request_headers cookies cache_key path x-amz-signature x_amz_signature".split()
REFERENCE = "^src_[0-9a-f]{32}$"


def decode_bytes(raw: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error) of one file: its byte order mark's encoding first, then the plain ones, all strict."""
    if raw is None:
        return None, None, "missing"
    marked = next((name for mark, name in MARKS if raw.startswith(mark)), None)
    for name in dict.fromkeys(([marked] if marked else []) + list(PLAIN)):
        try:
            text = raw.decode(name)
        except UnicodeError:
            continue
        return (None, name, "nul") if "\0" in text else (text, name, None)
    return None, None, "undecodable"


def decoded(raw: Column) -> Column:
    """Struct (text, encoding, error) of a binary column. Spark's own decode knows neither GB18030 nor the order of trials."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([decode_bytes(x) for x in part], columns=["text", "encoding", "error"])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "text string, encoding string, error string")(raw)


def keys_of(value: object) -> Iterator[str]:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield from v
            todo += v.values()
        elif isinstance(v, list):
            todo += v


def no_constant(name: str) -> None:
    raise ValueError(name)


def canonical(payload: str | None) -> tuple[str | None, list[str]]:
    """Compact JSON with sorted keys, and the forbidden keys in it; null where it is no JSON or has NaN or infinities."""
    try:
        value = json.loads(payload, parse_constant=no_constant) if payload is not None else None
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) if payload is not None else None
    except (ValueError, RecursionError):
        return None, []
    return text, sorted({k for k in keys_of(value) if k.lower() in UNSAFE_KEYS or k.lower().replace("-", "_") in UNSAFE_KEYS})


def canonical_json(payload: Column) -> Column:
    """Struct (json, unsafe) of a column of JSON texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([canonical(x) for x in part], columns=["json", "unsafe"])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "json string, unsafe array<string>")(payload)


def unpacked(raw: Column, compression: Column) -> Column:
    """Bytes of a payload that is stored as it is or by gzip; null where it cannot be read or is packed otherwise."""

    def one(data: bytes | None, how: str | None) -> bytes | None:
        if data is None or (how or "").lower() in ("", "identity"):
            return data
        try:
            return gzip.decompress(data) if how.lower() in ("gzip", "gz") else None
        except (OSError, EOFError, zlib.error):
            return None

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, how in parts:
            yield pd.Series([one(d, h) for d, h in zip(data, how, strict=True)], dtype=object)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(raw, compression)


def put_outcome(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows (ref, bytes, outcome) of create-only puts: ``stored``, ``same`` (equal bytes are there), ``exists`` (others are),
    ``mismatch`` (not the size or checksum declared) or ``bad_reference``."""
    old = stored.select(F.col("ref").alias("_ref"), F.sha2("content", 256).alias("_sha")).dropDuplicates(["_ref"])
    sha, size = F.sha2("content", 256), F.octet_length("content").cast("long")
    joined = incoming.join(old, F.col("ref") == F.col("_ref"), "left")
    wrong = F.coalesce(F.col("expected_size") != size, F.lit(False)) | F.coalesce(F.lower("expected_sha") != sha, F.lit(False))
    outcome = F.when(~F.coalesce(F.col("ref").rlike(REFERENCE), F.lit(False)), "bad_reference").when(wrong, "mismatch").when(F.col("_ref").isNull(), "stored").when(F.col("_sha") == sha, "same").otherwise("exists")
    return joined.select("ref", size.alias("bytes"), outcome.alias("outcome"))
