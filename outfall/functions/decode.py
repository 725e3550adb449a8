"""Bulk decoding of evidence values and byte rendering."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from outfall.functions.ship import by_value
from outfall.operators.extract import latin1

CODECS = ("base64", "base64url", "hex", "url", "gzip", "zlib", "utf-16")  # fixed values


@F.pandas_udf(BinaryType())
def _gunzip(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _inflate(gzip.decompress, v))


@F.pandas_udf(BinaryType())
def _zlib(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _inflate(zlib.decompress, v))


def _inflate(codec, value: str | None) -> bytes | None:
    try:
        return codec(value.encode("latin-1"))
    except Exception:
        return None


def _padding(value: Column) -> Column:
    return F.repeat(F.lit("="), F.pmod(-F.length(value), F.lit(4)))


def decode_base64(value: Column) -> Column:
    valid = value.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.pmod(F.length(F.regexp_replace(value, "=+$", "")), F.lit(4)) != 1)
    return F.when(valid, F.try_to_binary(F.concat(value, _padding(value)), F.lit("base64")))


def decode_base64url(value: Column) -> Column:
    return decode_base64(F.regexp_replace(F.translate(value, "-_", "+/"), "[^A-Za-z0-9+/=]", ""))


def decode_hex(value: Column) -> Column:
    digits = F.replace(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(" "), F.lit(""))
    valid = digits.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(valid, F.try_to_binary(digits, F.lit("hex")))


def decode_url(value: Column) -> Column:
    """Percent decoding that keeps ``+`` and stray percent signs."""
    kept = F.replace(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.encode(F.try_url_decode(kept), "UTF-8")


def decode_candidates(values: DataFrame, value: str, keys: list[str], codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """keys, codec, decoded for every codec a value decodes under."""
    v = F.col(value)
    built_in = {"base64": decode_base64(v), "base64url": decode_base64url(v), "hex": decode_hex(v), "url": decode_url(v), "utf-16": F.encode(v, "UTF-16LE")}
    python = {"gzip": _gunzip(v), "zlib": _zlib(v)}
    named = values.select(*keys, *[{**built_in, **python}[c].alias(c) for c in codecs])
    pairs = F.array(*[F.struct(F.lit(c).alias("codec"), F.col(c).alias("decoded")) for c in codecs])
    return named.select(*keys, F.inline(F.filter(pairs, lambda p: p["decoded"].isNotNull())))


def as_printable(raw: Column) -> Column:
    """The bytes as text when more than 85 % of it is printable, else null."""
    utf8 = raw.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(latin1(raw))
    hidden = F.length(F.regexp_replace(text, r"[^\p{C}\p{Z}]|[ \n\r\t]", ""))
    return F.when((F.length(text) > 0) & (1 - hidden / F.length(text) > 0.85), text)


def byte_window(content: Column, offset: int, length: int) -> Column:
    """``offset  hex  |text|`` lines of 16 bytes."""
    window = F.substring(content, offset + 1, length)
    count = F.octet_length(window)

    def line(i: Column) -> Column:
        part = F.substring(window, i * 16 + 1, F.lit(16))
        hexed = F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
        shown = F.regexp_replace(latin1(part), r"[^\x20-\x7e]", ".")
        return F.concat(F.lower(F.lpad(F.hex(i * 16 + offset), 8, "0")), F.lit("  "), F.rpad(hexed, 47, " "), F.lit("  |"), shown, F.lit("|"))

    lines = F.transform(F.sequence(F.lit(0), F.ceil(count / 16).cast("int") - 1), line)
    return F.when(count > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


by_value(__name__)
