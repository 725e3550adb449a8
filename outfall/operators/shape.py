"""Structural checks of a candidate value and its surroundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outfall.functions.text import char_classes

# The checks decide which matches become evidence.
BLOB_RUN = 120
MARKER_WINDOW = 200
BASE64_HEAD = r"^[A-Za-z0-9+/=\r\n]*"
STRUCTURE_MARKERS = (
    "MII", "BgkqhkiG", "-----BEGIN", "-----END", "%PDF", "endstream", "endobj", "/Filter", "FlateDecode",
    "<?xml", "data:image/", "base64,",
)
UUID = r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$"
HEX = r"^[0-9a-fA-F]+$"
PATH = r"^(?:[A-Za-z]:[\\/]|[\\/]|\.{1,2}[\\/])"
URL = r"(?i)^[a-z][a-z0-9+.\-]*://"
NUMERIC = r"^[0-9.,:_\-+eE]+$"
MIN_DISTINCT = 4
MIN_VARIETY = 0.18


def window(text: Column, start: Column, end: Column, reach: Column | int) -> Column:
    """``text[start - reach, end + reach)`` clipped to the text."""
    first = F.greatest(start - reach, F.lit(0))
    last = F.least(end + reach, F.length(text))
    return F.substring(text, first.cast("int") + 1, (last - first).cast("int"))


def base64_run(text: Column, start: Column, end: Column) -> Column:
    """Length of the base64-alphabet run around ``[start, end)``."""
    left = F.regexp_extract(F.reverse(F.substring(text, F.lit(1), start.cast("int"))), BASE64_HEAD, 0)
    right = F.regexp_extract(F.substring(text, end.cast("int") + 1, F.length(text)), BASE64_HEAD, 0)
    return F.length(left) + (end - start) + F.length(right)


def in_structure(text: Column, start: Column, end: Column) -> Column:
    around = window(text, start, end, MARKER_WINDOW)
    found = F.lit(False)
    for marker in STRUCTURE_MARKERS:
        found = found | F.contains(around, F.lit(marker))
    return found


def has_nearby(text: Column, start: Column, keywords: Column, reach: Column) -> Column:
    """Any keyword within ``reach`` characters of the match start; no keywords means yes."""
    around = F.lower(window(text, start, start, reach))
    return (F.size(keywords) == 0) | F.exists(keywords, lambda k: F.contains(around, F.lower(k)))


def strict_shape(value: Column, mixed_case: Column) -> Column:
    """First disqualifying shape of the value itself, or null."""
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return (
        F.when(text.rlike(UUID), "uuid")
        .when(text.rlike(HEX), "hex_digest")
        .when(text.rlike(URL) | text.rlike(PATH), "path_or_url")
        .when(text.rlike(NUMERIC), "numeric")
        .when((distinct <= MIN_DISTINCT) | (distinct / F.length(text) < MIN_VARIETY), "low_variety")
        .when(mixed_case & (char_classes(text) < 3), "low_variety")
    )


def classify(value: Column, text: Column, start: Column, end: Column, policy: Column, mixed_case: Column) -> Column:
    """The shape of a match: ``credential_like`` when nothing disqualifies it."""
    blank = ~value.rlike(r"\S")
    return (
        F.when(policy == "off", "credential_like")
        .when(blank, "low_variety")
        .when(base64_run(text, start, end) >= BLOB_RUN, "blob_slice")
        .when(in_structure(text, start, end), "encoded_structure")
        .when(policy == "strict", F.coalesce(strict_shape(value, mixed_case), F.lit("credential_like")))
        .otherwise("credential_like")
    )
