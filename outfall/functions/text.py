"""Scalar functions as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks and ids are only comparable while these stay.
BULLET = "•"
MASK_FULL_LENGTH = 12
MASK_KEEP = 4
UNIT_SEPARATOR = "\x1f"
SEVERITY_RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
UNKNOWN_RANK = 99


def compact(text: Column, null: bytes = b"") -> Column:
    """A text as bytes that :func:`expanded` gives back: 16 for one of 32 lower-case hexadecimal digits, as ids are; others behind 17 zero bytes.

    A null becomes ``null``, of fewer than 16 bytes. Two sides of a join that give their own keep nulls apart, and Spark has no reason to filter them
    on one side only, which would make another exchange of it.
    """
    half = F.unhex(text)
    same = (F.octet_length(text) == 32) & (F.lower(F.hex(half)) == text)
    return F.coalesce(F.when(same, half).otherwise(F.concat(F.lit(bytes(17)), text.cast("binary"))), F.lit(null))


def expanded(data: Column) -> Column:
    size = F.octet_length(data)
    return F.when(size == 16, F.lower(F.hex(data))).when(size > 16, F.substring(data, 18, 2**31 - 1).cast("string"))


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    size = F.length(value).cast("double")
    shares = F.transform(
        F.array_distinct(F.split(value, "")),
        lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size,
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(-bits)


def mask(value: Column) -> Column:
    """Short values are hidden fully, longer ones keep four characters at each end."""
    size = F.length(value)
    hidden = F.expr(f"repeat('{BULLET}', 12)")
    dots = F.repeat(F.lit(BULLET), F.least(size - 2 * MASK_KEEP, F.lit(12)))
    return F.when(size <= MASK_FULL_LENGTH, F.substring(hidden, F.lit(1), size)).otherwise(
        F.concat(F.substring(value, 1, MASK_KEEP), dots, F.right(value, F.lit(MASK_KEEP)))
    )


def value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def finding_id(rule_id: Column, vhash: Column, path: Column, offset: Column) -> Column:
    """First 32 hex digits over rule, value, path and offset; the run is left out."""
    parts = F.concat_ws(UNIT_SEPARATOR, rule_id, vhash, path, F.coalesce(offset, F.lit(0)).cast("string"))
    return F.substring(F.sha2(parts, 256), 1, 32)


def manifest_fingerprint(fields: list[Column], maps: list[Column]) -> Column:
    """One hash over the fields and the sorted ``key=value`` pairs of each map."""
    pairs = [
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])) for m in maps
    ]
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, F.concat(F.array(*fields), *pairs)), 256)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(UNKNOWN_RANK)
    for name, number in SEVERITY_RANKS.items():
        rank = F.when(severity == name, number).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    name = F.lit(None).cast("string")
    for text, number in SEVERITY_RANKS.items():
        name = F.when(rank == number, text).otherwise(name)
    return name


def blocks(severity: Column, floor: Column) -> Column:
    """At or above the floor; no floor blocks nothing."""
    return F.coalesce(severity_rank(severity) <= F.when(floor.isNotNull(), severity_rank(floor)), F.lit(False))


def char_classes(value: Column) -> Column:
    """How many of lower, upper, digit and symbol occur."""
    return sum(
        (value.rlike(p).cast("int") for p in ("[A-Z]", "[0-9]", "[^A-Za-z0-9]")), value.rlike("[a-z]").cast("int")
    )


def mask_secretish(text: Column) -> Column:
    """Mask every run of 20 or more credential characters."""
    return F.regexp_replace(
        text, r"([A-Za-z0-9+/=_-]{4})[A-Za-z0-9+/=_-]{12,}([A-Za-z0-9+/=_-]{4})", "$1" + BULLET * 12 + "$2"
    )


def clean(value: Column) -> Column:
    """Trimmed, with the usual spellings of "no value" emptied."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(F.lower(text).isin("unknown", "none", "null"), F.lit("")).otherwise(text)


def spdx_expression(text: Column) -> Column:
    """Empty when the text points at a file instead of naming a licence."""
    return F.when(text.rlike(r"(?i)^(see\s|\.{0,2}/)|\.(md|txt|html)$"), F.lit("")).otherwise(text)


def purl_quote(value: Column) -> Column:
    """Percent-encode the UTF-8 bytes outside the characters a package URL allows."""
    quoted = F.transform(
        F.split(value, ""),
        lambda c: F.when(c.rlike(r"^[A-Za-z0-9._~!$&'()*+,;=:/-]?$"), c).otherwise(
            F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
        ),
    )
    return F.when(value.rlike(r"^[A-Za-z0-9._~!$&'()*+,;=:/-]*$"), value).otherwise(F.array_join(quoted, ""))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    scoped = (ecosystem == "npm") & name.startswith("@") & F.contains(name, F.lit("/"))
    module = (ecosystem == "golang") & F.contains(name, F.lit("/"))
    namespace = (
        F.when(scoped, F.substring_index(name, "/", 1))
        .when(module, F.regexp_replace(name, "/[^/]*$", ""))
        .otherwise(F.lit(""))
    )
    local = (
        F.when(scoped, F.regexp_replace(name, "^[^/]*/", "")).when(module, F.substring_index(name, "/", -1)).otherwise(name)
    )
    return F.concat(
        F.lit("pkg:"), ecosystem, F.lit("/"),
        F.when(namespace != "", F.concat(purl_quote(namespace), F.lit("/"))).otherwise(F.lit("")),
        purl_quote(local),
        F.when(version != "", F.concat(F.lit("@"), purl_quote(version))).otherwise(F.lit("")),
    )


def tolerant_json(text: Column) -> Column:
    """The JSON object inside a reply: as is, without its code fence, or from first ``{`` to last ``}``."""
    def strip(value: Column) -> Column:
        return F.regexp_replace(value, r"^\s+|\s+$", "")

    body = strip(text)
    unfenced = F.when(
        body.startswith("```"), F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n", ""), r"(?s)```[^`]*$", "")
    ).otherwise(body)
    unfenced = strip(unfenced)
    span = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return (
        F.when(F.try_parse_json(unfenced).isNotNull() & unfenced.startswith("{"), unfenced)
        .when((span != "") & F.try_parse_json(span).isNotNull(), span)
    )


def waiver_expired(expires: Column, today: Column) -> Column:
    return today > expires


def ttl_exceeded(expires: Column, today: Column, max_days: Column) -> Column:
    return F.datediff(expires, today) > max_days


def printable_ratio(latin1: Column) -> Column:
    kept = F.length(F.regexp_replace(latin1, r"[^\t\n\r\x20-\x7e]", ""))
    return F.when(F.length(latin1) == 0, F.lit(0.0)).otherwise(kept / F.length(latin1))
