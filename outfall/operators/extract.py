"""String extraction with exact byte offsets, inside the row.

Content is viewed as ISO-8859-1 so that one character is one byte.  The runs
and the gaps between them come from the same expression, and an offset is the
sum of everything before it.  No shuffle, no Python, one output row per string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets and string boundaries depend on them.
MIN_STRING = 6
MAX_STRING = 8192
PRINTABLE = r"\t\x20-\x7e"
ASCII_RUN = rf"[{PRINTABLE}]{{{MIN_STRING},{MAX_STRING}}}"
WIDE_RUN = rf"(?:[{PRINTABLE}]\x00){{{MIN_STRING},{MAX_STRING}}}"
NUL = "\u0000"
CONTEXT = 60  # bytes kept on each side of a hit


def prefix_sums(values: Column) -> Column:
    """Exclusive prefix sums of an array, in blocks of about sqrt(n).

    A plain fold copies the growing array at every step; blocks keep that copy
    small, so a file with a million strings stays cheap.
    """
    step = F.ceil(F.sqrt(F.size(values))).cast("int")

    def running(items: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(
            items, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a"))
        )

    blocks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, step), lambda i: running(F.slice(values, i + 1, step)))
    return F.when(F.size(values) <= 0, F.array().cast("array<bigint>")).otherwise(
        F.flatten(
            F.transform(
                F.array(blocks),  # bind the blocks once
                lambda b: F.flatten(
                    F.zip_with(
                        running(F.transform(b, lambda x: x["s"]))["a"], b, lambda base, x: F.transform(x["a"], lambda v: v + base)
                    )
                ),
            )
        )
    )


def with_matches(df: DataFrame, text: str, regex: str | Column, prefix: str, when: Column | None = None) -> DataFrame:
    """Add ``<prefix>_all`` (matches) and ``<prefix>_pos`` (their 0-based starts in ``text``).

    ``split`` and ``regexp_extract_all`` walk the same matches, so start k is
    the length of gaps 0..k plus matches 0..k-1.
    """
    pattern = F.lit(regex) if isinstance(regex, str) else regex
    source = F.col(text) if when is None else F.when(when, F.col(text))
    gaps, found, steps = f"{prefix}_gap", f"{prefix}_all", f"{prefix}_step"
    df = df.withColumns(
        {
            found: F.coalesce(F.regexp_extract_all(source, pattern, F.lit(0)), F.array().cast("array<string>")),
            gaps: F.coalesce(
                F.transform(F.split(source, pattern, -1), lambda g: F.length(g).cast("bigint")),
                F.array().cast("array<bigint>"),
            ),
        }
    )
    df = df.withColumn(
        steps,
        F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(found)), F.col(found), lambda g, m: g + F.length(m)),
    )
    starts = F.zip_with(
        prefix_sums(F.col(steps)), F.slice(F.col(gaps), F.lit(1), F.size(found)), lambda before, g: before + g
    )
    return df.withColumn(f"{prefix}_pos", starts)


def _structs(prefix: str, encoding: str, ranged: bool = False) -> Column:
    """Strings of one encoding; of a range of a file those that start in it, at offsets of the file."""
    def value(run: Column) -> Column:
        return F.replace(run, F.lit(NUL), F.lit("")) if encoding == "utf-16le" else run

    skipped = F.col("content_start") + F.col("ascii_skip" if encoding == "ascii" else "wide_skip") if ranged else F.lit(0)
    found = F.zip_with(
        F.col(f"{prefix}_all"),
        F.col(f"{prefix}_pos"),
        lambda run, pos: F.struct(value(run).alias("value"), (pos + skipped).alias("byte_offset"), F.lit(encoding).alias("encoding")),
    )
    own = lambda s: (s["byte_offset"] >= F.col("range_start")) & (s["byte_offset"] < F.col("range_end"))
    return F.filter(found, own) if ranged else found


def is_ranged(artifacts: DataFrame) -> bool:
    """Rows of ``artifact_ranges`` instead of whole files."""
    return {"range_start", "range_end", "content_start", "ascii_skip", "wide_skip"} <= set(artifacts.columns)


def _latin1_rows(artifacts: DataFrame, keys: list[str], content: str) -> DataFrame:
    if not is_ranged(artifacts):
        text = latin1(F.col(content))
        return artifacts.select(*keys, text.alias("_la"), text.alias("_lw"))
    after = lambda skip: latin1(F.expr(f"substring(`{content}`, CAST({skip} AS INT) + 1)"))
    own = ["range_start", "range_end", "content_start", "ascii_skip", "wide_skip"]
    return artifacts.select(*keys, *(c for c in own if c not in keys), after("ascii_skip").alias("_la"), after("wide_skip").alias("_lw"))


def with_string_columns(df: DataFrame) -> DataFrame:
    """Add the columns behind :func:`string_array` for both encodings."""
    df = with_matches(df, "_la", ASCII_RUN, "_a")
    return with_matches(df, "_lw", WIDE_RUN, "_w", when=F.contains(F.col("_lw"), F.lit(NUL)))


def string_array(ranged: bool = False) -> Column:
    """All strings of the row.  Distinct already: one encoding has one string per offset."""
    return F.concat(_structs("_a", "ascii", ranged), _structs("_w", "utf-16le", ranged))


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def extract_ascii(artifacts: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    df = with_matches(_latin1_rows(artifacts, keys, content), "_la", ASCII_RUN, "_a")
    return df.select(*keys, F.inline(_structs("_a", "ascii", is_ranged(artifacts))))


def extract_utf16le(artifacts: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Wide strings at both alignments: runs of different parity cannot overlap, so one pass finds all."""
    df = _latin1_rows(artifacts, keys, content)
    df = with_matches(df, "_lw", WIDE_RUN, "_w", when=F.contains(F.col("_lw"), F.lit(NUL)))
    return df.select(*keys, F.inline(_structs("_w", "utf-16le", is_ranged(artifacts))))


def extract_strings(artifacts: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``strings``: keys, value, byte_offset, encoding, of whole files or of the ranges of ``artifact_ranges``."""
    df = with_string_columns(_latin1_rows(artifacts, keys, content))
    return df.select(*keys, F.inline(string_array(is_ranged(artifacts))))
