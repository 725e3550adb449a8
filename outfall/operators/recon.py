"""Inventory of what a corpus contains, and the strings no rule matched.

Rarity is the ranking signal, so counts run over everything: one aggregation
by (category, value) with map-side combine, no string cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outfall.operators.match import literal, possible
from outfall.operators.ordered import top_k

# Probes in claim order, limits, residue expressions.
PROBES = (
    ("uri_scheme", r"""\b([a-z][a-z0-9+.\-]{1,14}://[^\s"'<>&\x00]{3,180})""", [["://"]]),
    ("unc_path", r"""(\\\\[A-Za-z0-9._-]{2,60}\\[^\s"<>|\x00]{0,120})""", [["\\\\"]]),
    ("windows_path", r"""\b([A-Za-z]:\\[^\s"<>|*?\x00\r\n]{4,160})""", [[":\\"]]),
    ("posix_path", r"""(/(?:home|Users|opt|srv|var|data|build|builds|workspace|mnt)/[^\s"<>|:\x00]{3,160})""", [["/"]]),
    ("email_or_upn", r"""\b([A-Za-z0-9._%+-]{2,40}@[A-Za-z0-9.-]{3,50}\.[A-Za-z]{2,12})\b""", [["@"]]),
    ("ip_address", r"""\b((?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?)\b""", [["re:", r"\d\.\d{1,3}\."]]),
    ("hostname", r"""\b((?!\d+\.)[a-z0-9][a-z0-9-]{1,40}(?:\.[a-z0-9][a-z0-9-]{1,40}){2,}\.?[a-z]{0,12})\b""",
     [["re:", r"(?i)\.[a-z0-9][a-z0-9-]{1,40}\."]]),
    ("connection_string",
     r"""([A-Za-z][A-Za-z0-9]{2,20}\s*=\s*[^;\s"'\x00]{3,60}(?:;[A-Za-z][A-Za-z0-9]{2,20}\s*=\s*[^;\s"'\x00]{1,60}){2,})""",
     [[";"], ["="]]),
    ("assignment", r"""\b([A-Za-z_][A-Za-z0-9_.\-]{2,40}\s*[=:]\s*[^\s"'<>;,\x00]{6,120})""", [["=", ":"]]),
    ("version_tag", r"""\b([A-Z]{1,3}[0-9]{3,8}(?:[-_][A-Za-z0-9]{1,10}){1,5})\b""", [["-", "_"]]),
)
UBIQUITY = 40
PER_CATEGORY = 60
VALUE_CHARS = 200
RESIDUE_MIN, RESIDUE_MAX, RESIDUE_KEY, RESIDUE_SAMPLE = 12, 300, 120, 400
PROMPT_MIN, PROMPT_CHARS, PROMPT_SAMPLE = 12, 220, 120
INTERESTING = (
    r"(?i)(?:[a-z][a-z0-9+.\-]{1,14}://)|(?:[A-Za-z]:\\|//|\\\\)|(?:\b[a-z0-9-]{2,40}(?:\.[a-z0-9-]{2,40}){2,}\b)"
    r"|(?:\b[A-Za-z0-9_-]{2,30}\s*[=:]\s*\S{8,})|(?:\b(?:passwd|password|secret|token|apikey|api_key|credential|licen[cs]e)\b)"
)
BORING = (
    r"(?i)\.(?:dll|exe|png|jpg|gif|xml|xsd|resources)$|^(?:System|Microsoft|Windows)\.|<</|/Subtype|/Rect\[|endobj|endstream"
    r"|/FlateDecode|/Font|^\s*[%&'()*\d:;<>?@\[\]^_`|~-]+\s*$|\\(?:par|fonttbl|colortbl|viewkind|uc1|pard)\b"
    r"|^(?:https?://(?:www\.)?[a-z0-9-]+\.[a-z]{2,6}/?)$"
)


def claim(value: str, lowered: str) -> Column:
    """(category, found) of the first probe that matches column ``value``, or null."""
    branches = []
    for name, regex, needs in PROBES:
        pattern = literal("(?i)" + regex)
        found = f"regexp_extract({value}, {pattern}, 1)"
        branches.append(f"WHEN {possible(needs, value, lowered)} AND rlike({value}, {pattern}) THEN named_struct('category', '{name}', 'found', {found})")
    return F.expr(f"CASE {' '.join(branches)} END")


def claims(strings: DataFrame, by: list[str]) -> DataFrame:
    """Claimed strings: by, path_in_tree, byte_offset, encoding, category, found."""
    lowered = strings.withColumn("_lowered", F.lower("value"))
    claimed = lowered.select(*by, "path_in_tree", "byte_offset", "encoding", claim("value", "_lowered").alias("c"))
    return claimed.where("c IS NOT NULL").select(*by, "path_in_tree", "byte_offset", "encoding", "c.category", "c.found")


def value_counts(claimed: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences and first place of every distinct value."""
    first = F.min(F.struct("path_in_tree", "byte_offset", "encoding"))
    return claimed.groupBy(*by, "category", "found").agg(F.count("*").alias("occurrences"), first.alias("first"))


def recon_summary(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by, "category").agg(F.sum("occurrences").alias("total"), F.count("*").alias("distinct_values"))


def recon_samples(counts: DataFrame, by: list[str], per_category: int = PER_CATEGORY) -> DataFrame:
    """Rare values first, then by value; values seen too often are structure and drop out.  Values are counted whole and shown shortened."""
    rank = W.partitionBy(*by, "category").orderBy("occurrences", "found")
    kept = counts.where(F.col("occurrences") <= UBIQUITY).withColumn("rank", F.row_number().over(rank))
    return kept.where(F.col("rank") <= per_category).select(
        *by, "category", "rank", F.substring("found", 1, VALUE_CHARS).alias("found"), "occurrences", "first.path_in_tree", "first.byte_offset", "first.encoding")


def files_scanned(strings: DataFrame, by: list[str]) -> DataFrame:
    return strings.groupBy(*by).agg(F.countDistinct("path_in_tree").alias("files_scanned"))


def unmatched(strings: DataFrame, matches: DataFrame, strict: bool = False) -> DataFrame:
    """Strings at whose own offset no match starts; ``strict`` drops every string that holds a match.

    ``matches``: path_in_tree, byte_offset and, for ``strict``, string_offset.
    """
    offset = "string_offset" if strict else "byte_offset"
    hits = matches.select("path_in_tree", F.col(offset).alias("byte_offset")).distinct()
    return strings.join(hits, ["path_in_tree", "byte_offset"], "left_anti")


def residue_candidates(strings: DataFrame) -> DataFrame:
    """Strings worth a reader's attention: right length, interesting, not document structure."""
    trimmed = strings.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))
    right_length = F.length("value").between(RESIDUE_MIN, RESIDUE_MAX)
    return trimmed.where(right_length & F.col("value").rlike(INTERESTING) & ~F.col("value").rlike(BORING))


def residue(strings: DataFrame, matches: DataFrame, limit: int = RESIDUE_SAMPLE, strict: bool = False) -> DataFrame:
    """Sample of unmatched strings, one per leading text, first by path and offset."""
    rows = unmatched(residue_candidates(strings), matches, strict)
    first = F.min(F.struct("path_in_tree", "byte_offset", "encoding", "value"))
    distinct = rows.groupBy(F.substring("value", 1, RESIDUE_KEY).alias("key")).agg(first.alias("f"))
    return distinct.select("f.*").orderBy("path_in_tree", "byte_offset", "encoding", "value").limit(limit)


def residue_by(strings: DataFrame, matches: DataFrame, by: list[str], limit: int = RESIDUE_SAMPLE) -> DataFrame:
    """The sample of every group: one per leading text, first by path and offset; salted, so a large group is not one task."""
    hits = matches.select(*by, "path_in_tree", "byte_offset").distinct()
    rows = residue_candidates(strings).join(hits, [*by, "path_in_tree", "byte_offset"], "left_anti")
    first = F.min(F.struct("path_in_tree", "byte_offset", "encoding", "value"))
    distinct = rows.groupBy(*by, F.substring("value", 1, RESIDUE_KEY).alias("key")).agg(first.alias("f")).select(*by, "f.*")
    return top_k(distinct, by, ["path_in_tree", "byte_offset", "encoding", "value"], limit)


def prompt_sample(residue_rows: DataFrame, limit: int = PROMPT_SAMPLE) -> DataFrame:
    """Distinct shortened values in order, for review."""
    cut = F.substring(F.regexp_replace("value", r"^\s+|\s+$", ""), 1, PROMPT_CHARS)
    rows = residue_rows.select(cut.alias("value"), "path_in_tree", "byte_offset", "encoding").where(F.length("value") >= PROMPT_MIN)
    first = rows.groupBy("value").agg(F.min(F.struct("path_in_tree", "byte_offset", "encoding")).alias("f"))
    return first.select("value", "f.*").orderBy("path_in_tree", "byte_offset", "encoding", "value").limit(limit)
