"""Rule matching: strings to evidence.

The hot part reads each content once: an automaton over the literals of all
patterns finds the strings that can match, with the patterns to try, and other
strings never leave the row.  The rest works on those only: it joins the
pattern and rule dimensions, runs the expressions and applies the gates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators import shape
from outfall.operators.candidates import candidate_strings
from outfall.operators.extract import CONTEXT, latin1, with_matches
from outfall.rules.pack import RulePack


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def possible(needs: list[list[str]], text: str, lowered: str) -> str:
    """SQL condition: false when a literal the pattern needs is missing from column ``text``.

    The pack expands to some hundred tests, so they are written as one SQL
    text instead of one call per expression node.
    """
    tests = []
    for group in needs:
        if group[0] == "re:":
            tests.append(f"rlike({text}, {literal(group[1])})")
        else:
            folded = group[0] == "(?i)"
            subject, literals = (lowered, group[1:]) if folded else (text, group)
            tests.append("(" + " OR ".join(f"contains({subject}, {literal(x)})" for x in literals) + ")")
    return " AND ".join(tests) or "true"


def raw_matches(artifacts: DataFrame, pack: RulePack, keys: list[str], content: str = "content") -> DataFrame:
    """Every non-overlapping match of every enabled rule, before any gate.

    Adds the rule's gate columns so that :func:`apply_gates` needs no second join.
    """
    spark = artifacts.sparkSession
    hits = candidate_strings(artifacts, pack.patterns(), keys, content)
    hits = hits.select("*", F.explode("pattern_ixs").alias("pattern_ix")).drop("pattern_ixs")
    hits = hits.join(pack.patterns_df(spark), "pattern_ix")
    gates = ["severity", "encodings", "min_entropy", "min_length", "max_length", "rejects", "requires_nearby",
             "nearby_window", "shape_policy", "require_mixed_case"]
    hits = hits.join(pack.rules_df(spark).select("rule_id", *gates), "rule_id")
    hits = hits.where(F.array_contains("encodings", F.col("encoding")))
    hits = with_matches(hits, "string", F.col("regex"), "_m")
    hits = hits.withColumn("_values", F.regexp_extract_all("string", F.col("regex"), F.col("capture")))
    rows = F.zip_with(
        F.arrays_zip("_m_all", "_values"), F.col("_m_pos"),
        lambda m, pos: F.struct(
            m["_values"].alias("value"), pos.alias("match_start"), (pos + F.length(m["_m_all"])).alias("match_end")
        ),
    )
    hits = hits.select(
        *keys, "rule_id", "pattern_no", "encoding", "string", "string_offset", "window_offset", "window", *gates,
        F.inline(rows),
    )
    width = F.when(F.col("encoding") == "utf-16le", 2).otherwise(1)
    return hits.where(F.col("value") != "").withColumn("byte_offset", F.col("string_offset") + F.col("match_start") * width)


def accepted() -> Column:
    """Length, exclusion and entropy gates, cheapest first."""
    value = F.col("value")
    return (
        F.length(value).between(F.col("min_length"), F.col("max_length"))
        & ~F.exists(F.col("rejects"), lambda r: F.regexp_like(value, r))
        & ((F.col("min_entropy") <= 0) | (T.shannon_entropy(value) >= F.col("min_entropy")))
    )


def drop_known_benign(matches: DataFrame, pack: RulePack) -> DataFrame:
    benign = pack.false_positives_df(matches.sparkSession)
    trimmed = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    return matches.join(benign, trimmed == F.col("fp_value"), "left_anti")


def with_shape(matches: DataFrame) -> DataFrame:
    return matches.withColumn(
        "shape",
        shape.classify(F.col("value"), F.col("string"), F.col("match_start"), F.col("match_end"),
                       F.col("shape_policy"), F.col("require_mixed_case")),
    )


def apply_gates(matches: DataFrame, pack: RulePack) -> DataFrame:
    """Keep matches that pass every gate: accept, benign list, nearby words, shape."""
    kept = drop_known_benign(matches.where(accepted()), pack)
    near = shape.has_nearby(F.col("string"), F.col("match_start"), F.col("requires_nearby"), F.col("nearby_window"))
    return with_shape(kept.where(near)).where(F.col("shape") == "credential_like")


def context(window: Column, window_offset: Column, offset: Column, value: Column, encoding: Column) -> Column:
    """Printable surroundings of a hit with every copy of the value masked, wide copies too."""
    first = F.greatest(offset - CONTEXT, F.lit(0)) - window_offset
    last = offset + 2 * F.length(value) + CONTEXT - window_offset
    raw = latin1(F.substring(window, first.cast("int") + 1, (last - first).cast("int")))
    shown = F.regexp_replace(F.regexp_replace(raw, r"[\x80-\xff]", "�"), r"[\x00-\x1f\x7f]", ".")
    plain = F.translate(value, "\t", ".")
    wide = F.array_join(F.split(plain, ""), ".")
    masked = F.replace(shown, plain, T.mask(value))
    return F.when(encoding == "utf-16le", F.replace(masked, wide, T.mask(value))).otherwise(masked)


def to_evidence(matches: DataFrame, keys: list[str], retain_plaintext: bool = False) -> DataFrame:
    """``evidence``: hashed and masked; the plaintext stays only on request."""
    value = F.col("value")
    columns = [
        F.col("rule_id"),
        F.col("pattern_no"),
        T.value_hash(value).alias("value_hash"),
        T.mask(value).alias("value_masked"),
        F.col("byte_offset"),
        F.col("encoding"),
        F.round(T.shannon_entropy(value), 3).alias("entropy"),
        context(F.col("window"), F.col("window_offset"), F.col("byte_offset"), value, F.col("encoding")).alias("context"),
    ]
    if retain_plaintext:
        columns.append(value.alias("value_plaintext"))
    return matches.select(*keys, *columns)


def scan(artifacts: DataFrame, pack: RulePack, keys: list[str], content: str = "content",
         retain_plaintext: bool = False) -> DataFrame:
    """Artifacts to evidence: extraction, matching and gates in map-only stages."""
    return to_evidence(apply_gates(raw_matches(artifacts, pack, keys, content), pack), keys, retain_plaintext)
