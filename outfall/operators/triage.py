"""Review of findings: prompts, verdicts from replies or people, proposed rules.

Calls to a model happen elsewhere; this module writes the prompts as a table
and applies the replies.  Only masked values are ever shown.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from outfall.functions import text as T
from outfall.functions.ship import by_value

# Fixed values
FLOOR_RANK = 1  # at or above "high" a model cannot dismiss
VERDICTS = ("true_positive", "false_positive", "needs_review", "error")
STATUSES = ("open", "confirmed", "false_positive", "accepted_risk", "fixed", "needs_review")
CONTEXT_CHARS, EXPLAIN_CHARS, REASON_CHARS = 400, 600, 2000
MAX_PROPOSALS = 5
BENIGN_TEXTS = (
    "The quick brown fox jumps over the lazy dog and keeps running along.",
    "Copyright (c) 2026 Example Corporation. All rights reserved worldwide.",
    "a" * 64,
)


def _line(label: str, value: Column | str) -> Column:
    return F.concat(F.lit(label + ": "), F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("unknown")))


def _optional(label: str, column: str, chars: int) -> Column:
    return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(label + ": "), F.substring(column, 1, chars)))


def triage_prompt() -> Column:
    """Prompt text of one finding; expects its first place as artifact_path and location_count."""
    length = F.concat(F.length("value_masked").cast("string"), F.lit(" (masked)"))
    return F.concat_ws(
        "\n", _line("Rule", "rule_id"), _line("Category", "category"), _line("Rule severity", "severity"), _line("Masked value", "value_masked"),
        _line("Value length", length), _line("Entropy", "entropy"), _line("Found in", "artifact_path"),
        _line("Occurrences in artifact", "location_count"), _optional("Surrounding context (value masked)", "context", CONTEXT_CHARS))


def explain_prompt() -> Column:
    return F.concat_ws(
        "\n", _line("Rule", "rule_id"), _line("Category", "category"), _line("Title", "title"), _line("Severity", "severity"),
        _line("Masked value", "value_masked"), _line("Entropy", "entropy"), _line("Found in", "artifact_path"),
        _line("Occurrences in artifact", "location_count"), _optional("CWE", "cwe", EXPLAIN_CHARS),
        _optional("Surrounding context (value masked)", "context", EXPLAIN_CHARS), _optional("Rule pack remediation", "remediation", EXPLAIN_CHARS))


def triage_prompts(findings: DataFrame) -> DataFrame:
    return findings.select("run_id", "id", "rule_id", "value_hash", "severity", triage_prompt().alias("prompt")).withColumn(
        "prompt_hash", F.sha2("prompt", 256))


def triage_calls(prompts: DataFrame) -> DataFrame:
    """One call per (run, rule, value): the most severe finding, then the lowest id."""
    first = F.min(F.struct(T.severity_rank(F.col("severity")).alias("rank"), "id", "prompt", "prompt_hash"))
    return prompts.groupBy("run_id", "rule_id", "value_hash").agg(first.alias("f"), F.count("*").alias("findings")).select(
        "run_id", "rule_id", "value_hash", "f.id", "f.prompt", "f.prompt_hash", "findings")


def parse_verdicts(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add verdict (closed set) and reasoning of a reply."""
    payload = T.tolerant_json(F.col(text))
    rows = responses.withColumn("_json", payload)
    raw = F.lower(F.trim(F.coalesce(F.get_json_object("_json", "$.verdict"), F.lit(""))))
    reason = F.substring(F.trim(F.coalesce(F.get_json_object("_json", "$.reasoning"), F.lit(""))), 1, REASON_CHARS)
    known = raw.isin(*VERDICTS)
    return rows.withColumns({
        "verdict": F.when(F.col("_json").isNotNull() & known, raw).otherwise("error"),
        "reasoning": F.when(F.col("_json").isNull(), "model did not return parseable JSON")
        .when(~known, F.concat(F.lit("unrecognised verdict '"), raw, F.lit("'")))
        .when(reason == "", "no reasoning given").otherwise(reason)}).drop("_json")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fan the verdicts of the calls back to all findings of the same rule and value.

    An error changes nothing; a severe finding called false is only sent to review.
    """
    joined = findings.join(verdicts.select("run_id", "rule_id", "value_hash", "verdict"), ["run_id", "rule_id", "value_hash"], "left")
    verdict, severe = F.col("verdict"), T.severity_rank(F.col("severity")) <= FLOOR_RANK
    silent = verdict.isNull() | (verdict == "error")
    status = (
        F.when(silent, F.col("status"))
        .when((verdict == "false_positive") & severe, "needs_review").when(verdict == "false_positive", "false_positive")
        .when(verdict == "true_positive", "confirmed").otherwise("needs_review")
    )
    return joined.withColumns({"status": status, "detected_by": F.when(silent, F.col("detected_by")).otherwise("both")})


def triage_summary(judged: DataFrame, calls: DataFrame) -> DataFrame:
    """Per run: findings by verdict and the seconds the calls took."""
    verdict = F.col("verdict")
    counts = judged.where("verdict IS NOT NULL").groupBy("run_id").agg(
        F.count("*").alias("triaged"), F.count(F.when(verdict == "true_positive", 1)).alias("confirmed"),
        F.count(F.when(verdict == "false_positive", 1)).alias("dismissed"), F.count(F.when(verdict == "needs_review", 1)).alias("needs_review"),
        F.count(F.when(verdict == "error", 1)).alias("errors"))
    seconds = calls.groupBy("run_id").agg(F.round(F.sum("duration_s"), 2).alias("duration_s"))
    return counts.join(seconds, "run_id", "left")


@F.pandas_udf(StringType())
def _proposal_error(regex: pd.Series, example: pd.Series) -> pd.Series:
    """Compile check and trial run under the pack's own dialect."""
    def check(expression: str, sample: str) -> str | None:
        try:
            compiled = re.compile(expression)
        except (re.error, OverflowError):
            return "the expression is not valid"
        if compiled.groups < 1:
            return "no group captures the value"
        if any(compiled.search(text) for text in BENIGN_TEXTS):
            return "fires on ordinary text"
        if sample and not compiled.search(sample):
            return "misses its own example"
        return None

    return pd.Series([check(r, e) for r, e in zip(regex.fillna(""), example.fillna(""), strict=True)], dtype=object)


def validate_proposals(proposals: DataFrame) -> DataFrame:
    """All proposals with an ``error``: null means usable.  Those behind the first ones of a batch say so.

    ``proposals``: batch_id, ordinal, rule_id, severity, regex, example.
    """
    order = W.partitionBy("batch_id").orderBy("ordinal")
    trimmed = proposals.withColumn("_rank", F.row_number().over(order)).withColumns({
        "rule_id": F.when(F.trim(F.coalesce("rule_id", F.lit(""))) == "", "unnamed-proposal").otherwise(F.trim("rule_id")),
        "severity": F.when(F.col("severity").isin(*T.SEVERITY_RANKS), F.col("severity")).otherwise("low")})
    checked = trimmed.withColumn("_error", _proposal_error("regex", "example"))
    late = F.lit(f"behind the first {MAX_PROPOSALS} of its batch")
    error = F.when(F.col("_rank") > MAX_PROPOSALS, late).when(F.coalesce("regex", F.lit("")) == "", "no expression given").otherwise(F.col("_error"))
    return checked.withColumn("error", error).drop("_error", "_rank")


def status_changes(findings: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Updated findings, audit rows, rejected patches.  ``patches``: run_id, id, new_status, note; one per finding."""
    good = patches.where(F.col("new_status").isin(*STATUSES))
    rejected = patches.where(~F.col("new_status").isin(*STATUSES)).withColumn("error", F.concat(F.lit("unknown status '"), "new_status", F.lit("'")))
    joined = findings.join(good, ["run_id", "id"], "left")
    audit = joined.where("new_status IS NOT NULL").select(
        "run_id", "id", F.lit("finding_status_changed").alias("action"), F.col("status").alias("old_status"), "new_status", "note")
    updated = joined.withColumn("status", F.coalesce("new_status", "status")).drop("new_status", "note")
    return updated, audit, rejected


by_value(__name__)
