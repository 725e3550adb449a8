"""Report tables: verdict text, release record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators.gate import placed
from outfall.operators.runs import SEVERITIES, columns_of, packed, unpacked

VERDICT_JSON = ("decision string, exit_code int, policy_name string, total_findings bigint, violations bigint, waived bigint,"
                " inherited bigint, degraded_stages string")


def verdict_json(verdicts: DataFrame) -> DataFrame:
    fields = F.struct("decision", "exit_code", F.col("policy").alias("policy_name"), "total_findings", "violations", "waived",
                      "inherited", "degraded_stages")
    return verdicts.select("run_id", "policy", F.to_json(fields).alias("verdict_json"))


def verdict_from_json(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", F.from_json("verdict_json", VERDICT_JSON).alias("v")).select("run_id", "v.*")


def _or(column: str, other: str):
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit(other)).otherwise(F.col(column))


def violation_lines(violations: DataFrame) -> DataFrame:
    """Each violation as a plain line and as a Markdown table row."""
    label = F.when(F.col("severity").isNull(), F.lit("SCAN    ")).otherwise(F.rpad(F.upper("severity"), 8, " "))
    subject = F.when(F.col("title") == "", F.col("detail")).otherwise(F.col("title"))
    where = F.when(F.col("artifact_path") == "", F.lit("")).otherwise(F.concat(F.lit(" ["), "artifact_path", F.lit("]")))
    markdown = F.concat(F.lit("| "), _or("severity", "—"), F.lit(" | "), _or("title", "—"), F.lit(" | `"), _or("artifact_path", "—"),
                        F.lit("` | "), "detail", F.lit(" |"))
    return violations.select("run_id", "policy", F.concat(label, F.lit(" "), subject, where).alias("line"), markdown.alias("markdown"))


def release_findings(runs: DataFrame, findings: DataFrame, locations: DataFrame, baseline: DataFrame) -> DataFrame:
    """The findings part of the release record: severity, rule, masked place, new or not."""
    named = unpacked(packed(findings).join(runs.select("run_id", "name"), "run_id"), findings)
    named = named.select("run_id", "id", "severity", "rule_id", "title", "name")
    rows = placed(named, locations, baseline)
    at = columns_of(rows, named)
    rank = T.severity_rank(at["severity"]).alias("severity_rank")
    ordered = rows.orderBy("run_id", rank, at["rule_id"], at["id"])  # before the columns are made, so the exchange has the short rows
    return ordered.select("run_id", at["id"], rank, at["severity"], at["rule_id"], at["title"],
                          F.coalesce("artifact_path", at["name"]).alias("path_in_tree"), "byte_offset", "is_new")


def release_facts(runs: DataFrame, verdicts: DataFrame, rule_pack: str) -> DataFrame:
    """Cover, counts and methodology of each run as label/value rows."""
    def facts(section: str, pairs: list[tuple]):
        return F.array(*[F.struct(F.lit(section).alias("section"), F.lit(a).alias("label"), b.cast("string").alias("value")) for a, b in pairs])

    joined = runs.join(verdicts, "run_id")
    cover = facts("cover", [("artifact", F.col("name")), ("sha256", F.col("root_sha256")), ("scanned_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss")),
                            ("decision", F.col("decision")), ("degraded_stages", F.col("degraded_stages"))])
    counts = F.filter(facts("severity", [(s, F.col(s)) for s in SEVERITIES]), lambda f: f["value"] != "0")
    fingerprint = F.col("fingerprint") if "fingerprint" in runs.columns else F.lit("-")
    method = facts("methodology", [("Run", F.col("run_id")), ("Manifest fingerprint", fingerprint), ("Rule pack", F.lit(rule_pack))])
    return joined.select("run_id", F.inline(F.concat(cover, counts, method)))
