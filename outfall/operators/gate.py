"""The release gate: findings, policy and waivers to one verdict per run.

All runs and policies are decided at once.  Every finding gets an outcome in a
row-wise projection; one conditional aggregate per (run, policy) then carries
everything a decision needs, so no list of findings is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators.runs import SEVERITIES, TERMINAL, packed, unpacked
from outfall.sources.policies import UNLIMITED, Policy, with_policies

# Fixed values
CLOSED = ("false_positive", "accepted_risk", "fixed")
EXIT_CODES = {"pass": 0, "blocked": 1, "inconclusive": 3}


@dataclass(frozen=True)
class Gate:
    outcomes: DataFrame
    violations: DataFrame
    waived: DataFrame
    inherited: DataFrame
    warnings: DataFrame
    verdicts: DataFrame
    refused: DataFrame
    counted: DataFrame


def first_locations(locations: DataFrame, key: Column | None = None, name: str = "id") -> DataFrame:
    """First place per finding by path, then offset; ``key``: what stands for ``finding_id``, given out as ``name``."""
    key = F.col("finding_id") if key is None else key
    first = F.min(F.struct("path_in_tree", "byte_offset"))
    grouped = locations.groupBy("run_id", key.alias(name)).agg(first.alias("f"), F.count("*").alias("location_count"))
    return grouped.select("run_id", name, F.col("f.path_in_tree").alias("artifact_path"), F.col("f.byte_offset").alias("byte_offset"), "location_count")


def placed(findings: DataFrame, locations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings as ``runs.packed`` makes them, with ``is_new`` and their first places. Rows of ``baseline`` may repeat."""
    key = lambda name: T.compact(F.col(name), b"-")  # noqa: E731  a null here is not the null of a finding
    old = baseline.select("run_id", key("id").alias("_id")).distinct().withColumn("_old", F.lit(True))
    rows = packed(findings, keyed=True)
    rows = rows.join(old, ["run_id", "_id"], "left").join(first_locations(locations, key("finding_id"), "_id"), ["run_id", "_id"], "left")
    return rows.withColumn("is_new", F.col("_old").isNull()).drop("_old")


def gate_findings(findings: DataFrame, locations: DataFrame, baseline: DataFrame) -> DataFrame:
    """The narrow view a decision needs; ``findings`` may lack a place."""
    return unpacked(placed(findings, locations, baseline), findings).withColumns(
        {
            "llm_dismissed": F.coalesce(F.col("llm_verdict") == "false_positive", F.lit(False)),
            "artifact_path": F.coalesce("artifact_path", F.lit("")),
        }
    )


def is_open() -> Column:
    return ~F.col("status").isin(*CLOSED)


def actionable() -> Column:
    """Open, or closed only by a model the policy does not trust."""
    return is_open() | (F.col("llm_dismissed") & ~F.col("trust_llm_dismissals"))


def blocking_reason() -> Column:
    return (
        F.when(F.array_contains("block_rules", F.col("rule_id")), "blocked_rule")
        .when(F.array_contains("block_categories", F.col("category")), "blocked_category")
        .when(T.severity_rank(F.col("severity")) <= F.col("floor_rank"), "severity_floor")
    )


#: What a decision can tell findings apart by: those that agree in all of it are one cell.
CELL = ["run_id", "rule_id", "category", "severity", "status", "llm_dismissed", "is_new", "expires"]


def with_waivers(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    covers = waivers.select(F.col("finding_id").alias("id"), F.col("owner"), F.col("reason").alias("waiver_reason"), "expires")
    return findings.join(covers, "id", "left")


def judged(rows: DataFrame, policies: list[Policy], today: Column) -> DataFrame:
    """Each row, a finding with its waiver or a cell of them, under each policy with its outcome.

    ``outcome``: ignored, inherited, considered, violation, expired_waiver or waived.
    """
    rows = with_policies(rows, policies).withColumns({"reason": blocking_reason(), "actionable": actionable()})
    outcome = (
        F.when(~F.col("actionable"), "ignored")
        .when((F.col("baseline_mode") == "new_only") & ~F.col("is_new"), "inherited")
        .when(F.col("reason").isNull(), "considered")
        .when(F.col("expires").isNull(), "violation")
        .when(T.waiver_expired(F.col("expires"), today), "expired_waiver")
        .otherwise("waived")
    )
    over = T.ttl_exceeded(F.col("expires"), today, F.col("max_waiver_days"))
    return rows.withColumn("outcome", outcome).withColumn("over_ttl", (F.col("outcome") == "waived") & over)


def outcomes(findings: DataFrame, policies: list[Policy], waivers: DataFrame, today: Column) -> DataFrame:
    """Each finding under each policy: as many rows as their product. Decisions are made on cells instead."""
    return judged(with_waivers(findings, waivers), policies, today)


def cells(rows: DataFrame) -> DataFrame:
    """Findings counted by all that a policy looks at; what is only counted meets policies as these rows."""
    return rows.groupBy(*CELL).agg(F.count("*").alias("n"))


def finding_violations(rows: DataFrame) -> DataFrame:
    owner = F.when(F.coalesce("owner", F.lit("")) == "", "unknown").otherwise(F.col("owner"))
    detail = (
        F.when(F.col("outcome") == "expired_waiver",
               F.concat(F.lit("waiver expired "), F.col("expires").cast("string"), F.lit(" (owner: "), owner, F.lit(")")))
        .when(F.col("reason") == "severity_floor", F.concat("severity", F.lit(" finding blocks release")))
        .when(F.col("reason") == "blocked_rule", F.concat(F.lit("rule "), "rule_id", F.lit(" is blocked by policy")))
        .otherwise(F.concat(F.lit("category "), "category", F.lit(" is blocked by policy")))
    )
    kind = F.when(F.col("outcome") == "expired_waiver", F.lit("expired_waiver")).otherwise(F.col("reason"))
    return rows.where(F.col("outcome").isin("violation", "expired_waiver")).select(
        "run_id", "policy", kind.alias("kind"), detail.alias("detail"), F.col("id").alias("finding_id"), "rule_id", "severity",
        "title", "artifact_path")


def budget_violations(rows: DataFrame) -> DataFrame:
    """Severities whose considered findings exceed the policy's budget, from judged cells."""
    limit = F.lit(UNLIMITED)
    for s in SEVERITIES:
        limit = F.when(F.col("severity") == s, F.col(f"budget_{s}")).otherwise(limit)
    counts = rows.where("outcome = 'considered'").groupBy("run_id", "policy", "severity", limit.alias("limit")).agg(F.sum("n").alias("n"))
    over = counts.where((F.col("limit") != UNLIMITED) & (F.col("n") > F.col("limit")))
    detail = F.concat(F.col("n").cast("string"), F.lit(" "), "severity", F.lit(" findings exceed the budget of "), F.col("limit").cast("string"))
    return over.select(
        "run_id", "policy", F.lit("budget_exceeded").alias("kind"), detail.alias("detail"), F.lit("").alias("finding_id"),
        F.lit("").alias("rule_id"), "severity", F.lit("").alias("title"), F.lit("").alias("artifact_path"))


def examined(runs: DataFrame, degraded: DataFrame) -> DataFrame:
    """Finished runs with the stages that fell short; a failed run counts as one such stage."""
    done = runs.where(F.col("status").isin(TERMINAL))
    error = F.col("error") if "error" in runs.columns else F.lit(None).cast("string")
    text = F.concat(F.lit("run failed: "), F.when(F.coalesce(error, F.lit("")) == "", "unknown error").otherwise(error))
    none = F.array().cast("array<string>")
    joined = done.join(degraded, "run_id", "left")
    return joined.select("run_id", F.col("status").alias("run_status"),
                         F.when(F.col("status") == "failed", F.array(text)).otherwise(F.coalesce("stages", none)).alias("stages"))


def degraded_violations(cases: DataFrame) -> DataFrame:
    detail = F.concat(F.lit("scan incomplete: "), F.concat_ws(", ", "stages"), F.lit(" did not finish, so the artifact was not fully examined"))
    return cases.where((F.size("stages") > 0) & (F.col("on_degraded") == "fail")).select(
        "run_id", "policy", F.lit("degraded_scan").alias("kind"), detail.alias("detail"), F.lit("").alias("finding_id"),
        F.lit("").alias("rule_id"), F.lit(None).cast("string").alias("severity"), F.lit("").alias("title"), F.lit("").alias("artifact_path"))


def tally(rows: DataFrame) -> DataFrame:
    """Everything a verdict needs from the judged cells of a run, in one aggregate."""
    outcome, severity = F.col("outcome"), F.col("severity")

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    return rows.groupBy("run_id", "policy").agg(
        F.sum("n").alias("total_findings"),
        *[count(severity == s, s) for s in SEVERITIES],
        *[count((severity == s) & F.col("is_new"), f"new_{s}") for s in SEVERITIES],
        *[count((severity == s) & (outcome == "considered"), f"considered_{s}") for s in SEVERITIES],
        count(outcome.isin("violation", "expired_waiver"), "finding_violations"),
        count(outcome == "waived", "waived"), count(outcome == "inherited", "inherited"), count(F.col("over_ttl"), "ttl_warnings"),
    )


def verdicts(cases: DataFrame, tallies: DataFrame) -> DataFrame:
    """One row per run and policy, runs without findings included."""
    counts = [c for c in tallies.columns if c not in ("run_id", "policy")]
    v = cases.join(tallies, ["run_id", "policy"], "left").na.fill(0, counts)
    over = [((F.col(f"budget_{s}") != UNLIMITED) & (F.col(f"considered_{s}") > F.col(f"budget_{s}"))).cast("bigint") for s in SEVERITIES]
    budgets = sum(over[1:], over[0])
    short = F.size("stages") > 0
    degraded = (short & (F.col("on_degraded") == "fail")).cast("bigint")
    v = v.withColumns({"budget_violations": budgets, "degraded_violations": degraded})
    found = F.col("finding_violations") + F.col("budget_violations")
    decision = (
        F.when(found > 0, "blocked")
        .when((F.col("degraded_violations") > 0) | (short & (F.col("on_degraded") == "warn")), "inconclusive")
        .otherwise("pass")
    )
    v = v.withColumns({"decision": decision, "violations": found + F.col("degraded_violations")})
    code = F.lit(None).cast("int")
    for name, number in EXIT_CODES.items():
        code = F.when(F.col("decision") == name, number).otherwise(code)
    quoted = F.concat(F.lit("'"), "policy", F.lit("'"))
    line = (
        F.when(F.col("decision") == "pass",
               F.concat(F.lit("PASS — "), F.col("total_findings").cast("string"), F.lit(" finding(s), none blocking under "), quoted))
        .when(F.col("decision") == "inconclusive",
              F.concat(F.lit("INCONCLUSIVE — scan incomplete ("), F.size("stages").cast("string"), F.lit(" degraded stage(s)) under "), quoted))
        .otherwise(F.concat(F.lit("BLOCKED — "), F.col("violations").cast("string"), F.lit(" violation(s) under "), quoted))
    )
    return v.select(
        "run_id", "policy", "decision", code.alias("exit_code"), line.alias("summary"), "total_findings", *SEVERITIES,
        *[f"new_{s}" for s in SEVERITIES], "violations", "waived", "inherited", "ttl_warnings",
        F.concat_ws("; ", "stages").alias("degraded_stages"))


def evaluate(runs: DataFrame, findings: DataFrame, degraded: DataFrame, waivers: DataFrame, policies: list[Policy],
             today: Column, view: Callable[[DataFrame], DataFrame] | None = None) -> Gate:
    """Decide every finished run under every policy.

    ``findings`` comes from :func:`gate_findings`, ``degraded`` from ``runs.degraded_stages``,
    ``waivers`` holds at most one valid row per finding.  With ``view`` the findings are plain, and ``view`` makes
    of those of judged runs what :func:`gate_findings` gives.
    """
    seen = examined(runs, degraded)
    cases = with_policies(seen, policies)
    whole = seen.where("run_status <> 'failed'").select("run_id")
    if view is None:
        findings = findings.join(whole, "run_id", "left_semi")
    else:
        findings = view(unpacked(packed(findings).join(whole, "run_id", "left_semi"), findings))
    rows = with_waivers(findings, waivers)
    under = judged(cells(rows), policies, today)
    each = judged(rows, policies, today)  # a projection of each finding, cheaper than meeting the cells again
    blocked = each.where(F.col("outcome").isin("violation", "expired_waiver"))
    found = finding_violations(blocked).unionByName(budget_violations(under)).unionByName(degraded_violations(cases))
    waived = each.where("outcome = 'waived'").select(
        "run_id", "policy", F.col("id").alias("finding_id"), "title", "severity", "owner", F.col("waiver_reason").alias("reason"), "expires")
    over = each.where("over_ttl").select(
        "run_id", "policy", F.concat(F.lit("waiver for "), F.substring("id", 1, 12), F.lit(" runs past the "),
                                     F.col("max_waiver_days").cast("string"), F.lit("-day maximum (expires "), F.col("expires").cast("string"), F.lit(")")).alias("warning"))
    partial = cases.where((F.size("stages") > 0) & (F.col("on_degraded") == "warn")).select(
        "run_id", "policy", F.concat(F.lit("scan incomplete: "), F.concat_ws(", ", "stages"), F.lit(" did not finish; findings may be partial")).alias("warning"))
    refused = runs.where(~F.col("status").isin(TERMINAL)).select(
        "run_id", F.concat(F.lit("run is "), "status", F.lit("; the gate needs a finished scan")).alias("error"))
    inherited = each.where("outcome = 'inherited'")
    return Gate(
        each, found, waived, inherited.select("run_id", "policy", "id", "rule_id", "category", "title", "severity", "status", "artifact_path"),
        partial.unionByName(over), verdicts(cases, tally(under)), refused, under)
