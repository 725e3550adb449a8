"""Correlation, gate and ordered operators on small cases."""

import hashlib
from datetime import date

from pyspark.sql import functions as F

from outfall.operators import correlate as C
from outfall.operators import gate as G
from outfall.operators import runs as R
from outfall.operators.ordered import previous_value, top_k
from outfall.sources.policies import Policy, PolicyError, parse_policy, waiver_validate

import pytest

RULES = "rule_id string, title string, category string, severity string, confidence double, min_entropy double"
EVIDENCE = "run_id string, path_in_tree string, rule_id string, value_hash string, value_masked string, byte_offset bigint, encoding string, entropy double"


def fid(rule, value, path, offset):
    return hashlib.sha256("\x1f".join([rule, value, path, str(offset)]).encode()).hexdigest()[:32]


def evidence(spark, n):
    rows = [("r", f"p{i % 3}", "a", f"v{i:03d}", f"m{i}", i, "ascii", 3.0) for i in range(n)]
    return spark.createDataFrame(rows, EVIDENCE)


def rules(spark):
    return spark.createDataFrame([("a", "Rule A", "cat", "high", 0.5, 0.0)], RULES)


def test_twenty_stay_and_twenty_one_cluster(spark):
    assert C.correlate(evidence(spark, 20), rules(spark)).findings.count() == 20
    result = C.correlate(evidence(spark, 21), rules(spark))
    (row,) = result.findings.collect()
    members = sorted((fid("a", f"v{i:03d}", f"p{i % 3}", i), f"v{i:03d}", f"p{i % 3}", f"m{i}") for i in range(21))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    parts = [sha(",".join(m[1] for m in members if m[0][:4] == start)) for start in sorted({m[0][:4] for m in members})]
    digest = sha("cluster:a:" + ",".join(parts))
    assert row.value_hash == digest and row.id == fid("a", digest, members[0][2], 0)
    assert row.title == "Rule A (21 distinct values)"
    assert row.value_masked == "21 values, e.g. " + ", ".join(m[3] for m in members[:3])
    assert result.locations.where(F.col("finding_id") == row.id).count() == 21


def test_cluster_ids_do_not_depend_on_the_layout(spark):
    single = C.score_groups(C.group_evidence(C.evidence_places(evidence(spark, 60))), rules(spark))
    (one,) = C.cluster_rules(single).collect()
    (again,) = C.cluster_rules(single.repartition(5)).collect()
    assert (one.value_hash, one.value_masked, one.members, one.anchor_path) == (again.value_hash, again.value_masked, 60, again.anchor_path)


def test_suppression_uses_the_anchor_path_and_globs(spark):
    ev = spark.createDataFrame([("r", "b/x.conf", "a", "v1", "m", 5, "ascii", 3.0), ("r", "a/y.conf", "a", "v1", "m", 9, "ascii", 3.0),
                                ("r", "b/z.conf", "a", "v2", "m", 1, "ascii", 3.0)], EVIDENCE)
    schema = "rule_id string, value_hash string, path_pattern string"
    hit = C.correlate(ev, rules(spark), spark.createDataFrame([("a", "v1", "a/?.conf")], schema))
    miss = C.correlate(ev, rules(spark), spark.createDataFrame([("a", "v1", "b/*")], schema))
    assert [r.value_hash for r in hit.findings.collect()] == ["v2"] and hit.suppressed.count() == 1
    assert miss.findings.count() == 2 and miss.suppressed.count() == 0


def gate(spark, findings, policy, waivers=(), stages=(), status="completed"):
    runs = spark.createDataFrame([("r", status)], "run_id string, status string")
    rows = [(i, "r", f"rule-{i}", "cat", "T", sev, st, new, dismissed, "", "") for i, sev, st, new, dismissed in findings]
    df = spark.createDataFrame(rows, "id string, run_id string, rule_id string, category string, title string, severity string, status string,"
                                     " is_new boolean, llm_dismissed boolean, artifact_path string, value_masked string")
    w = spark.createDataFrame(list(waivers), "finding_id string, reason string, owner string, expires date")
    d = spark.createDataFrame([("r", list(stages))] if stages else [], "run_id string, stages array<string>")
    return G.evaluate(runs, df, d, w, [policy], F.expr("DATE '2024-02-15'"))


def decision(result):
    (row,) = result.verdicts.collect()
    return row.decision, row.exit_code


def test_gate_decisions(spark):
    high, old, low = ("h", "high", "open", True, False), ("o", "critical", "open", False, False), ("l", "low", "open", True, False)
    import datetime as dt

    day = dt.date(2024, 2, 15)
    assert decision(gate(spark, [low, old], Policy())) == ("pass", 0)
    assert decision(gate(spark, [high], Policy())) == ("blocked", 1)
    assert decision(gate(spark, [], Policy(), stages=["static (failed)"])) == ("inconclusive", 3)
    assert decision(gate(spark, [high], Policy(), stages=["static (failed)"])) == ("blocked", 1)
    assert decision(gate(spark, [], Policy(on_degraded="warn"), stages=["x (oom)"])) == ("inconclusive", 3)
    assert decision(gate(spark, [], Policy(on_degraded="pass"), stages=["x (oom)"])) == ("pass", 0)
    assert decision(gate(spark, [], Policy(), status="failed")) == ("inconclusive", 3)
    assert decision(gate(spark, [high], Policy(), [("h", "r", "o", day)])) == ("pass", 0)  # valid on its last day
    assert decision(gate(spark, [high], Policy(), [("h", "r", "o", day - dt.timedelta(days=1))])) == ("blocked", 1)
    assert decision(gate(spark, [low], Policy(budgets={"low": 1}))) == ("pass", 0)  # exactly at the limit
    assert decision(gate(spark, [low], Policy(budgets={"low": 0}))) == ("blocked", 1)
    closed = ("c", "high", "false_positive", True, True)
    assert decision(gate(spark, [closed], Policy())) == ("blocked", 1)
    assert decision(gate(spark, [closed], Policy(trust_llm_dismissals=True))) == ("pass", 0)
    assert gate(spark, [high], Policy(), status="running").refused.count() == 1


def test_policy_and_waiver_errors(spark):
    for bad in ({"version": 2}, {"block": {"severity_at_or_above": "urgent"}}, {"budgets": {"low": -2}}, {"baseline": {"mode": "x"}},
                {"on_degraded": "x"}, {"waivers": {"max_ttl_days": 0}}, {"block": {"rules": "x"}}):
        with pytest.raises(PolicyError):
            parse_policy(bad)
    assert parse_policy({"block": {"severity_at_or_above": "off"}}).floor is None
    rows = [("f1", "r", "o", None), ("f2", "", "o", "2024-03-01"), ("f3", "r", "", "2024-03-01"), ("f4", "r", "o", "2024-03-01"), ("f4", "r", "o", "2024-03-02"), ("f5", "r", "o", "2024-03-02")]
    df = spark.createDataFrame(rows, "finding_id string, reason string, owner string, expires string").withColumn("expires", F.to_date("expires"))
    errors = {r.finding_id: r.error for r in waiver_validate(df, Policy()).collect()}
    assert errors["f5"] is None and all(errors[f"f{i}"] for i in range(1, 5))


def test_previous_value_equals_a_plain_scan(spark):
    rows = [(f"k{i % 2}", i, (i * 7) % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = {(r.k, r.t): r.prev for r in previous_value(df, ["k"], ["t"], F.floor(F.col("t") / 6), F.col("v"), "prev", where=F.col("v") > 2).collect()}
    last = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        assert got[(k, t)] == last.get(k)
        if v > 2:
            last[k] = v


def test_salted_top_k(spark):
    df = spark.range(6000).select(F.lit("hot").alias("k"), F.col("id"))
    kept = {r.id for r in top_k(df, ["k"], ["id"], 1500).collect()}
    assert kept == set(range(1500))


def test_run_diff(spark):
    f = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3")], "run_id string, id string")
    links = spark.createDataFrame([("a", None), ("b", "a")], "run_id string, baseline_id string")
    assert {(r.id, r.change) for r in R.run_diff(f, links).collect()} == {("1", "fixed"), ("2", "inherited"), ("3", "new")}


def test_many_policies_meet_cells_not_findings(spark):
    rows = [("r", f"f{i}", f"rule{i % 3}", "cat", ("critical", "low", "high")[i % 3], "T", "open", None, i % 2 == 0) for i in range(600)]
    findings = spark.createDataFrame(rows, "run_id string, id string, rule_id string, category string, severity string, title string, status string, llm_verdict string, is_new boolean")
    findings = findings.withColumns({"llm_dismissed": F.lit(False), "artifact_path": F.lit("p"), "byte_offset": F.lit(1)})
    waivers = spark.createDataFrame([("f0", "r", "o", date(2024, 3, 1)), ("f3", "r", "o", date(2024, 1, 1)), ("f6", "r", "o", date(2030, 1, 1))], "finding_id string, reason string, owner string, expires date")
    policies = [Policy(name=f"p{i}", floor="critical" if i % 2 else None, budgets={"low": i}, baseline_mode="all") for i in range(40)]
    runs = spark.createDataFrame([("r", "completed")], "run_id string, status string")
    none = spark.createDataFrame([], "run_id string, stages array<string>")
    gate = G.evaluate(runs, findings, none, waivers, policies, F.expr("DATE '2024-02-15'"))
    assert gate.counted.count() == 40 * gate.counted.where("policy = 'p0'").count() <= 40 * 9
    plain = gate.outcomes.groupBy("policy", "outcome").count()
    cells = gate.counted.groupBy("policy", "outcome").agg(F.sum("n").alias("count"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cells.collect()))
    assert gate.violations.where("policy = 'p1' AND finding_id <> ''").count() == 198 and gate.waived.where("policy = 'p1'").count() == 2
    assert {r["n"] for r in gate.violations.where("kind = 'expired_waiver'").groupBy("policy").agg(F.count("*").alias("n")).collect()} == {1}
    assert gate.warnings.where("policy = 'p1'").count() == 1
