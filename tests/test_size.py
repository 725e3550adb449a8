"""What grows with the input: work done once, tasks and lists of bounded size."""

import hashlib
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from outfall.operators import correlate as C
from outfall.operators import gate as G
from outfall.plans import exports
from outfall.queries import QUERIES, gate, inputs, review, streams
from outfall.sources.archives import _expander
from outfall.sources.policies import Policy
from outfall.sources.ranges import RangeReader


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def evidence(spark, n=120):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("b"), k % 2).alias("run_id"), F.concat(F.lit("f"), k % 7).alias("path_in_tree"), F.when(k % 10 == 0, "few").otherwise("many").alias("rule_id"),
        F.md5(k.cast("string")).alias("value_hash"), F.concat(F.lit("v"), k).alias("value_masked"), k.alias("byte_offset"), F.lit("ascii").alias("encoding"), F.lit(3.0).alias("entropy"))


def rules(spark):
    return spark.createDataFrame([(r, r, "c", "low", 0.5, 0.0) for r in ("few", "many")], "rule_id string, title string, category string, severity string, confidence double, min_entropy double")


def test_findings_are_correlated_once(spark, monkeypatch):
    """calls, verdicts and summary read one stored correlation."""
    class Given:
        def evidence(self):
            return evidence(spark)

        def view(self, name):
            return rules(spark).withColumnRenamed("confidence", "base_confidence")

    calls, real = [], C.correlate
    monkeypatch.setattr(review.C, "correlate", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr("outfall.queries.registry.Inputs", lambda *_: Given())
    for name in ("agg_16_triage_summary", "tri_03_apply_verdicts", "jon_15_verdict_findings"):
        calls.clear()
        assert QUERIES[name](spark, "").count() > 0
        assert len(calls) == 1


def test_cluster_lists_are_joined_by_beginnings(spark):
    """One text for each of 256 beginnings reaches a cluster's list; its hash is that over all prefixes."""
    ids = [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(600)]
    rows = [("b", "r", "v" + i, i, "T", "c", "low", 0.5, "m" + i, 1.0, None, "p", 1) for i in ids]
    found = C.cluster_rules(spark.createDataFrame(rows, "run_id string, rule_id string, value_hash string, id string, title string, category string, severity string, confidence double, value_masked string, entropy double, context string, anchor_path string, evidence_count long"))
    parts = {}
    for i in sorted(ids):
        parts.setdefault(i[:4], []).append("v" + i)
    text = ",".join(hashlib.sha256(",".join(parts[p]).encode()).hexdigest() for p in sorted(parts))
    row = found.first()
    assert row["value_hash"] == hashlib.sha256(f"cluster:r:{text}".encode()).hexdigest()
    assert row["value_masked"] == "600 values, e.g. " + ", ".join("m" + i for i in sorted(ids)[:3])
    assert plan(found).count("collect_list(struct(part") == 2


def test_suppressions_are_looked_up_once(spark):
    """what is suppressed comes from a stored table, not from the evidence again."""
    some = spark.createDataFrame([("few", hashlib.md5(b"10").hexdigest(), "f*"), ("gone", "x", "*")], "rule_id string, value_hash string, path_pattern string")
    result = C.correlate(evidence(spark), rules(spark), some)
    assert [r["run_id"] for r in result.suppressed.collect()] == ["b0"]
    assert "Range (" not in plan(result.suppressed) and "Range (" not in plan(result.findings)
    assert result.findings.count() == C.correlate(evidence(spark), rules(spark)).findings.count() - 1


def test_outcomes_need_no_second_reading(spark):
    """A finding's own outcome decides, without a join with its cell."""
    k = F.col("id")
    found = spark.range(50).select(F.lit("r").alias("run_id"), k.cast("string").alias("id"), F.lit("x").alias("rule_id"), F.lit("c").alias("category"), F.lit("t").alias("title"), F.lit("high").alias("severity"),
                                   F.lit("open").alias("status"), (k % 2 == 0).alias("is_new"), F.lit(False).alias("llm_dismissed"), F.lit("p").alias("artifact_path"))
    waivers = spark.createDataFrame([("2", "o", "why", "2030-01-01")], "finding_id string, owner string, reason string, expires string").withColumn("expires", F.to_date("expires"))
    gate = G.evaluate(spark.createDataFrame([("r", "completed")], "run_id string, status string"), found, spark.createDataFrame([], "run_id string, stages array<string>"), waivers, [Policy()], F.expr("DATE '2024-02-15'"))
    for part, n in ((gate.inherited, 25), (gate.waived, 1)):
        assert part.count() == n and plan(part).count("Range (") == 1
    assert gate.violations.count() == 24 and plan(gate.violations).count("Range (") == 2


def test_small_ranges_share_a_task(tmp_path):
    """512 ranges of 128 KB are 64 tasks; every byte is in one range."""
    with open(tmp_path / "big", "wb") as f:
        f.truncate(64 << 20)
    parts = RangeReader({"path": str(tmp_path), "range_bytes": str(128 << 10)}).partitions()
    ranges = [r for p in parts for r in p.ranges]
    assert len(parts) == 64 and len(ranges) == 512
    assert [r[2] for r in ranges] == list(range(0, 64 << 20, 128 << 10)) and ranges[-1][3] == 64 << 20


def test_members_of_small_archives_go_on_together():
    """F16: one frame for many archives; a broken one is still a row."""
    def packed(i):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", f"text {i}")
        return out.getvalue()

    rows = [(f"{i}.zip", f"{i}.zip", 0, "zip", packed(i) if i else b"PK") for i in range(40)]
    frames = list(_expander(1 << 20, 10)(iter([pd.DataFrame(rows, columns=["root", "path_in_tree", "depth", "container", "content"])])))
    assert [len(f) for f in frames] == [40]
    assert frames[0]["error"].notna().sum() == 1 and sorted(frames[0]["content"].dropna()) == sorted(f"text {i}".encode() for i in range(1, 40))


def test_streamed_files_are_bounded(spark, tmp_path, monkeypatch):
    """more text means more files, still for two micro-batches."""
    seen = []

    class Ended:
        def awaitTermination(self):
            pass

    spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "LANDED_BYTES", 4000, raising=False)
    monkeypatch.setattr(streams, "scan_stream", lambda landed, *a: seen.append(landed) or Ended())
    base = streams._streamed(inputs.Inputs(spark, str(tmp_path)))
    landed = spark.read.parquet(f"{base}/landed")
    assert landed.count() == 200 and len(landed.inputFiles()) == 6
    assert len(seen) == 1


def test_splits_are_not_spread_again(spark, tmp_path):
    """one file that Spark reads in enough parts is not shuffled first; too few splits become more parts than cores."""
    spark.range(0, 200_000, 1, 1).withColumn("text", F.md5(F.col("id").cast("string"))).write.option("parquet.block.size", 200_000).parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 400_000)
    try:
        assert "RepartitionByExpression" not in plan(inputs.spread(spark.read.parquet(str(tmp_path / "t")), "id"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one.count() == 200_000


def test_evidence_is_grouped_in_one_pass(spark):
    """one aggregate from evidence to groups; the anchor is the first place, a null offset counts as 0."""
    rows = [("r", "x", "v", "b", 1, "ascii", "m1", 1.0), ("r", "x", "v", "a", 5, "utf-16le", "m2", 4.0), ("r", "x", "v", "a", None, "utf-16le", "m3", 2.0), ("r", "x", "v", "a", 0, "ascii", "m5", 2.0), ("r", "x", "v", "a", 0, "ascii", "m4", 3.0)]
    some = spark.createDataFrame(rows, "run_id string, rule_id string, value_hash string, path_in_tree string, byte_offset long, encoding string, value_masked string, entropy double")
    found = C.evidence_groups(some)
    row = found.first()
    assert plan(found).count("Aggregate [") == 1
    assert (row["anchor"]["value_masked"], row["anchor"]["byte_offset"], row["peak"], row["evidence_count"], row["wide"]) == ("m4", 0, 4.0, 5, 1)


class Gated:
    """Views of a gate: ids of three kinds and none, a run with a predecessor, one that failed, one without a name."""

    def __init__(self, spark):
        hexed = [hashlib.md5(str(i).encode()).hexdigest() for i in range(4)]
        ids = [*hexed, hexed[0].upper(), "short", "0" * 31, "é", "", None]
        found = [(i, run, f"rule-{k % 3}", "cat-3", f"T{k}", ("high", "low")[k % 2], "open", None) for run in ("r0", "r1", "r2") for k, i in enumerate(ids) if run != "r0" or k % 4]
        frame = spark.createDataFrame(found, "id string, run_id string, rule_id string, category string, title string, severity string, status string, llm_verdict string")
        self.views = {
            "findings": frame.groupBy(*frame.columns).agg(F.max(F.lit(0.5)).alias("confidence")),
            "finding_locations": spark.createDataFrame([(i, run, p, 7) for i in ids for run in ("r1", "r2") for p in ("b", "a")], "finding_id string, run_id string, path_in_tree string, byte_offset long"),
            "runs": spark.createDataFrame([("r0", "pkg", "completed", "2024-01-01"), ("r1", "pkg", "completed", "2024-01-02"), ("r2", None, "failed", "2024-01-03")], "run_id string, name string, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at")),
            "stages": spark.createDataFrame([], "run_id string, analyzer string, status string"),
            "waivers": spark.createDataFrame([], "finding_id string, reason string, owner string, expires date")}

    def view(self, name):
        return self.views[name]


def exchanges(df):
    """Exchanges that are written, by their keys."""
    spark = df.sparkSession
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    lines = [line for line in text.splitlines() if "ReusedExchange" not in line]
    return [re.sub(r"#\d+L?", "", m[1]) for line in lines if (m := re.search(r"Exchange (?:hash|range)partitioning\((.*), \d+\)", line))]


def test_gate_deals_findings_out_once(spark):
    """violations and budgets share the findings' exchanges, which also give the baseline; rows as before."""
    found = gate.gate(Gated(spark), [gate.DEFAULT, gate.STRICT]).violations
    assert exchanges(found).count("id, run_id, rule_id, category, title, severity, status, llm_verdict") == 1
    rows = [r for r in found.collect() if r["policy"] == "strict" and r["finding_id"] != ""]
    assert len([r for r in rows if r["run_id"] == "r1"]) == 9 and not any(r["run_id"] == "r2" for r in rows)  # one id is ''
    assert all(r["artifact_path"] == ("a" if r["run_id"] == "r1" and r["finding_id"] is not None else "") for r in rows)
    new = {r["id"] for r in gate.gate(Gated(spark), [gate.DEFAULT]).outcomes.where("run_id = 'r1' AND is_new").collect()}
    assert new == {None, "", hashlib.md5(b"0").hexdigest(), hashlib.md5(b"0").hexdigest().upper()}


def test_release_findings_travel_once_by_run(spark, monkeypatch):
    """the names and the baseline read one exchange; rows are in order, with ids as they were."""
    monkeypatch.setattr("outfall.queries.registry.Inputs", lambda *_: Gated(spark))
    found = QUERIES["snk_05_release_findings"](spark, "")
    assert exchanges(found).count("id, run_id, rule_id, category, title, severity, status, llm_verdict") == 1
    rows = found.collect()
    key = lambda r: (r["run_id"], r["severity_rank"], r["rule_id"], r["id"] is not None, r["id"] or "")
    assert rows == sorted(rows, key=key)
    given = Gated(spark).view("findings").collect()
    assert sorted((r["run_id"], str(r["id"]), r["title"]) for r in rows) == sorted((r["run_id"], str(r["id"]), r["title"]) for r in given)
    assert {(r["run_id"], r["path_in_tree"], r["byte_offset"]) for r in rows if r["id"] is not None} == {("r0", "pkg", None), ("r1", "a", 7), ("r2", "a", 7)}
    assert {(r["run_id"], r["path_in_tree"]) for r in rows if r["id"] is None} == {("r0", "pkg"), ("r1", "pkg"), ("r2", None)}


def test_sarif_rules_are_looked_up_by_run(spark, monkeypatch):
    """a rule's place in its run's list comes with the findings' exchange by run, not by another one of placed findings."""
    monkeypatch.setattr("outfall.queries.registry.Inputs", lambda *_: Gated(spark))
    found = QUERIES["snk_02_sarif_results"](spark, "")
    keys = exchanges(found)
    assert keys.count("id, run_id, rule_id, category, title, severity, status, llm_verdict") == 1 and "run_id, rule_id" not in keys
    assert {(r["rule_id"], r["rule_index"]) for r in found.collect()} == {("rule-0", 0), ("rule-1", 1), ("rule-2", 2)} and found.count() == 27
    rows = spark.createDataFrame([("r", "a", "1"), ("r", None, "2"), ("r", "c", "3"), ("s", "c", "4"), (None, "c", "5")], "run_id string, rule_id string, id string")
    rows = rows.withColumns({c: F.lit("low") for c in ("title", "severity", "category", "status", "artifact_path", "value_masked")}).withColumns({"byte_offset": F.lit(1), "is_new": F.lit(True)})
    assert {(r["fingerprint"], r["rule_index"]) for r in exports.sarif_rows(rows).collect()} == {("1", 1), ("3", 2), ("4", 0)}  # a rule that is null stands first
