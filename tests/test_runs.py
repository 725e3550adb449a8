"""Clean and repeated runs, path patterns, archive budgets and documents of clean runs."""

import fnmatch
import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from outfall.operators.correlate import cluster_rules, glob_regex, suppressed_groups
from outfall.operators.gate import Gate
from outfall.plans import scan as PS
from outfall.plans.exports import sarif_lines
from outfall.rules.pack import builtin_pack
from outfall.sources.archives import archive_expand
from outfall.sources.policies import Policy
from outfall.sources.sinks import read_manifest, read_run, vacuum, write_run

SECRET = "token ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"


def test_path_patterns_match_like_a_shell(spark):
    rng = random.Random(7)
    pieces = ["a", "b", "/", ".", "*", "?", "[", "]", "[!", "[ab]", "[a-c]", "[c-a]", "[]x]", "[^a]", "-", "&&", "\\", "~", "(", "|", "é"]
    patterns = ["a[b*", "a[[]b*", "[!a-]", "[]", "[!]", "[a-]", "[[-]]", "**", "a?b", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(250))]
    paths = ["a", "ab", "abc", "a[b", "a[bc", "b/c", "-", "]", "x", "a&&b", "\\", "^", "~", "(", "é", "a.b", "[]", "[!]", "c"]
    cases = spark.createDataFrame([(p, s) for p in patterns for s in paths], "pattern string, path string")
    for row in cases.withColumn("hit", F.regexp_like("path", glob_regex(F.col("pattern")))).collect():
        assert row["hit"] == bool(re.match(fnmatch.translate(row["pattern"]), row["path"])), row


def test_many_patterns_of_one_value(spark):
    rng = random.Random(3)
    pieces = ["a", "b/", "x.z", "*", "?", "[ab]", "[!a]", "[", "]", "é"]
    patterns = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(300)} - {"*", "?*", "*?", "**"})
    paths = sorted({"".join(rng.choice(["a", "b/", "x.z", "[", "]", "é", "q"]) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    groups = spark.createDataFrame([(f"r{i}", "rule", "v", (p,)) for i, p in enumerate(paths)], "run_id string, rule_id string, value_hash string, anchor struct<path_in_tree: string>")
    one = lambda found: spark.createDataFrame([("rule", "v", p) for p in found], "rule_id string, value_hash string, path_pattern string")
    for some in (patterns[::7], patterns[3::40], patterns[5:8]):
        want = sorted(p for p in paths if any(re.match(fnmatch.translate(x), p) for x in some))
        for how in ("left_semi", "left_anti"):
            got = sorted(r["anchor"]["path_in_tree"] for r in suppressed_groups(groups, one(some), how).collect())
            assert got == (want if how == "left_semi" else sorted(set(paths) - set(want))), some
    # 100,000 patterns on one value: only those that share their literal part are tried
    many = spark.range(100_000).select(F.lit("rule").alias("rule_id"), F.lit("v").alias("value_hash"), F.concat(F.lit("dir"), F.format_string("%06d", "id"), F.lit("/*.txt")).alias("path_pattern"))
    rows = spark.range(2_000).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit("rule").alias("rule_id"), F.lit("v").alias("value_hash"),
                                     F.struct(F.concat(F.lit("dir"), F.format_string("%06d", F.col("id") * 70), F.lit("/a.txt")).alias("path_in_tree")).alias("anchor"))
    assert suppressed_groups(rows, many, "left_semi").count() == 1429


def test_a_clean_rerun_replaces_findings_and_passes(spark, tmp_path):
    base, pack = str(tmp_path / "out"), builtin_pack()
    rows = lambda *r: spark.createDataFrame([(run, path, text.encode()) for run, path, text in r], "run_id string, path_in_tree string, content binary")
    PS.scan_to_tables(rows(("007", "a.txt", SECRET), ("008", "b.txt", SECRET)), pack, base)
    run_only = spark.createDataFrame([], "run_id string")
    tables = lambda name: {r["run_id"] for r in read_run(spark, base, name, run_only).collect()}
    assert tables("findings") == tables("evidence") == tables("locations") == {"007", "008"}
    PS.scan_to_tables(rows(("007", "a.txt", "nothing to see in this clean file")), pack, base)
    assert tables("findings") == tables("evidence") == tables("locations") == {"008"}
    scanned = read_run(spark, base, "scanned", spark.createDataFrame([], "status string, run_id string"))
    assert {r["run_id"] for r in scanned.collect()} == {"007", "008"}
    like = spark.createDataFrame([], "id string, rule_id string, value_hash string, title string, category string, severity string, confidence double, value_masked string, entropy double, run_id string")
    places = spark.createDataFrame([], "finding_id string, path_in_tree string, byte_offset bigint, encoding string, run_id string")
    gate: Gate = PS.gate_new(read_run(spark, base, "findings", like), read_run(spark, base, "locations", places), [Policy()], F.expr("DATE '2024-02-15'"), scanned)
    decisions = {r["run_id"]: r["decision"] for r in gate.verdicts.select("run_id", "decision").collect()}
    assert decisions["007"] == "pass" and decisions["008"] == "blocked"


def test_a_write_that_fails_leaves_the_old_run(spark, tmp_path):
    base = str(tmp_path / "out")
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    rows = lambda n, run="r1": spark.range(n).select(F.lit(run).alias("run_id"), F.col("id").alias("x"))
    write_run(base, runs, a=rows(3), b=rows(4))
    broken = rows(5).withColumn("x", F.when(F.col("x") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        write_run(base, runs, a=rows(9), b=broken)
    count = lambda name: read_run(spark, base, name, rows(1)).count()
    assert (count("a"), count("b")) == (3, 4)
    write_run(base, spark.createDataFrame([("r2",)], "run_id string"), a=rows(2, "r2"), b=rows(1, "r2"))
    assert (count("a"), count("b")) == (5, 5)
    write_run(base, runs, a=rows(1, "r1"), b=rows(0))
    assert (count("a"), count("b")) == (1, 0)
    seen = {(r["run_id"], r["table"]): r["rows"] for r in read_manifest(spark, base).collect()}
    assert seen == {("r1", "a"): 1, ("r1", "b"): 0, ("r2", "a"): 0, ("r2", "b"): 0}
    assert len(vacuum(spark, base)) == 2 and (count("a"), count("b")) == (1, 0)
    again = str(tmp_path / "again")
    write_run(again, runs, a=rows(1, "r1").repartition(3), b=rows(0))
    marks = lambda b: sorted((r["run_id"], r["table"], r["fingerprint"] or "") for r in read_manifest(spark, b).collect())
    assert marks(base) == marks(again)


def test_a_scan_with_its_inventory(spark, tmp_path):
    base = str(tmp_path / "out")
    files = [("r", "a.txt", SECRET + "\nserver build01.de.example.net\nlicence = contract-4711-x"), ("r", "node_modules/m/package.json", '{"name":"m","version":"1.0"}'), ("clean", "b.txt", "")]
    artifacts = spark.createDataFrame([(r, p, t.encode()) for r, p, t in files], "run_id string, path_in_tree string, content binary")
    PS.scan_to_tables(artifacts, builtin_pack(), base, inventory=True)
    got = {(r["run_id"], r["table"]): r["rows"] for r in read_manifest(spark, base).collect()}
    assert {t for _, t in got} == {"evidence", "findings", "locations", "scanned", "artifacts", "recon", "residue", "components"}
    assert got["r", "artifacts"] == 2 and got["r", "components"] == 1 and got["r", "recon"] >= 2 and got["clean", "artifacts"] == 1 and got["clean", "findings"] == 0
    left = read_run(spark, base, "residue", spark.createDataFrame([], "run_id string, value string"))
    assert "licence = contract-4711-x" in {r["value"] for r in left.collect()}


def test_a_clean_run_has_a_document(spark):
    findings = spark.createDataFrame([("r1", "rule", "t", "c", "high", "m***", "p", 3, "id1", "open", True)] * 2,
                                     "run_id string, rule_id string, title string, category string, severity string, value_masked string, artifact_path string, byte_offset bigint, id string, status string, is_new boolean")
    lines = sarif_lines(findings, runs=spark.createDataFrame([("r1",), ("clean",)], "run_id string")).orderBy("run_id", "section", "key").collect()
    by = {}
    for r in lines:
        by[r["run_id"]] = by.get(r["run_id"], "") + r["line"]
    assert {k: len(json.loads(v)["runs"][0]["results"]) for k, v in by.items()} == {"r1": 1, "clean": 0}


def test_gzip_stops_at_the_budget_and_unread_containers_say_so(spark):
    bomb, small = gzip.compress(b"0" * 3_000_000), gzip.compress(b"hello there")
    nested = gzip.compress(gzip.compress(small))
    data = [("bomb.txt.gz", bomb), ("small.txt.gz", small), ("deep.gz", nested), ("x.7z", bytes.fromhex("377abcaf271c") + b"0" * 40)]
    got = archive_expand(spark.createDataFrame(data, "path_in_tree string, content binary"), max_depth=2, max_bytes=1_000_000).collect()
    by = {r["path_in_tree"]: r for r in got}
    assert any("budget" in (r["error"] or "") for r in got if r["root"] == "bomb.txt.gz") and not any((r["size_bytes"] or 0) > 1_000_000 for r in got)
    assert by["small.txt.gz → small.txt"]["content"] == b"hello there"
    assert any(r["error"] == "nested too deep" for r in got if r["root"] == "deep.gz")
    assert by["x.7z"]["error"] == "no reader for 7z"


def test_cluster_ids_have_one_definition(spark):
    import hashlib

    rows = [("r", "rule", f"{i:032x}"[::-1], f"h{i}", f"m{i}", 0.5, "a", 1.0, None, "T", "c", "low") for i in range(40)]
    df = spark.createDataFrame(rows, "run_id string, rule_id string, id string, value_hash string, value_masked string, confidence double, anchor_path string, entropy double, context string, title string, category string, severity string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts = {}
    for r in sorted(rows, key=lambda r: r[2]):
        parts.setdefault(r[2][:4], []).append(r[3])
    expected = digest("cluster:rule:" + ",".join(digest(",".join(v)) for _, v in sorted(parts.items())))
    assert [r["value_hash"] for r in cluster_rules(df).collect()] == [expected]
