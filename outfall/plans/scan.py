"""The whole scan: artifacts to stored evidence, findings, locations and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.operators import composition as CO
from outfall.operators import correlate as C
from outfall.operators import extract as X
from outfall.operators import gate as G
from outfall.operators import match
from outfall.operators import recon as R
from outfall.rules.pack import RulePack
from outfall.sources.policies import Policy
from outfall.sources.sinks import RunWriter


def rule_dimension(pack: RulePack, spark) -> DataFrame:
    return pack.rules_df(spark).withColumnRenamed("name", "title")


def scan_to_tables(artifacts: DataFrame, pack: RulePack, base: str, suppressions: DataFrame | None = None,
                   retain_plaintext: bool = False, inventory: bool = False) -> None:
    """``artifacts``: run_id, path_in_tree, content, whole files or their ranges.

    Evidence is written once and read back, so correlation does not scan the
    content again for each of its outputs.  All runs of ``artifacts`` get a row
    in ``scanned``, those without findings too, and all tables of the call are
    one version.  With ``inventory`` that version also has ``artifacts``,
    ``recon``, ``residue`` and ``components``.
    """
    spark = artifacts.sparkSession
    writer = RunWriter(spark, base, artifacts.select("run_id"))
    evidence = writer.table("evidence", match.scan(artifacts, pack, ["run_id", "path_in_tree"], retain_plaintext=retain_plaintext))
    result = C.correlate(evidence, rule_dimension(pack, spark), suppressions)
    writer.table("findings", result.findings)
    writer.table("locations", result.locations)
    writer.table("scanned", writer.runs.withColumns({"status": F.lit("completed"), "rule_pack_version": F.lit(pack.version), "rule_pack_hash": F.lit(pack.hash)}))
    if inventory:
        inventory_tables(writer, artifacts, evidence)
    writer.commit()


def inventory_tables(writer: RunWriter, artifacts: DataFrame, evidence: DataFrame) -> None:
    """What else a scan says about its files: digests and sizes, rare values, strings that no rule matched, declared components. Whole files only."""
    by = ["run_id"]
    files = artifacts.select(*by, "path_in_tree", F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    writer.table("artifacts", files)
    strings = X.extract_strings(artifacts, ["run_id", "path_in_tree"])
    writer.table("recon", R.recon_samples(R.value_counts(R.claims(strings, by), by), by))
    writer.table("residue", R.residue_by(strings, evidence, by))
    named = artifacts.withColumn("filename", F.regexp_extract("path_in_tree", "[^/ ]*$", 0))
    writer.table("components", CO.component_inventory(CO.detect_components(named, by), by))


def gate_new(findings: DataFrame, locations: DataFrame, policies: list[Policy], today: Column, runs: DataFrame | None = None,
             stages: DataFrame | None = None) -> G.Gate:
    """Gate freshly correlated findings: no baseline, no waivers.

    ``runs`` (run_id, status) has every run to judge, clean ones too; without it those with findings. ``stages`` (run_id, stages)
    names degraded stages; without it all are complete.
    """
    spark = findings.sparkSession
    fresh = findings.withColumns({"status": F.lit("open"), "llm_verdict": F.lit(None).cast("string")})
    none = findings.select("run_id", "id").where(F.lit(False))
    if runs is None:
        runs = findings.select("run_id").distinct().withColumn("status", F.lit("completed"))
    if stages is None:
        stages = spark.createDataFrame([], "run_id string, stages array<string>")
    waivers = spark.createDataFrame([], "finding_id string, reason string, owner string, expires date")
    return G.evaluate(runs, G.gate_findings(fresh, locations, none), stages, waivers, policies, today)
