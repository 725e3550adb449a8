"""Incremental scan: newly landed artifacts to evidence, findings and verdicts of the touched runs.

The state of a run is one row per (rule, value), made of parts that can be merged: smallest place, largest entropy, number of hits. A micro-batch scans
its own artifacts, merges what it found with the state of the rules it touches, and derives their findings and the verdicts of its runs from that; older
evidence is never read again. All tables are layers by batch: the layer of a batch is written as a whole and only read below a committed batch, so a batch
that is replayed starts from the same state and overwrites itself. A layer that counts ``COMPACT_EVERY`` others below it holds the whole state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from outfall.operators import correlate as C
from outfall.operators import match
from outfall.plans.scan import gate_new, rule_dimension
from outfall.rules.pack import RulePack
from outfall.sources.policies import Policy

PAIR = ["run_id", "rule_id"]
BUCKETS = 64
COMPACT_EVERY = 32
COMMITS = "batch_id bigint, base_batch bigint"
PLACE = "struct<path_in_tree: string, at: bigint, encoding: string, byte_offset: bigint, value_masked: string, entropy: double, context: string>"
GROUPS = f"run_id string, rule_id string, value_hash string, anchor {PLACE}, peak double, evidence_count bigint, wide int, batch_id bigint, bucket int"
FINDINGS = ("run_id string, rule_id string, value_hash string, id string, title string, category string, severity string, confidence double,"
            " value_masked string, entropy double, anchor_path string, anchor_offset bigint, batch_id bigint, bucket int")
EVIDENCE = ("run_id string, path_in_tree string, rule_id string, pattern_no int, value_hash string, value_masked string, byte_offset bigint,"
            " encoding string, entropy double, context string, batch_id bigint")


def bucket() -> Column:
    return F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


class Layers:
    """The layers of one stream below a batch."""

    def __init__(self, spark: SparkSession, base: str, below: int | None = None):
        self.spark, self.base = spark, base
        try:
            found = spark.read.schema(COMMITS).parquet(f"{base}/commits").where(F.lit(True) if below is None else F.col("batch_id") < below)
            last = found.agg(F.max(F.struct("batch_id", "base_batch"))["batch_id"].alias("batch_id"), F.max("base_batch").alias("base_batch")).first()
        except Exception as gone:  # nothing is committed yet
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            last = None
        self.last = None if last is None else last["batch_id"]
        self.first = 0 if self.last is None else last["base_batch"]

    def read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The newest layer of each (run, rule); ``buckets`` of runs only, if given."""
        if self.last is None:
            return self.spark.createDataFrame([], schema).drop("batch_id", "bucket")
        rows = self.spark.read.schema(schema).parquet(f"{self.base}/{table}").where(F.col("batch_id").between(self.first, self.last))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        newest = rows.groupBy(*PAIR).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, [*PAIR, "batch_id"], "left_semi").drop("batch_id", "bucket")


def _write(df: DataFrame, base: str, table: str, batch_id: int, schema: str) -> DataFrame:
    """The layer of a batch, whole; what an earlier try left of it goes."""
    folder = f"{base}/{table}/batch_id={batch_id}"
    df.select("*", bucket()).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder).drop("batch_id", "bucket")


def merge_batch(batch: DataFrame, batch_id: int, pack: RulePack, base: str, policies: list[Policy], today: Column, compact_every: int = COMPACT_EVERY) -> None:
    spark = batch.sparkSession
    before = Layers(spark, base, batch_id)
    rules = rule_dimension(pack, spark)
    folder = f"{base}/evidence/batch_id={batch_id}"
    match.scan(batch, pack, ["run_id", "path_in_tree"]).write.mode("overwrite").parquet(folder)
    evidence = spark.read.schema(EVIDENCE).parquet(folder)
    runs_folder = f"{base}/runs/batch_id={batch_id}"
    batch.select("run_id").distinct().write.mode("overwrite").parquet(runs_folder)
    runs = spark.read.schema("run_id string").parquet(runs_folder)
    whole = before.last is not None and batch_id - before.first >= compact_every
    touched = None if whole else [r["bucket"] for r in runs.select(bucket()).distinct().collect()]  # at most BUCKETS

    delta = C.evidence_groups(evidence)
    old = before.read("groups", GROUPS, touched)
    if not whole:
        old = old.join(delta.select(*PAIR).distinct(), PAIR, "left_semi")
    groups = _write(C.merge_groups(delta.unionByName(old)), base, "groups", batch_id, GROUPS)
    findings, ids = C.findings_of(groups, rules)
    at = groups.join(ids, C.GROUP).groupBy("run_id", "finding_id").agg(F.min("anchor")["byte_offset"].alias("anchor_offset"))
    placed = findings.join(at.withColumnRenamed("finding_id", "id"), ["run_id", "id"], "left")
    names = [c.split()[0] for c in FINDINGS.split(", ")][:-2]
    new = _write(placed.select(*names), base, "findings", batch_id, FINDINGS)

    # what the runs of this batch have now: their other rules as they were, the touched ones as just written
    kept = before.read("findings", FINDINGS, touched).join(runs, "run_id", "left_semi").join(groups.select(*PAIR).distinct(), PAIR, "left_anti")
    now = kept.unionByName(new.join(runs, "run_id", "left_semi"))
    places = now.select("run_id", F.col("id").alias("finding_id"), F.col("anchor_path").alias("path_in_tree"), F.col("anchor_offset").alias("byte_offset"))
    gate = gate_new(now, places, policies, today, runs.withColumn("status", F.lit("completed")))
    gate.verdicts.write.mode("overwrite").parquet(f"{base}/verdicts/batch_id={batch_id}")
    row = [(batch_id, batch_id if whole else before.first)]
    spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{base}/commits")


def scan_stream(artifacts: DataFrame, pack: RulePack, base: str, policies: list[Policy] | None = None, today: Column | None = None,
                compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Scan and gate a stream of (run_id, path_in_tree, content) into ``base``; late artifacts add to their runs."""
    rules, day = policies or [Policy()], F.current_date() if today is None else today

    def process(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, pack, base, rules, day, compact_every)

    return artifacts.writeStream.foreachBatch(process).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()


def read_evidence(spark: SparkSession, base: str) -> DataFrame:
    """Evidence of all committed batches."""
    rows = spark.read.schema(EVIDENCE).parquet(f"{base}/evidence")
    return rows.join(spark.read.schema(COMMITS).parquet(f"{base}/commits").select("batch_id").distinct(), "batch_id", "left_semi")


def read_findings(spark: SparkSession, base: str) -> DataFrame:
    return Layers(spark, base).read("findings", FINDINGS)


def read_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """The last committed verdict of each run and policy."""
    rows = spark.read.option("basePath", f"{base}/verdicts").parquet(f"{base}/verdicts/*")
    rows = rows.where(F.col("batch_id") <= Layers(spark, base).last)
    newest = rows.groupBy("run_id", "policy").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["run_id", "policy", "batch_id"], "left_semi").drop("batch_id")
