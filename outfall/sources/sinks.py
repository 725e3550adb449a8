"""Result tables of a scan in versions: all tables of a version appear together, or none of them.

``base/<table>/version=<v>/run_id=<r>`` holds rows, ``base/_runs`` the runs of each version, ``base/_manifest`` rows and fingerprints by run and table.
A version counts from the moment its one row is in ``base/_commits``, which is the last thing written; readers take, for each run, the last such version.
So a write that fails leaves what was there, nothing is removed before its successor is complete, and a reader sees one state or the other.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfall.session import ensure_checkpoint_dir

RUNS = "run_id string, version string"
COMMITS = "version string, runs bigint, tables array<string>"
MANIFEST = "run_id string, table string, rows bigint, fingerprint string, version string"


class RunWriter:
    """One version of the result tables of ``runs`` (run_id); unseen before :meth:`commit`."""

    def __init__(self, spark: SparkSession, base: str, runs: DataFrame):
        self.spark, self.base = spark, base
        self.version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, DataFrame] = {}
        # written once: what names the runs may be as large as the files themselves
        folder = f"{base}/_runs/version={self.version}"
        runs.select(runs["run_id"].cast("string").alias("run_id")).distinct().write.parquet(folder)
        self.runs = spark.read.schema("run_id string").parquet(folder)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table of this version; returns it as written."""
        folder = f"{self.base}/{name}/version={self.version}"
        df.write.partitionBy("run_id").parquet(folder)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(folder).select(*df.columns)
        return self.tables[name]

    def manifest(self) -> DataFrame:
        """Rows and a fingerprint, whatever the order of rows, for every run and table; runs without rows too."""
        def of(name: str, df: DataFrame) -> DataFrame:
            mark = F.sum(F.xxhash64(*[c for c in df.columns if c != "run_id"]).cast("decimal(20,0)"))
            found = df.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("rows"), F.sha2(mark.cast("string"), 256).alias("fingerprint"))
            return self.runs.join(found, "run_id", "left").select("run_id", F.lit(name).alias("table"), F.coalesce("rows", F.lit(0)).alias("rows"), "fingerprint")

        return reduce(DataFrame.unionByName, [of(*item) for item in self.tables.items()])

    def commit(self) -> None:
        self.manifest().write.parquet(f"{self.base}/_manifest/version={self.version}")
        row = [(self.version, self.runs.count(), sorted(self.tables))]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.base}/_commits")


def write_run(base: str, runs: DataFrame | None = None, **tables: DataFrame) -> None:
    """Write tables of ``runs`` (run_id), or of the runs they have, as one version; a rerun is idempotent, also for runs that have no rows now."""
    if runs is None:
        runs = reduce(DataFrame.union, [df.select("run_id") for df in tables.values()])
    writer = RunWriter(runs.sparkSession, base, runs)
    for name, df in tables.items():
        writer.table(name, df)
    writer.commit()


def current_runs(spark: SparkSession, base: str, name: str | None = None) -> DataFrame:
    """run_id, version: the last complete version of each run, of those that have table ``name``."""
    commits = spark.read.schema(COMMITS).parquet(f"{base}/_commits")
    commits = commits if name is None else commits.where(F.array_contains("tables", F.lit(name)))
    seen = spark.read.schema(RUNS).parquet(f"{base}/_runs").join(commits.select("version").distinct(), "version", "left_semi")
    return seen.groupBy("run_id").agg(F.max("version").alias("version"))


def read_run(spark: SparkSession, base: str, name: str, like: DataFrame) -> DataFrame:
    """A table of all runs, with the types of ``like``: run ids stay text."""
    rows = spark.read.schema(like.schema.add("version", "string") if "version" not in like.columns else like.schema).parquet(f"{base}/{name}")
    return rows.join(current_runs(spark, base, name), ["run_id", "version"], "left_semi").select(*like.columns)


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """run_id, table, rows, fingerprint, version of what readers see."""
    rows = spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")
    tables = [r["name"] for r in spark.read.schema(COMMITS).parquet(f"{base}/_commits").select(F.explode("tables").alias("name")).distinct().collect()]
    return reduce(DataFrame.unionByName, [rows.where(F.col("table") == t).join(current_runs(spark, base, t), ["run_id", "version"], "left_semi") for t in sorted(tables)])


def vacuum(spark: SparkSession, base: str) -> list[str]:
    """Remove the tables of committed versions that are no run's last one, for when no reader is still on them; returns those versions."""
    commits = spark.read.schema(COMMITS).parquet(f"{base}/_commits").select("version", F.explode("tables").alias("name")).collect()
    used = {(name, r["version"]) for name in {c["name"] for c in commits} for r in current_runs(spark, base, name).select("version").distinct().collect()}
    gone = [(c["name"], c["version"]) for c in commits if (c["name"], c["version"]) not in used]
    for name, version in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/version={version}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted({v for _, v in gone})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
