"""Lost runs: which to requeue, which to fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
QUEUED_GRACE_S = 300
RUNNING_TIMEOUT_S = 3600
MAX_ATTEMPTS = 2


def requeue_attempts(audit: DataFrame) -> DataFrame:
    return audit.where("action = 'run_requeued'").groupBy("run_id").agg(F.count("*").alias("attempts"))


def orphan_sweep(runs: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Overdue runs with the action to take.

    ``runs``: run_id, status, created_at, started_at.  A queued run is requeued
    until it had its attempts, then failed; any run past every stage timeout fails.
    """
    open_runs = runs.where("status IN ('queued', 'running')").join(attempts, "run_id", "left").na.fill(0, ["attempts"])
    age = F.timestamp_diff("SECOND", F.coalesce("started_at", "created_at"), now)
    waiting = (F.col("status") == "queued") & F.col("started_at").isNull()
    tired = F.col("attempts") >= MAX_ATTEMPTS
    action = (
        F.when(waiting & (F.col("age_s") >= QUEUED_GRACE_S) & ~tired, "requeue")
        .when(waiting & (F.col("age_s") >= QUEUED_GRACE_S), "fail")
        .when(~waiting & (F.col("age_s") >= RUNNING_TIMEOUT_S), "fail")
    )
    reason = (
        F.when(waiting & tired, F.concat(F.lit("orphaned in the queue: no worker claimed it after "), F.col("attempts").cast("string"), F.lit(" requeue attempts")))
        .when(waiting, F.lit("queued past the grace period with no worker"))
        .otherwise(F.concat(F.lit("orphaned mid-analysis: no progress for "), F.col("age_s").cast("string"), F.lit("s, past every stage timeout")))
    )
    aged = open_runs.withColumn("age_s", age)
    return aged.withColumns({"action": action, "reason": reason}).where("action IS NOT NULL").select("run_id", "action", "age_s", "attempts", "reason")
