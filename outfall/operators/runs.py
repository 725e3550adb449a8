"""Run history: predecessors, differences, summaries, posture and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from outfall.functions import text as T
from outfall.operators.ordered import previous_value

# Fixed values
SEVERITIES = ["critical", "high", "medium", "low", "info"]
DEGRADED = ["timeout", "oom", "failed", "truncated"]
TERMINAL = ["completed", "degraded", "failed", "cancelled"]


def month(ts: str) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def previous_runs(runs: DataFrame) -> DataFrame:
    """``previous_run_id``: the latest completed earlier run of the same artifact name."""
    return previous_value(runs, ["name"], ["created_at", "run_id"], month("created_at"), F.col("run_id"),
                          "previous_run_id", where=F.col("status") == "completed")


def expected_duration(runs: DataFrame) -> DataFrame:
    """How long the same bytes took in the latest other completed run.

    Two candidates per digest are enough: the latest, and the next for that run itself.
    """
    done = runs.where("status = 'completed' AND started_at IS NOT NULL AND finished_at IS NOT NULL").select(
        "root_sha256", "run_id", "finished_at",
        F.expr("CAST(timestampdiff(SECOND, started_at, finished_at) AS DOUBLE)").alias("seconds"))
    latest = W.partitionBy("root_sha256").orderBy(F.desc("finished_at"), F.desc("run_id"))
    two = done.withColumn("rank", F.row_number().over(latest)).where("rank <= 2")
    best = two.groupBy("root_sha256").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("run_id", "seconds"))).alias("one"),
        F.max(F.when(F.col("rank") == 2, F.struct("run_id", "seconds"))).alias("two"))
    pick = F.when(F.col("one.run_id") == F.col("run_id"), F.col("two.seconds")).otherwise(F.col("one.seconds"))
    return runs.join(best, "root_sha256", "left").withColumn("expected_s", pick).drop("one", "two")


def resolve_baselines(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Supplied ids win over an explicit run, which wins over the recorded predecessor.

    ``requests``: run_id, has_supplied_ids, baseline_run_id, previous_run_id.
    A run that does not exist or did not complete is no baseline.
    """
    wanted = requests.withColumn("candidate", F.coalesce("baseline_run_id", "previous_run_id"))
    done = runs.where("status = 'completed'").select(F.col("run_id").alias("candidate"), F.lit(True).alias("usable"))
    source = (
        F.when(F.col("has_supplied_ids"), "supplied_ids")
        .when(F.col("usable").isNull(), "none")
        .when(F.col("baseline_run_id").isNotNull(), "explicit_run")
        .otherwise("previous_run")
    )
    found = wanted.join(done, "candidate", "left").withColumn("source", source)
    return found.withColumn("baseline_id", F.when(F.col("source").isin("explicit_run", "previous_run"), F.col("candidate"))).drop(
        "usable", "candidate")


def _texts(findings: DataFrame) -> list[str]:
    return [f.name for f in findings.schema if isinstance(f.dataType, StringType) and f.name not in ("run_id", "id")]


def packed(findings: DataFrame, keyed: bool = False) -> DataFrame:
    """run_id, all other texts as one value ``_row``, and what is not a text.

    Readers of the same findings that take other columns need the same exchange by run, so it is written once. The texts of a rule lie side by
    side, where a shuffle's compression finds them as one piece. ``keyed``: the id is not in ``_row`` but a column ``_id`` to join by.
    """
    texts = _texts(findings)
    key = T.compact(F.col("id"))
    row = F.array(F.lit(b"") if keyed else key, *[F.col(c).cast("binary") for c in texts])
    return findings.select("run_id", *[key.alias("_id")] * keyed, row.alias("_row"), *[c for c in findings.columns if c not in ("run_id", "id", *texts)])


def columns_of(rows: DataFrame, findings: DataFrame) -> dict[str, Column]:
    """The columns of ``findings`` in what :func:`packed` made of them."""
    key = F.col("_id") if "_id" in rows.columns else F.col("_row")[0]
    at = {c: F.col("_row")[i + 1].cast("string") for i, c in enumerate(_texts(findings))} | {"id": T.expanded(key)}
    return {c: at[c].alias(c) if c in at else F.col(c) for c in findings.columns}


def unpacked(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """What :func:`packed` made of ``findings``, as columns again, with those that were added since."""
    added = [c for c in rows.columns if c not in ("_row", "_id", *findings.columns)]
    return rows.select(*columns_of(rows, findings).values(), *added)


def baseline_ids(links: DataFrame, findings: DataFrame, once: bool = True) -> DataFrame:
    """(run_id, id) of the findings each run is measured against; ``links``: run_id, baseline_id.

    Without ``once`` pairs may repeat, and the findings are read through the exchange that :func:`packed` makes.
    """
    wanted = links.where("baseline_id IS NOT NULL").select("run_id", "baseline_id")
    if not once:
        wanted = wanted.select(F.col("run_id").alias("_of"), F.col("baseline_id").alias("run_id"))
        return wanted.join(packed(findings), "run_id").select(F.col("_of").alias("run_id"), T.expanded(F.col("_row")[0]).alias("id"))
    old = findings.select(F.col("run_id").alias("baseline_id"), "id")
    return wanted.join(old, "baseline_id").select("run_id", "id").distinct()


def with_is_new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    marked = findings.join(baseline.withColumn("_old", F.lit(True)), ["run_id", "id"], "left")
    return marked.withColumn("is_new", F.col("_old").isNull()).drop("_old")


def run_diff(findings: DataFrame, links: DataFrame) -> DataFrame:
    """Per run with a predecessor: each finding id as new, inherited or fixed."""
    linked = links.where("baseline_id IS NOT NULL").select("run_id", "baseline_id")
    current = findings.select("run_id", "id").distinct().join(linked.select("run_id"), "run_id", "left_semi")
    before = baseline_ids(linked, findings)
    both = current.withColumn("now", F.lit(True)).join(before.withColumn("old", F.lit(True)), ["run_id", "id"], "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "fixed").otherwise("inherited")
    return both.select("run_id", "id", change.alias("change"))


def severity_counts(findings: DataFrame, **parts: Column) -> DataFrame:
    """One row per run with a count per severity; each of ``parts``, a condition, adds counts of its own in the same pass, named ``<part>_<severity>``."""
    def counts(prefix: str, hit: Column) -> list[Column]:
        return [F.count(F.when((F.col("severity") == s) & hit, 1)).alias(prefix + s) for s in SEVERITIES]

    return findings.groupBy("run_id").agg(*counts("", F.lit(True)), *[c for name, hit in parts.items() for c in counts(f"{name}_", hit)])


def category_rollup(findings: DataFrame) -> DataFrame:
    worst = F.min(T.severity_rank(F.col("severity")))
    return findings.groupBy("run_id", "category").agg(F.count("*").alias("findings"), T.severity_name(worst).alias("worst"))


def degraded_stages(stages: DataFrame) -> DataFrame:
    """``stages``: the sorted ``analyzer (status)`` names of each run that was not fully examined."""
    bad = stages.where(F.col("status").isin(DEGRADED)).select("run_id", F.concat("analyzer", F.lit(" ("), "status", F.lit(")")).alias("stage"))
    return bad.groupBy("run_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def run_status(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """A finished scan with degraded stages is degraded, and says which."""
    joined = runs.select("run_id").join(degraded_stages(stages), "run_id", "left")
    return joined.select(
        "run_id", F.when(F.col("stages").isNull(), "completed").otherwise("degraded").alias("status"),
        F.concat_ws("; ", "stages").alias("error"))


def latest_per_artifact(runs: DataFrame) -> DataFrame:
    key = F.coalesce("name", "run_id").alias("artifact")
    row = F.struct("created_at", "run_id")
    return runs.groupBy(key).agg(F.max(row)["run_id"].alias("run_id"))


def run_totals(runs: DataFrame, findings: DataFrame) -> DataFrame:
    counts = severity_counts(findings)
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    joined = runs.join(counts, "run_id", "left").na.fill(0, SEVERITIES)
    return joined.withColumn("total", total)


def run_summary(runs: DataFrame, findings: DataFrame, artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """One row per run: counts by severity, files, findings new since the predecessor."""
    files = artifacts.groupBy("run_id").agg(F.count("*").alias("artifact_count"))
    new = run_diff(findings, links).groupBy("run_id").agg(F.count(F.when(F.col("change") == "new", 1)).alias("new_count"))
    linked = links.where("baseline_id IS NOT NULL").select("run_id", F.lit(0).cast("bigint").alias("zero"))
    joined = run_totals(runs, findings).join(files, "run_id", "left").join(linked, "run_id", "left").join(new, "run_id", "left")
    return joined.select(
        "run_id", "name", "status", F.col("total").alias("finding_count"), *SEVERITIES,
        F.coalesce("artifact_count", F.lit(1).cast("bigint")).alias("artifact_count"),
        F.coalesce("new_count", "zero").alias("new_since_previous"))


def fleet_posture(summary: DataFrame) -> DataFrame:
    """One row over all artifacts: only the latest completed run of each counts.

    ``summary``: run_summary plus created_at.  Failed and degraded runs are told apart.
    """
    done = F.col("status") == "completed"
    latest = latest_per_artifact(summary.where(done)).select("run_id", F.lit(True).alias("_current"))
    marked = summary.join(latest, "run_id", "left").withColumn("_current", F.coalesce("_current", F.lit(False)))

    def total(value: Column, when: Column = F.col("_current")) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

    return marked.agg(
        F.count(F.when(F.col("_current"), 1)).alias("artifacts"), *[total(F.col(s)).alias(s) for s in SEVERITIES],
        total(F.col("critical") + F.col("high")).alias("blocking"), total(F.col("artifact_count")).alias("files_analysed"),
        total(F.col("new_since_previous"), done).alias("introduced"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed_runs"),
        F.count(F.when(F.col("status") == "degraded", 1)).alias("degraded_runs"))


def severity_trend(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts per completed run, with the largest total as the common scale."""
    totals = run_totals(runs.where("status = 'completed'"), findings)
    ceiling = totals.select(F.greatest(F.max("total"), F.lit(1))).scalar()
    return totals.select("run_id", "created_at", *SEVERITIES, "total", ceiling.alias("ceiling"))


def run_over_run(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Total of each run next to the run before it of the same artifact."""
    totals = run_totals(runs, findings)
    linked = previous_value(totals, ["name"], ["created_at", "run_id"], month("created_at"), F.col("total"), "previous_total")
    return linked.withColumn("rising", F.coalesce(F.col("total") > F.col("previous_total"), F.lit(False)))


def first_seen(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """The earliest run of the same artifact name that carries the finding."""
    named = findings.select("run_id", "id").join(runs.select("run_id", "name", "created_at"), "run_id")
    first = named.groupBy("name", "id").agg(F.min(F.struct("created_at", "run_id"))["run_id"].alias("first_seen_run_id"))
    return named.join(first, ["name", "id"]).select("run_id", "id", "first_seen_run_id")


def reproducible(findings: DataFrame, manifests: DataFrame) -> DataFrame:
    """Runs that share a fingerprint must share their findings.

    Per fingerprint: runs, distinct ids, and ids that some of the runs lack.
    """
    labelled = findings.select("run_id", "id").distinct().join(manifests.select("run_id", "fingerprint"), "run_id")
    per_id = labelled.groupBy("fingerprint", "id").agg(F.count("*").alias("seen"))
    runs = manifests.groupBy("fingerprint").agg(F.count("*").alias("runs"))
    joined = per_id.join(runs, "fingerprint")
    return joined.groupBy("fingerprint", "runs").agg(
        F.count("*").alias("ids"), F.count(F.when(F.col("seen") < F.col("runs"), 1)).alias("unstable_ids"))
