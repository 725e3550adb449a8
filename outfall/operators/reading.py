"""Listings, searches, trees and reports over stored findings and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators.ordered import top_k
from outfall.operators.runs import SEVERITIES

# Fixed values
MAX_LISTED = 2000
MAX_TREE_NODES = 500
MAX_PLAINTEXTS = 500
MAX_FILES_LISTED = 60
MAX_SEARCH_HITS = 40
MAX_SUMMARY_FINDINGS = 40
RETAIN_MAX_BYTES = 32 * 1024 * 1024
SEPARATOR = " → "


def list_findings(findings: DataFrame, severity: list[str] | None = None, status: list[str] | None = None,
                  category: list[str] | None = None, detected_by: str | None = None, new_only: bool = False,
                  limit: int = 500) -> DataFrame:
    """Filter, then order, then limit, for each run."""
    if not 0 < limit <= MAX_LISTED:
        raise ValueError(f"limit must be 1 to {MAX_LISTED}")
    rows = findings
    for column, allowed in (("severity", severity), ("status", status), ("category", category)):
        if allowed:
            rows = rows.where(F.col(column).isin(allowed))
    if detected_by:
        rows = rows.where(F.col("detected_by") == detected_by)
    if new_only:
        rows = rows.where("is_new")
    return top_k(rows, ["run_id"], [T.severity_rank(F.col("severity")), "rule_id", "id"], limit)


def search_findings(findings: DataFrame, locations: DataFrame, needle: str, new_only: bool = False,
                    hide_dismissed: bool = False) -> DataFrame:
    """Findings whose texts or any of whose places contain the needle, ignoring case."""
    text = needle.strip().lower()
    rows = findings
    if new_only:
        rows = rows.where("is_new")
    if hide_dismissed:
        rows = rows.where("status <> 'false_positive'")
    if not text:
        return rows
    placed = locations.where(F.contains(F.lower("path_in_tree"), F.lit(text))).select("run_id", F.col("finding_id").alias("id")).distinct()
    fields = [c for c in ("title", "rule_id", "category", "value_masked") if c in rows.columns]
    own = F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text))
    marked = rows.join(placed.withColumn("_placed", F.lit(True)), ["run_id", "id"], "left")
    return marked.where(own | F.col("_placed")).drop("_placed")


def plaintexts(locations: DataFrame, evidence: DataFrame, limit: int = MAX_PLAINTEXTS) -> DataFrame:
    """Real values behind a finding, through its places, so that clusters resolve too.

    The first ``limit`` distinct values in order; only these are gathered.
    """
    pairs = locations.select("run_id", "finding_id", "path_in_tree", "byte_offset").join(
        evidence.where("value_plaintext IS NOT NULL").select("run_id", "path_in_tree", "byte_offset", "value_plaintext"),
        ["run_id", "path_in_tree", "byte_offset"])
    distinct = pairs.select("run_id", "finding_id", "value_plaintext").distinct()
    kept = top_k(distinct, ["run_id", "finding_id"], ["value_plaintext"], limit)
    return kept.groupBy("run_id", "finding_id").agg(F.array_sort(F.collect_list("value_plaintext")).alias("values"))


def artifact_counts(locations: DataFrame) -> DataFrame:
    return locations.groupBy("run_id", "path_in_tree").agg(F.count("*").alias("finding_count"))


def ancestors(path: Column) -> Column:
    """The path itself and every container above it."""
    parts = F.split(path, SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEPARATOR))


def subtree_counts(locations: DataFrame) -> DataFrame:
    """Findings at or below every node; each place counts once for each of its containers."""
    counted = artifact_counts(locations)
    exploded = counted.select("run_id", F.explode(ancestors(F.col("path_in_tree"))).alias("path_in_tree"), "finding_count")
    return exploded.groupBy("run_id", "path_in_tree").agg(F.sum("finding_count").alias("subtree_count"))


def bounded_tree(artifacts: DataFrame, counts: DataFrame, limit: int = MAX_TREE_NODES) -> DataFrame:
    """Top of each run's tree by depth and path; a node without its parent is left out.

    ``artifacts``: run_id, path_in_tree, parent_path_in_tree (null or the run's root at the top), depth.
    """
    rank = W.partitionBy("run_id").orderBy("depth", "path_in_tree")
    ranked = artifacts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit + 1)
    cut = ranked.groupBy("run_id").agg((F.max("rank") > limit).alias("truncated"))
    shown = ranked.where(F.col("rank") <= limit)
    parents = shown.select("run_id", F.col("path_in_tree").alias("parent_path_in_tree"))
    top = shown.where("depth = 1 OR parent_path_in_tree IS NULL")
    below = shown.where("depth > 1 AND parent_path_in_tree IS NOT NULL").join(parents, ["run_id", "parent_path_in_tree"], "left_semi").select(*shown.columns)
    nodes = top.unionByName(below).join(cut, "run_id").join(counts, ["run_id", "path_in_tree"], "left")
    return nodes.drop("rank").na.fill(0, ["finding_count"])


def file_listing(artifacts: DataFrame, limit: int = MAX_FILES_LISTED) -> DataFrame:
    """First files of each run by path and how many more there are."""
    total = artifacts.groupBy("run_id").agg(F.count("*").alias("files"))
    first = top_k(artifacts, ["run_id"], ["path_in_tree"], limit)
    return first.join(total, "run_id").withColumn("more", F.greatest(F.col("files") - limit, F.lit(0)))


def search_evidence(evidence: DataFrame, pattern: str, path: str | None = None, limit: int = MAX_SEARCH_HITS) -> DataFrame:
    """Evidence of each run whose masked value matches; plaintext is never searched."""
    rows = evidence if path is None else evidence.where(F.col("path_in_tree") == path)
    return top_k(rows.where(F.col("value_masked").rlike(pattern)), ["run_id"], ["path_in_tree", "byte_offset", "rule_id"], limit)


def retained(artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Artifacts worth keeping: they have evidence, are small enough and not stored yet."""
    small = artifacts.where((F.col("size_bytes") <= RETAIN_MAX_BYTES) & F.col("storage_key").isNull())
    return small.join(evidence, ["run_id", "path_in_tree"], "left_semi")


def apply_identification(artifacts: DataFrame, identified: DataFrame) -> DataFrame:
    new = identified.select("run_id", "path_in_tree", F.col("kind").alias("_kind"), F.col("media_type").alias("_media"))
    joined = artifacts.join(new, ["run_id", "path_in_tree"], "left")
    return joined.withColumns({"kind": F.coalesce("_kind", "kind"), "media_type": F.coalesce("_media", "media_type")}).drop("_kind", "_media")


def summary_context(findings: DataFrame, limit: int = MAX_SUMMARY_FINDINGS) -> DataFrame:
    """Tally and the most severe findings of each run as text; at most ``limit`` lines are gathered."""
    severity = F.col("severity")
    tally = findings.groupBy("run_id").agg(
        F.count("*").alias("total"), *[F.count(F.when(severity == s, 1)).alias(s) for s in SEVERITIES])
    pieces = F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES]))
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "title", F.lit(" ("), "rule_id", F.lit(") = "), "value_masked")
    rank = T.severity_rank(severity)
    top = top_k(findings.select("run_id", rank.alias("rank"), "rule_id", "id", line.alias("line")), ["run_id"], ["rank", "rule_id", "id"], limit)
    lines = top.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "id", "line"))).alias("l"))
    more = F.when(F.col("total") > limit, F.concat(F.lit("\n- ... and "), (F.col("total") - limit).cast("string"), F.lit(" more, already counted above")))
    body = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.coalesce(more, F.lit("")))
    return tally.join(lines, "run_id").select("run_id", "total", F.array_join(pieces, ", ").alias("tally"), body.alias("lines"))


def field_report(evidence: DataFrame, findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per run: files, bytes, matches, findings by severity."""
    files = artifacts.groupBy("run_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    matches = evidence.groupBy("run_id").agg(F.count("*").alias("matches"))
    counts = findings.groupBy("run_id").agg(F.count("*").alias("findings"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])
    return files.join(matches, "run_id", "left").join(counts, "run_id", "left").na.fill(0)


def rule_spread(evidence: DataFrame) -> DataFrame:
    """Per rule: hits and in how many artifacts."""
    return evidence.groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("run_id").alias("artifacts"))


def stage_status(results: DataFrame) -> DataFrame:
    """Outcome and exit code to stage status; a truncated unpack says so, with its reasons."""
    by_outcome = (
        F.when((F.col("outcome") == "completed") & (F.col("exit_code") == 0), "completed")
        .when(F.col("outcome") == "timeout", "timeout").when(F.col("outcome") == "oom", "oom").otherwise("failed")
    )
    return results.withColumns({
        "status": F.when(F.col("truncated"), "truncated").otherwise(by_outcome),
        "error": F.when(F.col("truncated"), F.concat_ws("; ", "reasons")),
        "duration_s": F.round("duration_s", 3)})
