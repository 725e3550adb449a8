"""Rules of unpacking: member paths, budgets, the artifact tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.operators.ordered import ranged_bucket, running_sum

# Fixed values
MAX_DEPTH = 8
MIN_FILES, FILES_PER_MB, MAX_FILES = 20_000, 600, 250_000
EXPANSION, MIN_BYTES, MAX_BYTES = 20, 64 * 1024 * 1024, 10 * 1024**3


def safe_member(member: Column) -> Column:
    """The member's path inside its archive, or null when it would escape."""
    slashed = F.replace(member, F.lit("\\"), F.lit("/"))
    relative = F.regexp_replace(F.regexp_replace(slashed, "^[A-Za-z]:", ""), "^/+", "")
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("stack"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        depth = F.size(state["stack"])
        stack = (
            F.when(part.isin("", "."), state["stack"])
            .when(up, F.slice(state["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .otherwise(F.array_append(state["stack"], part))
        )
        return F.struct((state["ok"] & ~(up & (depth == 0))).alias("ok"), stack.alias("stack"))

    walked = F.aggregate(F.split(relative, "/"), start, step)
    return F.when(walked["ok"] & (F.size(walked["stack"]) > 0), F.array_join(walked["stack"], "/"))


def budget_for(input_size: Column) -> dict[str, Column]:
    """Byte and file caps scaled to the size of the root."""
    mb = F.greatest(F.floor(input_size / (1024 * 1024)), F.lit(1))
    return {
        "max_bytes": F.least(F.greatest(input_size * EXPANSION, F.lit(MIN_BYTES)), F.lit(MAX_BYTES)),
        "max_files": F.greatest(F.lit(MIN_FILES), F.least(mb * FILES_PER_MB, F.lit(MAX_FILES))),
    }


def extraction_budget(members: DataFrame, caps: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Running totals per root in (depth, path) order and whether each member still fits.

    ``members``: root, path_in_tree, depth, size_bytes; ``caps``: root, max_bytes, max_files.
    The sums run inside ranges of rows and carry over, so one huge root is not one task.
    """
    order = ["depth", "path_in_tree"]
    ranged = ranged_bucket(members, ["root", *order])
    sums = running_sum(ranged, ["root"], order, F.col("range_bucket"), {"files_so_far": F.lit(1), "bytes_so_far": F.col("size_bytes")})
    capped = sums.drop("range_bucket").join(caps, "root")
    reason = (
        F.when(F.col("depth") > max_depth, F.concat(F.lit("depth "), F.col("depth").cast("string"), F.lit(f" exceeds max_depth {max_depth}")))
        .when(F.col("files_so_far") > F.col("max_files"), F.concat(F.lit("file count would exceed max_files "), F.col("max_files").cast("string")))
        .when(F.col("bytes_so_far") > F.col("max_bytes"), F.concat(F.lit("writing would exceed max_total_bytes "), F.col("max_bytes").cast("string")))
    )
    return capped.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def budget_summary(budgeted: DataFrame) -> DataFrame:
    """Per root: what was kept and why the rest was not.  Reasons are a handful of texts."""
    kept = F.col("kept")
    return budgeted.groupBy("root").agg(
        F.count(F.when(kept, 1)).alias("files"), F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
        (~F.min("kept")).alias("truncated"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))


def artifact_id(run_id: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", run_id, path), 256), 1, 32)


def artifact_tree(nodes: DataFrame) -> DataFrame:
    """Nodes with ids and parent ids; a node whose parent is unknown hangs on the root.

    ``nodes``: run_id, root, path_in_tree, parent_path_in_tree, depth, size_bytes.
    """
    known = nodes.select("run_id", F.col("path_in_tree").alias("parent_path_in_tree"), F.lit(True).alias("known")).distinct()
    joined = nodes.join(known, ["run_id", "parent_path_in_tree"], "left")
    parent = F.when(F.col("known"), F.col("parent_path_in_tree")).otherwise(F.col("root"))
    name = F.regexp_extract("path_in_tree", r"([^/→]+)$", 1)
    return joined.select(
        "run_id", artifact_id(F.col("run_id"), F.col("path_in_tree")).alias("id"), artifact_id(F.col("run_id"), parent).alias("parent_id"),
        F.trim(name).alias("name"), "path_in_tree", "depth", "size_bytes")
