"""Artifact sources: files, text columns and their registration."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outfall.functions.ship import by_value
from outfall.sources.ranges import _opened

MAX_ARTIFACT_BYTES = 2 * 1024**3
MIN_REFERENCE = 8
MIN_SCANNABLE = 8
#: Up to here Spark hands a file on as one value where only its digest is wanted; larger ones are read block by block.
WHOLE_BYTES = 32 << 20
BLOCK = 4 << 20


def _streamable(path: str) -> bool:
    """Whether Arrow can open what is at ``path``; the other stores are read by Spark alone."""
    try:
        store, inner = _opened(path)
        return store.get_file_info(inner).type.name in ("File", "Directory")
    except Exception:  # noqa: BLE001  no such file system here, or not built into Arrow
        return False


def _digest(base: str, most: int | None):
    """A function from a name below ``base`` to the digest of the file's first ``most`` bytes, or of all."""

    def digest(name: str) -> str:
        store, inner = _opened(base)
        found, left = hashlib.sha256(), most
        with store.open_input_file(f"{inner.rstrip('/')}/{name}" if name else inner) as file:
            while block := file.read(BLOCK if left is None else min(BLOCK, left)):
                found.update(block)
                left = left if left is None else left - len(block)
        return found.hexdigest()

    return digest


def artifact_files(spark: SparkSession, path: str, max_bytes: int | None = None, digest: bool = False) -> DataFrame:
    """Every file under ``path`` as one row, whole; the listing and reading are Spark's, which fail on a file of 2 GiB or more.

    With ``max_bytes`` larger files are cut and flagged. With ``digest`` rows have ``sha256`` in place of ``content``, and files are of any
    size: one task reads each larger one block by block, with Arrow's file systems. In a store that Arrow cannot open Spark reads all files whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    full = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    cut = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    content = F.col("content") if max_bytes is None else F.when(cut, F.substring("content", 1, max_bytes)).otherwise(F.col("content"))
    named = [
        F.regexp_replace(F.replace(full, F.lit(base), F.lit("")), "^/+", "").alias("path_in_tree"),
        F.col("length").alias("size_bytes"),
        cut.alias("truncated"),
    ]
    if not digest:
        return files.select(*named, content.alias("content"))
    hashed = F.sha2(content, 256).alias("sha256")
    where = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    if not _streamable(where):
        return files.select(*named, hashed)
    # the reader skips files by their length before it opens them
    small = files.where(F.col("length") <= WHOLE_BYTES).select(*named, hashed)
    large = files.where(F.col("length") > WHOLE_BYTES).select(*named)
    return small.unionByName(large.withColumn("sha256", F.udf(_digest(where, max_bytes), "string", useArrow=False)("path_in_tree")))


def artifact_text(df: DataFrame, key: Column, text: str, *keep: str) -> DataFrame:
    """A text column as artifact bytes."""
    content = F.encode(F.col(text), "UTF-8")
    return df.select(
        *keep, key.alias("path_in_tree"), F.octet_length(text).cast("bigint").alias("size_bytes"), content.alias("content")
    )


def scannable(artifacts: DataFrame) -> DataFrame:
    """Files large enough to hold a string."""
    return artifacts.where(F.col("size_bytes") >= MIN_SCANNABLE)


def artifact_key(sha256: Column, name: Column) -> Column:
    safe = F.substring(F.regexp_replace(name, "[^0-9A-Za-z._-]", "_"), 1, 120)
    return F.concat(F.lit("artifacts/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit("/"), safe)


def ingest_register(uploads: DataFrame) -> DataFrame:
    """Hash, size, content address, attestation check and duplicate flag of uploads.

    ``uploads``: upload_id, name, content, attested_by, attestation_reference.
    A digest is counted by partial aggregation and joined back, so a file that
    is uploaded very often does not gather in one task.
    """
    hashed = uploads.select(
        "upload_id", "name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.trim(F.coalesce("attested_by", F.lit(""))).alias("attested_by"),
        F.trim(F.coalesce("attestation_reference", F.lit(""))).alias("reference"),
    )
    first = hashed.groupBy("sha256").agg(F.min("upload_id").alias("first_upload"))
    error = (
        F.when(F.col("attested_by") == "", "an attesting identity is required")
        .when(F.length("reference") < MIN_REFERENCE, "an authorization reference is required")
        .when(F.col("size_bytes") > MAX_ARTIFACT_BYTES, "artifact exceeds the size limit")
    )
    return hashed.join(first, "sha256").select(
        "upload_id", "name", "sha256", "size_bytes", artifact_key(F.col("sha256"), F.col("name")).alias("storage_key"),
        (F.col("upload_id") != F.col("first_upload")).alias("deduplicated"), error.alias("error"),
    )


by_value(__name__)
