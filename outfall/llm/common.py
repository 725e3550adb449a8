"""Tables in the shared folder, connected components and small shared steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outfall.sources.sinks import scratch

#: Texts are worked on in pieces of about this many bytes, whatever the size of a batch.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later readers survive lost executors and see the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` once everything that reads them has been written."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession, path: str, most: int = 64 << 20) -> bytes:
    """A model or vocabulary file of bounded size, read through Spark so that any store works."""
    found = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content", "length").first()
    if found["length"] > most:
        raise ValueError(f"{path} holds {found['length']} bytes, more than {most}")
    return bytes(found["content"])


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into row ranges of about ``most`` text bytes; a longer text is a piece of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def changed(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node, for edges (a, b) of long ids: alternating large and small stars.

    Returns (node, label) for every node of an edge. Loops and repeated edges are harmless; no edges give no rows.
    Every round is written to the shared folder. Minima are stored before they are joined, so a node
    with very many links is only a large side of a join, which adaptive execution splits.
    """
    now = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = None
    while (mark := changed(now)) != before:
        before = mark
        if not mark[0]:
            break
        both = now.union(now.select("b", "a"))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m"), "low")
        large = stored(both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct(), "large")
        erase(now, low)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        joined = large.join(low, "a")
        now = stored(joined.where("b <> m").selectExpr("b AS a", "m AS b").union(low.selectExpr("a", "m AS b")).distinct(), "small")
        erase(large, low)
    return now.selectExpr("a AS node", "b AS label").union(now.selectExpr("b AS node", "b AS label").distinct())


def row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key from a row's content: fully repeated rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))
