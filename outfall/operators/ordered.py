"""Ordered computations that do not gather a hot key in one task.

A window over ``keys`` alone would put all rows of one artifact name or one
file into a single task.  Here rows are windowed inside (keys, bucket), each
bucket is reduced to one row, and only those rows are windowed over the keys.
``bucket`` must be monotone in the order, such as the month of a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outfall.operators.extract import ASCII_RUN, latin1
from outfall.session import cut

SALTS = 64


def previous_value(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column,
                   name: str, where: Column | None = None) -> DataFrame:
    """Add ``name``: ``value`` of the nearest earlier row (of those matching ``where``)."""
    boxed = F.struct(value.alias("v"))
    boxed = boxed if where is None else F.when(where, boxed)
    df = df.withColumns({"_bucket": bucket, "_box": boxed})
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_local", F.last("_box", ignorenulls=True).over(inside))
    tail = F.max(F.when(F.col("_box").isNotNull(), F.struct(*order, "_box")))["_box"]
    tails = df.groupBy(*keys, "_bucket").agg(tail.alias("_tail"))
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "_bucket", F.last("_tail", ignorenulls=True).over(across).alias("_carry"))
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.withColumn(name, F.coalesce("_local", "_carry")["v"]).drop("_bucket", "_box", "_local", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Add the inclusive running sum of each value, by ``order`` within ``keys``."""
    names = list(values)
    df = df.withColumns({"_bucket": bucket, **{f"_v_{n}": v for n, v in values.items()}})
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in names})
    totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names])
    joined = local.join(carried, [*keys, "_bucket"])
    joined = joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in names})
    return joined.drop("_bucket", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def ranged_bucket(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``range_bucket``: ranges of about equal size in the given order.

    Checkpointed, so that every later read sees the same ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("range_bucket", F.spark_partition_id()))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Groups are salted first, so the final task of a group sees at most
    ``SALTS * k`` rows, whatever ``k`` and the group are.
    """
    salted = W.partitionBy(*keys, "_salt").orderBy(*order)
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    df = spread.withColumn("_rank", F.row_number().over(salted)).where(F.col("_rank") <= k).drop("_rank", "_salt")
    final = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= k).drop("_rank")


def string_offsets(artifacts: DataFrame, keys: list[str], content: str = "content", chunk: int = 4096) -> DataFrame:
    """ASCII strings of very large files: the offset sums run over chunks of positions, not inside the row."""
    text = latin1(F.col(content))
    runs = F.regexp_extract_all(text, F.lit(ASCII_RUN), F.lit(0))
    gaps = F.transform(F.split(text, ASCII_RUN, -1), lambda g: F.length(g).cast("bigint"))
    found = F.zip_with(F.slice(gaps, F.lit(1), F.size(runs)), runs, lambda g, v: F.struct(v.alias("value"), g.alias("gap")))
    rows = artifacts.select(*keys, F.posexplode(found).alias("pos", "s")).select(*keys, "pos", "s.value", "s.gap")
    step = F.col("gap") + F.length("value")
    summed = running_sum(rows, keys, ["pos"], F.floor(F.col("pos") / chunk), {"end_offset": step})
    return summed.select(*keys, "value", (F.col("end_offset") - F.length("value")).alias("byte_offset"))
