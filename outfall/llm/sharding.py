"""Sharding by histogram sort (operator 10): DataFrame functions only.

Keys are refined from counts: bytes below candidate key boundaries are counted exactly across all partitions, the
boundaries near a target are kept when they meet the tolerance and probed more finely when they don't. Only the counts
of the probed boundaries reach the driver: at most 256 for each open splitter and round. Then rows move once.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outfall.llm.common import stored

KEY_DIGITS = 48
#: Greater than every key.
LAST = "G"


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def splitters(keyed: DataFrame, parts: int, total: int, tolerance: float) -> list[str]:
    """parts - 1 ascending key boundaries; each has as many bytes below it as its share, up to the tolerance in bytes."""
    found: dict[int, str] = {}
    open_cells: dict[str, tuple[int, list[int]]] = {"": (0, list(range(1, parts)))}
    digits = 0
    while open_cells:
        rows = keyed if not digits else keyed.where(F.substring("__hs_key", 1, digits).isin(list(open_cells)))
        counts: dict[str, list[tuple[str, int, int]]] = {cell: [] for cell in open_cells}
        probed = rows.groupBy(F.substring("__hs_key", 1, digits + 2).alias("cell")).agg(F.sum("__hs_size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        for row in probed.collect():
            counts[row["cell"][:digits]].append((row["cell"], row["bytes"], row["n"]))
        digits += 2
        after: dict[str, tuple[int, list[int]]] = {}
        for cell, (below, targets) in open_cells.items():
            children = sorted(counts[cell])
            at = [below]
            for _, size, _ in children:
                at.append(at[-1] + size)
            for i in targets:
                want = total * i / parts
                child = min(max(bisect_left(at, want) - 1, 0), len(children) - 1)
                near = child if want - at[child] <= at[child + 1] - want else child + 1
                whole = children[child][2] == 1 or digits >= KEY_DIGITS
                if abs(at[near] - want) <= tolerance or whole:
                    found[i] = children[near][0] if near < len(children) else f"{cell}{LAST}"
                else:
                    after.setdefault(children[child][0], (at[child], []))[1].append(i)
        open_cells = after
    return [found[i] for i in range(1, parts)]


def histogram_shards(df: DataFrame, size: Column, group: list[str], ids: list[str], shards: int = 40, tolerance: float = 0.002,
                     rows_per_slice: int = 4_000_000) -> DataFrame:
    """Deal rows into ``shards`` of nearly equal bytes, sorted by a key in which equal ``group`` values are neighbours.

    Adds ``shard`` (0 to shards - 1) and ``slot`` (its place there, gapless from 0). The key is the hash of ``group``, then
    that of ``ids``, then the row's number in the stored input, so a group of any size, of fully repeated rows too, can
    be cut anywhere. A splitter is off by ``tolerance`` of a shard's bytes, or by half a row if rows are larger. Each shard is
    sorted in slices of ``rows_per_slice`` rows. Null keys hash like a value; a null size counts 0; no rows: no rows.
    """
    keyed = stored(df.withColumns({
        "__hs_size": F.coalesce(size.cast("long"), F.lit(0)),
        "__hs_key": F.concat(_hex(F.xxhash64(*group)), _hex(F.xxhash64(*ids)), _hex(F.monotonically_increasing_id())),
    }), "keyed")
    whole = keyed.agg(F.coalesce(F.sum("__hs_size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    slices = max(4, math.ceil(whole["n"] / shards / rows_per_slice))
    bounds = splitters(keyed, shards * slices, whole["bytes"], tolerance * whole["bytes"] / shards) if whole["n"] else [LAST] * (shards * slices - 1)
    outer, inner = bounds[slices - 1::slices], [bounds[i * slices:(i + 1) * slices - 1] for i in range(shards)]
    literal = lambda x: "array(" + ", ".join(x) + ")"
    cuts = literal(literal(f"'{b}'" for b in part) for part in inner)
    placed = keyed.withColumn("shard", F.expr(" + ".join(f"int(__hs_key >= '{b}')" for b in outer) if outer else "0")) \
        .withColumn("__hs_slice", F.expr(f"size(filter(element_at({cuts}, shard + 1), b -> b <= __hs_key))"))
    before = Window.partitionBy("shard").orderBy("__hs_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "__hs_slice").count().select("shard", "__hs_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__hs_offset"))
    inside = Window.partitionBy("shard", "__hs_slice").orderBy("__hs_key")
    # At most shards x slices rows are broadcast.
    return placed.withColumn("__hs_n", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "__hs_slice"]) \
        .withColumn("slot", (F.col("__hs_n") - 1 + F.col("__hs_offset")).cast("long")).select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame) -> DataFrame:
    """Digest of the sharding of documents by near equal bytes; a row weighs its UTF-8 bytes plus 16, null text 16."""
    narrow = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
                         F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("_group"))
    placed = histogram_shards(narrow, F.col("size"), ["_group"], ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
