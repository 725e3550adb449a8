"""Large files as byte ranges with overlap, each the work of one task.

A range owns the strings that start in it. It is read with ``LOOKBACK`` bytes before and ``AHEAD`` bytes after: enough for the longest string, its bytes
of context, and, as a rule, the start of a run of printable bytes that is open at the border. That start matters, since runs are cut at every 8192
characters from there. Where a run is longer than the overlap, its start is carried from range to range in a small table, so no range looks further back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from outfall.functions.ship import by_value
from outfall.operators.extract import CONTEXT, MAX_STRING, PRINTABLE
from outfall.rules.pack import MAX_DIMENSION_ROWS
from outfall.sources.sinks import scratch

RANGE_BYTES = 64 << 20
#: Bytes of ranges that one task reads, about, and tasks from which on it gets as many: small ranges share a task, since starting one costs more than reading them.
TASK_BYTES = 16 << 20
TASKS = 64
LOOKBACK = 64 << 10
#: The window of a hit reaches two bytes for each character of the string beyond its start.
AHEAD = 2 * MAX_STRING + CONTEXT
CONTENT = "path string, size_bytes bigint, range_start bigint, range_end bigint, content_start bigint, ascii_skip bigint, wide_skip bigint, content binary"
BORDERS = "path string, border bigint, ascii_from bigint, ascii_open boolean, wide_from bigint, wide_open boolean"
_PRINT = np.zeros(256, bool)
_PRINT[9] = True
_PRINT[32:127] = True
_ASCII_HEAD = re.compile(rf"[{PRINTABLE}]*".encode())
_WIDE_HEAD = re.compile(rf"\x00?(?:[{PRINTABLE}]\x00)*".encode())


class FileRange(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


def _opened(path: str):
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store, inner


def ascii_run(read, low: int, end: int, block: int = LOOKBACK) -> int:
    """Start of the run of printable bytes that ends at ``end``, looked for down to ``low``, block by block."""
    while end > low:
        begin = max(low, end - block)
        breaks = np.flatnonzero(~_PRINT[np.frombuffer(read(begin, end), np.uint8)])
        if len(breaks):
            return begin + int(breaks[-1]) + 1
        end = begin
    return low


def wide_run(read, low: int, end: int, size: int, block: int = LOOKBACK) -> int:
    """Start of the chain of (printable, zero) pairs that covers or ends at ``end``; ``end`` itself if there is none."""
    at = end
    if low < end < size and _PRINT[read(end - 1, end)[0]] and read(end, end + 1) == b"\0":
        at = end + 1  # the border parts a pair
    while at - 2 >= low:
        begin = max(low + (at - low) % 2, at - block)
        begin += (at - begin) % 2
        pairs = np.frombuffer(read(begin, at), np.uint8).reshape(-1, 2)
        breaks = np.flatnonzero(~_PRINT[pairs[:, 0]] | (pairs[:, 1] != 0))
        if len(breaks):
            found = begin + 2 * (int(breaks[-1]) + 1)
            return min(found, end) if found < at or at < end else end
        at = begin
    return min(at, end)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.borders = options.get("borders") == "true"
        if self.size < 2 * LOOKBACK:
            raise ValueError(f"range_bytes has to be {2 * LOOKBACK} or more")

    def partitions(self) -> list[FileRange]:
        """Ranges of all files; small files and small ranges share a partition."""
        store, inner = _opened(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file), key=lambda f: f.path)
        files = [f for f in files if not f.base_name.startswith(("_", "."))]
        together = max(self.size, min(TASK_BYTES, sum(f.size for f in files) // TASKS))
        out: list[list[tuple[str, int, int, int]]] = []
        room = 0
        for f in files:
            for start in range(0, max(f.size, 1), self.size):
                end = min(f.size, start + self.size)
                if room < end - start or not out:
                    out.append([])
                    room = together
                out[-1].append((f.path, f.size, start, end))
                room -= end - start
        return [FileRange(r) for r in out] or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        for path, size, start, end in partition.ranges:
            store, _ = _opened(self.path)
            with store.open_input_file(path) as file:
                read = lambda a, b: file.read_at(b - a, a)
                if self.borders:
                    yield from self._border(read, path, size, start, end)
                    continue
                first = max(0, start - LOOKBACK)
                content = read(first, min(size, end + AHEAD))
                skips = [0 if first == 0 else h if (h := head.match(content).end()) < start - first else None for head in (_ASCII_HEAD, _WIDE_HEAD)]
                values = [path, size, start, end, first, *skips, content]
                kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in CONTENT.split(", ")])

    @staticmethod
    def _border(read, path: str, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        """The run that is open at the end of a range, if the overlap of the next range does not show its start."""
        if end >= size:
            return
        low = max(0, start - LOOKBACK)
        narrow, wide = ascii_run(read, low, end), wide_run(read, low, end, size)
        if min(narrow, wide) <= end - LOOKBACK + 2:
            values = [path, end, narrow, low > 0 and narrow == low, wide, low > 0 and wide <= low + 1]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BORDERS.split(", ")])


class RangeSource(DataSource):
    """Options: path, range_bytes, borders ("true": the open runs instead of the contents)."""

    @classmethod
    def name(cls) -> str:
        return "outfall_ranges"

    def schema(self) -> str:
        return BORDERS if self.options.get("borders") == "true" else CONTENT

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def artifact_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All files below ``path``, of any size, as ranges: path_in_tree, size_bytes, range_start, range_end, content_start, ascii_skip, wide_skip, content.

    ``extract_strings`` and ``scan`` take these rows as they take whole files and give the same rows, at offsets of the file. Files are opened with
    Arrow's file systems (local and mounted folders, and the stores it knows); for other stores there is ``artifact_files``. Files and folders whose
    names begin with ``_`` or ``.`` are left out. An empty file is one empty range.
    """
    spark.dataSource.register(RangeSource)
    read = lambda **o: spark.read.format("outfall_ranges").options(path=path, range_bytes=str(range_bytes), **o).load()
    kept = scratch(spark, "borders")
    order = W.partitionBy("path").orderBy("border")
    start = lambda name: F.last(F.when(~F.col(f"{name}_open"), F.col(f"{name}_from")), ignorenulls=True).over(order)
    read(borders="true").select("path", F.col("border").alias("range_start"), start("ascii").alias("ascii_from"), start("wide").alias("wide_from")).write.parquet(kept)
    carried = spark.read.schema("path string, range_start bigint, ascii_from bigint, wide_from bigint").parquet(kept)
    if carried.limit(MAX_DIMENSION_ROWS + 1).count() <= MAX_DIMENSION_ROWS:
        carried = F.broadcast(carried)
    rows = read().join(carried, ["path", "range_start"], "left")

    def skip(name: str, unit: int):
        behind = F.col("content_start") - F.col(f"{name}_from")
        return F.coalesce(f"{name}_skip", F.pmod(-behind, F.lit(unit)), F.lit(0)).alias(f"{name}_skip")

    base = _opened(path)[1].rstrip("/")
    name = F.when(F.col("path") == base, F.regexp_extract("path", "[^/]*$", 0)).otherwise(F.expr(f"substring(path, {len(base) + 2})"))
    return rows.select(name.alias("path_in_tree"), "size_bytes", "range_start", "range_end", "content_start", skip("ascii", MAX_STRING), skip("wide", 2 * MAX_STRING), "content")


by_value(__name__)
