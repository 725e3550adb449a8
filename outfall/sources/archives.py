"""Recursive expansion of archives: zip family, tar, gzip, ASAR.

One pass per nesting level.  Each pass is a distributed map over archive rows;
its members are checkpointed and spread over the cluster before the next pass.
Only the reading of one archive's directory is Python.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.functions.ship import by_value
from outfall.operators.identify import detect_container
from outfall.operators.unpack import MAX_BYTES, MAX_DEPTH, MAX_FILES, safe_member
from outfall.session import cut

EXPANDABLE = ("zip", "jar", "apk", "tar", "gzip", "asar")
MEMBER = "root string, parent_path_in_tree string, member string, depth int, extracted_by string, content binary, error string"
BATCH_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 4096


def _zip(data: bytes, _name: str) -> Iterator[tuple[str, int, object]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, lambda i=info: archive.read(i)


def _tar(data: bytes, _name: str) -> Iterator[tuple[str, int, object]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        for member in archive:
            if member.isfile():
                yield member.name, member.size, lambda m=member: archive.extractfile(m).read()


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content in pieces: its size is only known at the end, so the reader stops where the budget does."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as stream:
        while piece := stream.read(1 << 20):
            yield piece


def _gzip(data: bytes, name: str) -> Iterator[tuple[str, int, object]]:
    try:
        with tarfile.open(fileobj=io.BytesIO(data)):
            pass
    except tarfile.TarError:
        stem = name.rsplit(".", 1)[0] if "." in name.strip(".") else name
        yield stem or "decompressed", 0, lambda: _inflated(data)
        return
    yield from _tar(data, name)


def _asar(data: bytes, _name: str) -> Iterator[tuple[str, int, object]]:
    (size,) = struct.unpack("<I", data[12:16])
    pending = [("", json.loads(data[16 : 16 + size].rstrip(b"\0")))]
    while pending:
        prefix, node = pending.pop()
        for name, entry in node.get("files", {}).items():
            path = f"{prefix}/{name}" if prefix else name
            if "files" in entry:
                pending.append((path, entry))
            else:
                at, length = 16 + size + int(entry.get("offset", 0)), int(entry.get("size", 0))
                yield path, length, lambda a=at, n=length: data[a : a + n]


READERS = {"zip": _zip, "jar": _zip, "apk": _zip, "tar": _tar, "gzip": _gzip, "asar": _asar}


def _expander(max_bytes: int, max_files: int):
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MEMBER.split(", ")]
        out, held = [], 0  # members of several small archives go on together
        for batch in batches:
            for row in batch.itertuples(index=False):
                files, total = 0, 0
                head = (row.root, row.path_in_tree)
                name = row.path_in_tree.rsplit(" → ", 1)[-1].rsplit("/", 1)[-1]
                try:
                    for member, size, read in READERS[row.container](row.content, name):
                        files, total = files + 1, total + size
                        if files > max_files or total > max_bytes:  # declared sizes stop a bomb early
                            raise ValueError("extraction budget exceeded")
                        data = read()
                        if not isinstance(data, bytes):
                            parts = []
                            for piece in data:
                                total += len(piece)
                                if total > max_bytes:
                                    raise ValueError("extraction budget exceeded")
                                parts.append(piece)
                            data = b"".join(parts)
                        out.append((*head, member, row.depth + 1, row.container, data, None))
                        held += len(data)
                        if held > BATCH_BYTES:
                            yield pd.DataFrame(out, columns=columns)
                            out, held = [], 0
                except Exception as exc:  # an archive that cannot be read is a row, not a failed job
                    out.append((*head, None, row.depth + 1, row.container, None, f"{row.container} extraction failed: {exc}"))
                if len(out) >= BATCH_ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    return expand


def archive_expand(artifacts: DataFrame, max_depth: int = MAX_DEPTH, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """Roots and every member below them.

    ``artifacts``: path_in_tree, content.  Result: root, path_in_tree, parent_path_in_tree, depth,
    size_bytes, container, extracted_by, content, error.  A recognised container that has no
    reader here, or lies at ``max_depth``, keeps its row and says so in ``error``.
    """
    shape = ["root", "path_in_tree", "parent_path_in_tree", "depth", "container", "should_unpack", "extracted_by", "content", "error"]
    none = F.lit(None).cast("string")
    level = detect_container(artifacts.withColumns({
        "root": F.col("path_in_tree"), "parent_path_in_tree": none, "depth": F.lit(0), "extracted_by": none, "error": none})).select(*shape)
    levels = [level]
    for _ in range(max_depth):
        todo = level.where(F.col("should_unpack") & F.col("container").isin(*EXPANDABLE))
        todo = todo.select("root", "path_in_tree", "depth", "container", "content").repartition("path_in_tree")
        members = todo.mapInPandas(_expander(max_bytes, max_files), MEMBER)
        safe = safe_member(F.col("member"))
        named = members.withColumns({
            "path_in_tree": F.concat("parent_path_in_tree", F.lit(" → "), F.coalesce(safe, "member", F.lit("?"))),
            "error": F.when(F.col("error").isNull() & safe.isNull(), F.concat(F.lit("refused entry "), "member")).otherwise(F.col("error"))})
        named = named.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
        level = cut(detect_container(named).select(*shape))
        if level.isEmpty():
            break
        levels.append(level)
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    unread = F.when(~F.col("container").isin(*EXPANDABLE), F.concat(F.lit("no reader for "), "container")).when(F.col("depth") >= max_depth, F.lit("nested too deep"))
    result = result.withColumn("error", F.when(F.col("error").isNull() & F.col("should_unpack") & F.col("container").isNotNull(), unread).otherwise(F.col("error")))
    return result.withColumn("size_bytes", F.octet_length("content").cast("bigint")).drop("should_unpack")


by_value(__name__)
