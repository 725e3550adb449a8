"""Line dedup by a deletion-neighbourhood join (operator 1).

A line goes if an earlier line, in the order of documents and lines, equals it or is within the edit bound. Edits are of words: a line of
``WORDS_PER_EDIT`` words or more may differ by one word put in, left out or replaced; a shorter one must be equal. Lines are compared as
lower-case (A-Z) words. A line emits its hash and the hashes of all its variants with one word deleted; lines with an equal variant, or
one's variant equal to the other, are joined, and each is verified against the earliest of its variant by edit distance. Variants
are emitted only for lines that share their first or second half with another line: one edit leaves one half as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import pieces, row_key, stored
from outfall.llm.words import Words, _LOWER, joined, mix, powers, split_words

WORDS_PER_EDIT = 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(0xC2B2AE3D27D4EB4F)


def line_words(data: np.ndarray, starts: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts; per line with a word its text, its number there, and its first and last word (one behind)."""
    words = split_words(_LOWER[data], starts)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    first, last = np.searchsorted(words.start, begins), np.searchsorted(words.start, ends)
    doc = np.searchsorted(starts, begins, side="right") - 1
    number = np.arange(len(ends)) - np.searchsorted(begins, starts[:-1])[doc] if len(ends) else ends
    has = last > first
    return words, doc[has], number[has], first[has], last[has]


class Prefix:
    """Hashes of runs of words in constant time: sum of word hash times a power of its place in the run."""

    def __init__(self, hashes: np.ndarray):
        self.power = powers(len(hashes) + 1)
        # Inverse powers of an odd base modulo 2^64.
        self.inverse = np.ones(len(hashes) + 1, np.uint64)
        self.inverse[1:] = pow(int(_BASE), -1, 1 << 64)
        self.inverse = np.multiply.accumulate(self.inverse)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.power[: len(hashes)], dtype=np.uint64)))

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.inverse[a]


def line_keys(words: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line, and four hashes of its halves (0 where a line is too short to have variants)."""
    prefix, n = Prefix(words.hash), last - first
    whole = mix(prefix.run(first, last) + n.astype(np.uint64))
    halves = np.zeros((len(n), 4), np.uint64)
    long = np.flatnonzero(n >= WORDS_PER_EDIT)
    for k, m in enumerate((n[long] // 2, (n[long] - 1) // 2)):
        tag = mix(m.astype(np.uint64) * _HALF)
        halves[long, 2 * k] = mix(prefix.run(first[long], first[long] + m) + tag)
        halves[long, 2 * k + 1] = mix((prefix.run(last[long] - m, last[long]) ^ _HALF) + tag)
    return whole.view(np.int64), halves.view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, starts = joined(batch.column("text"))
        words, doc, number, first, last = line_words(data, starts)
        whole, halves = line_keys(words, first, last)
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("rk").take(at), pa.array(number.astype(np.int32)), pa.array(whole), *(pa.array(halves[:, k]) for k in range(4))],
                                         names=["doc_id", "rk", "line", "h", "p0", "s0", "p1", "s1"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the wanted lines: the hash and the words of the line itself (place -1), and the hash of each deletion with its place."""
    for batch in pieces(batches, "text"):
        data, starts = joined(batch.column("text"))
        words, doc, number, first, last = line_words(data, starts)
        whole, _ = line_keys(words, first, last)
        wanted = batch.column("lines")
        bound, values = wanted.offsets.to_numpy(), wanted.values.to_numpy(zero_copy_only=False)
        values, owner = values[bound[0]:bound[-1]], np.repeat(np.arange(len(bound) - 1), np.diff(bound))
        pick = np.flatnonzero(np.isin(doc * (1 << 32) + number, owner * (1 << 32) + values))
        prefix = Prefix(words.hash)
        n = (last - first)[pick]
        of = np.repeat(np.arange(len(pick)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, b = first[pick][of], last[pick][of]
        gone = mix(prefix.run(a, a + place) + prefix.run(a + place + 1, b) * prefix.power[place] + (n[of] - 1).astype(np.uint64)).view(np.int64)
        line = np.concatenate((np.arange(len(pick)), of))
        low = _LOWER[data]
        text = [" ".join(low[words.start[i]:words.end[j - 1]].tobytes().decode("utf-8", "replace").split()) for i, j in zip(first[pick].tolist(), last[pick].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(whole[pick][line]), pa.array(np.concatenate((np.full(len(pick), -1), place)).astype(np.int32)), pa.array(np.concatenate((whole[pick], gone))),
                                          pa.array(text + [None] * len(of), pa.string())], names=["h", "place", "key", "words"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, left out or replaced turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [within_one(a.split(" "), b.split(" ")) for a, b in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)]
        yield batch.select(["h"]).filter(pa.array(keep, pa.bool_()))


def _place(*columns: str) -> Column:
    """The order of lines: by doc_id, null last, then by the row's content, then by line."""
    return F.struct(F.col("doc_id").isNull().alias("none"), *(F.col(c) for c in columns))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, line, exact) of the lines that go: exact says whether an earlier line is equal. Lines count from 0; rk is the row's content key."""
    rows = docs.select("doc_id", "text", row_key(docs).alias("rk")).where("text IS NOT NULL")
    lines = stored(rows.mapInArrow(_lines, "doc_id long, rk long, line int, h long, p0 long, s0 long, p1 long, s1 long"), "lines")
    order = _place("doc_id", "rk", "line")
    kinds = stored(lines.groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("p0", "s0", "p1", "s1"))), "kinds")
    # Lines that share a half with another line.
    half = kinds.where("p0 <> 0").select("h", F.explode(F.array_distinct(F.array("p0", "s0", "p1", "s1"))).alias("half"))
    busy = stored(half.groupBy("half").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("half"), "busy")
    near = stored(kinds.select("h", "first").join(half.join(busy, "half").select("h").distinct(), "h"), "near")
    asked = near.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.rk").alias("rk")).agg(F.collect_list("first.line").alias("lines"))  # lines of one document
    chosen = rows.alias("r").join(asked.alias("a"), F.expr("r.rk = a.rk AND r.doc_id <=> a.doc_id")).select("r.text", "a.lines")
    variants = stored(chosen.mapInArrow(_variants, "h long, place int, key long, words string"), "variants")
    words = stored(variants.where("place < 0").select("h", "words").dropDuplicates(["h"]), "words")
    twice = stored(variants.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "twice")
    hits = stored(variants.select("h", "place", "key").join(twice, "key").join(near, "h"), "hits")
    # The earliest line that is this variant, that has it with a word deleted, and with one deleted at the same place.
    own = F.struct("first", "h")
    by_key = stored(hits.groupBy("key").agg(F.min(F.when(F.col("place") < 0, own)).alias("e0"), F.min(F.when(F.col("place") >= 0, own)).alias("e1")), "by_key")
    by_place = stored(hits.where("place >= 0").groupBy("key", "place").agg(F.min(own).alias("e")), "by_place")
    added = hits.join(by_key, "key").withColumn("e", F.expr("CASE WHEN place < 0 THEN e1 ELSE e0 END")).select("h", "first", "e")
    replaced = hits.join(by_place, ["key", "place"]).select("h", "first", "e")
    pairs = added.union(replaced).where("e.first < first AND e.h <> h").selectExpr("h", "e.h AS other").distinct()
    with_words = pairs.join(words.withColumnRenamed("words", "wa"), "h").join(words.select(F.col("h").alias("other"), F.col("words").alias("wb")), "other")
    close = stored(with_words.select("h", "wa", "wb").mapInArrow(_verified, "h long").distinct(), "close")
    repeats = lines.select("doc_id", "rk", "line", "h").join(kinds.where("n > 1").select("h", "first"), "h").where(order != F.col("first")).select("doc_id", "rk", "line", F.lit(True).alias("exact"))
    # Repeats of a line that goes because of another one are repeats already; of a near line only its first occurrence is added.
    return repeats.union(kinds.join(close, "h").selectExpr("first.doc_id", "first.rk", "first.line", "false AS exact")).distinct()


def _cut(keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts, counts, gone = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            if text is not None and drop:
                out = set(drop)
                lines = text.split("\n")
                text = "\n".join(x for i, x in enumerate(lines) if i not in out)
            texts.append(text)
            counts.append(len(drop or ()))
        yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if k == "text" else batch.column(k) for k in keep), pa.array(counts, pa.int64())], names=[*keep, "n_removed"])


def dedup_lines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (``text`` without the lines that go) of every document, and the number of lines removed, n_removed.

    Lines end at ``\\n``; lines without a word stay. Documents stay, also if nothing is left of them. A null text stays null. Earlier is a smaller
    doc_id; null ids come last, in the order of a hash of their texts. Fully repeated rows (equal doc_id and text) are one document: they keep the same lines.
    ``keep`` may not hold n_removed; other columns are left out. No documents: no rows.
    """
    drop = duplicate_lines(docs).groupBy("doc_id", "rk").agg(F.collect_list("line").alias("drop"))  # lines of one document
    rows = docs.select(*keep, *(c for c in ("doc_id", "text") if c not in keep)).withColumn("__rk", row_key(docs))
    found = rows.alias("r").join(drop.select(F.col("doc_id").alias("__doc"), F.col("rk").alias("__drop_rk"), "drop").alias("g"), F.expr("r.__rk = g.__drop_rk AND r.doc_id <=> g.__doc"), "left")
    picked = found.select(*(F.col(f"r.`{k}`") for k in dict.fromkeys([*keep, "text"])), F.col("g.drop").alias("drop"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keep).schema)
    return picked.mapInArrow(lambda batches: _cut(keep, batches), f"{kinds}, n_removed long")


def line_digest(docs: DataFrame) -> DataFrame:
    """Of every document: its lines, those removed, and length and digest of what is left."""
    left = dedup_lines(docs.select("doc_id", "text").withColumn("n_lines", F.expr("if(text IS NULL, 0, 1 + length(text) - length(replace(text, '\\n', '')))").cast("long")), ["doc_id", "text", "n_lines"])
    return left.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
