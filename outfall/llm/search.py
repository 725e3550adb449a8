"""Ranked lexical search by presence masks (operator 13).

One pass over the documents keeps, of each, its length and the counts of those of its terms that some item asks for; the table is written once. Document
frequencies and lengths are aggregated from it, so weights follow all documents. In a second pass every block of documents is grouped, for each item, by
the bitmap of the item's terms that a document holds. Distinct masks are looked at by descending largest possible score, until no further mask can reach
the score of the last wanted place; only then are scores counted, and only for documents of those masks. A task hands on no more than the wanted number
of documents for each item, best first, and keeps that list across its blocks, so later blocks finish sooner. Ranks come from two small windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfall.llm.common import pieces, stored
from outfall.llm.words import joined

#: Documents wanted for each item.
TOP = 50
#: Terms of items that one pass carries, about; more items take more passes over the documents.
PASS_TERMS = 200_000
#: First-level rankings of an item.
PARTS = 32
#: Postings that a task looks at together, about; a longer document is a block of its own.
BLOCK_POSTINGS = 400_000
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of many texts one after the other, A-Z lower-cased, and each text's first (one more: their number). Null: none."""
    data, starts = joined(column)
    edges = np.flatnonzero(np.diff(_TERM[data].view(np.int8), prepend=0, append=0)).astype(np.int64)
    if not len(edges):
        return pa.array([], pa.large_binary()), np.zeros(len(starts), np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(_LOWER[data])])
    return runs.take(pa.array(np.arange(0, len(edges), 2))), np.searchsorted(edges[::2], starts)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found, first = terms(batch.column("text"))
        item = batch.column("item_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
        yield pa.RecordBatch.from_arrays([item, found.cast(pa.large_string()).cast(pa.string())], names=["item_id", "term"])


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _postings(known: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    asked = pa.array([t.encode() for t in known], pa.large_binary())
    for batch in pieces(batches, "text"):
        found, first = terms(batch.column("text"))
        n = np.diff(first)
        at = pc.fill_null(pc.index_in(found, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), n)
        key, tf = np.unique((doc * max(1, len(known)) + at)[at >= 0], return_counts=True)
        rows = np.flatnonzero(n)
        bounds = np.searchsorted(key, np.append(rows, batch.num_rows) * max(1, len(known)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(n[rows], pa.int64()), _lists(key % max(1, len(known)), bounds, pa.int32()),
                                          _lists(tf, bounds, pa.int64())], names=["doc_id", "n", "terms", "tfs"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and each row's first (one more: their number)."""
    first = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[first[0]:first[-1]], (first - first[0]).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_POSTINGS) -> Iterator[pa.RecordBatch]:
    """Row ranges of batches with about ``most`` postings."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def saturation(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def masks_of(size: int, own: list[np.ndarray]) -> np.ndarray:
    """Bit k of a row says whether the row is in own[k]; 64 bits to a column."""
    bits = np.zeros((size, (len(own) + 63) // 64), np.uint64)
    for k, rows in enumerate(own):
        bits[rows, k >> 6] |= np.uint64(1 << (k & 63))
    return bits


class Block:
    """Documents with postings by row and by term, and what any document of the block can score at most for a term."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray, first: np.ndarray, weights: np.ndarray, total: int, length: int):
        self.doc, self.null, self.term, self.tf, self.first, self.weights = doc, null, term, tf, first, weights
        self.m = 50 + (50 * n * total) // length
        row = np.repeat(np.arange(len(doc)), np.diff(first))
        order = np.argsort(term, kind="stable")
        self.rows, self.start = row[order], np.searchsorted(term[order], np.arange(len(weights) + 1))
        most = np.zeros(len(weights), np.int64)
        np.maximum.at(most, term, tf)
        self.most = weights * saturation(np.maximum(most, 1), int(self.m.min(initial=50))) * (most > 0)

    def score(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of some documents for the terms that ``asked`` marks."""
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(rows)), size)
        use = asked[self.term[at]]
        at, own = at[use], own[use]
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, own, self.weights[self.term[at]] * saturation(self.tf[at], self.m[rows[own]]))
        return out


def best_rows(block: Block, item: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of all documents of a block that can be among the best ``top`` with ``least`` or more, by descending masks."""
    bits = masks_of(len(block.doc), [block.rows[block.start[t]:block.start[t + 1]] for t in item])
    some = np.flatnonzero(bits.any(axis=1))
    if not len(some):
        return some, np.zeros(0, np.int64)
    masks, group = np.unique(bits[some], axis=0, return_inverse=True) if bits.shape[1] > 1 else np.unique(bits[some, 0], return_inverse=True)
    holds = np.unpackbits(masks.reshape(len(masks), -1).view(np.uint8), axis=1, bitorder="little")[:, :len(item)]
    bound = holds @ block.most[item]
    by_bound = np.argsort(-bound, kind="stable")
    place = np.empty(len(masks), np.int64)
    place[by_bound] = np.arange(len(masks))
    order = np.argsort(place[group.ravel()], kind="stable")
    some, bound = some[order], bound[by_bound]
    ends = np.cumsum(np.bincount(place[group.ravel()], minlength=len(masks)))
    asked = np.zeros(len(block.weights), bool)
    asked[item] = True
    rows, scores, mask, done, least = [], [], 0, 0, max(least, 1)
    while mask < len(masks) and bound[mask] >= least:
        # As many of the next masks as hold another ``top`` documents, of those that can still reach the last wanted place.
        to = min(int(np.searchsorted(ends, done + top)) + 1, int(np.searchsorted(-bound, -least, side="right")))
        rows.append(some[done:ends[to - 1]])
        scores.append(block.score(rows[-1], asked))
        mask, done = to, ends[to - 1]
        so_far = np.concatenate(scores)
        if len(so_far) >= top:
            least = max(least, int(np.partition(so_far, len(so_far) - top)[len(so_far) - top]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, scores = np.concatenate(rows), np.concatenate(scores)
    return rows[scores >= least], scores[scores >= least]


def _search(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, total: int, length: int, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [np.zeros((0, 3), np.int64)] * len(items)  # score, whether the id is null, id: the best so far
    for batch in blocks(batches):
        term, first = flat(batch.column("terms"))
        ids = batch.column("doc_id")
        block = Block(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(ids).to_numpy(zero_copy_only=False), batch.column("n").to_numpy(),
                      term, flat(batch.column("tfs"))[0], first, weights, total, length)
        for i, (_, asked) in enumerate(items):
            rows, scores = best_rows(block, asked, top, int(kept[i][-1, 0]) if len(kept[i]) == top else 1)
            if len(rows):
                found = np.concatenate((kept[i], np.column_stack((scores, block.null[rows], block.doc[rows]))))
                kept[i] = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))][:top]
    size = [len(k) for k in kept]
    if sum(size):
        found = np.concatenate(kept)
        item = pa.array([i for i, _ in items], pa.int64()).take(pa.array(np.repeat(np.arange(len(items)), size)))
        yield pa.RecordBatch.from_arrays([item, pa.array(found[:, 2], mask=found[:, 1] > 0), pa.array(found[:, 0])], names=["item_id", "doc_id", "score"])


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score; equal scores by doc_id, a null doc_id last.

    Rows of ``items`` with one item_id are one item with the terms of all; a null id is an item too. A document or item without terms (null, empty, only
    signs) matches nothing and is not counted. Repeated rows of documents are documents of their own, each with a rank. No documents or items: no rows.
    Items are held on the driver and sent to tasks in passes of about ``pass_terms`` terms. Other columns are left out.
    """
    spark = docs.sparkSession
    wanted = stored(items.select("item_id", "text").mapInArrow(_item_terms, "item_id long, term string").distinct(), "item-terms")
    passes = -(-wanted.count() // pass_terms)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for p in range(passes):
        asked: dict[int | None, list[str]] = {}
        for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect():
            asked.setdefault(r["item_id"], []).append(r["term"])
        known = sorted({t for own in asked.values() for t in own})
        number = {t: i for i, t in enumerate(known)}
        postings = stored(docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(partial(_postings, known), "doc_id long, n long, terms array<int>, tfs array<long>"), "postings")
        all_docs = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
        if not all_docs["docs"]:
            break
        weights = np.zeros(len(known), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weights[r["t"]] = weight(all_docs["docs"], r["count"])
        own = [(i, np.array(sorted(number[t] for t in ts))) for i, ts in sorted(asked.items(), key=lambda x: (x[0] is None, x[0] or 0))]
        found = found.union(postings.mapInArrow(partial(_search, own, weights, all_docs["docs"], all_docs["length"], top), found.schema))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PATTERN = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
SEARCH_SQL = f"""WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, {_UPPER}), {_PATTERN}) AS ts FROM documents WHERE text IS NOT NULL),
docs AS MATERIALIZED (SELECT doc_id, r, len(ts)::BIGINT AS n, ts FROM words WHERE len(ts) > 0),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_UPPER}), {_PATTERN})) AS term FROM benchmark),
counted AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) GROUP BY r, term),
postings AS MATERIALIZED (SELECT * FROM counted WHERE term IN (SELECT term FROM wanted)),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * whole.docs) // length))))::BIGINT AS score
    FROM postings JOIN weights USING (term) JOIN wanted USING (term) JOIN docs USING (r), whole GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
