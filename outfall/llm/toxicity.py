"""Toxicity by class-conditional Kneser-Ney models (operator 8).

Two models of the bytes inside words, one of toxic and one of ordinary rows, share their lower orders: the top order counts by
class, everything below are continuation counts of both. Log-likelihoods are compared normalised by length, for the whole
text and for its most telling expression (word), because a few expressions in a long text decide. A logistic curve
fitted on rows that the counts have not seen turns both into a score.

All training rows are counted, and the n-gram types of all documents stand behind the shared orders; one pass over the texts gives both. Counts,
continuation counts and log-ratios are tables. Up to HELD log-ratios go to every task, which scores texts as it reads them. Of more, texts are
scored block by block, each block joined to the ratios of the n-grams that it has; both ways give the same scores. Only the three numbers of the curve are
fitted on a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outfall.llm.common import erase, pieces, stored
from outfall.llm.words import Words, _LOWER, joined, split_words

#: Bytes in an n-gram; six fit a long.
ORDER = 6
#: Labelled rows to fit the logistic curve on, at most about; they are of two folds, sampled by hash if those are larger. Counts are of all rows.
FIT_ROWS = 20_000
CURVE_FOLDS = (1, 2)
#: Kinds of labelled rows: whether of the curve's folds x 2 + class. Rows without a label have kind -1.
KINDS = 4
#: Labelled training rows that are broadcast to the texts, at most; to more of them texts are shuffled.
LABELS = 2_000_000
#: N-gram types whose log-ratios every task may hold (16 bytes each); of more, texts get theirs through joins.
HELD = 4 << 20
#: Bytes of text that are counted or scored together, about.
PIECE = 8 << 20
#: N-gram types that a counting task gathers before it hands them on, about.
GATHERED = 1 << 19
#: Bytes of text in a block that is joined to its ratios, about.
BLOCK = 16 << 20
END = 1
_DISCOUNT = 0.75


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def distinct_words(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of a first occurrence, and for each word the number of its distinct one."""
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    return first, inverse, words.end[first] - words.start[first]


def grams(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ORDER bytes up to each position of each word, its end included, packed into a long; words one after the other."""
    pad = ORDER - 1
    room = size + pad + 1
    begin = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[within + np.repeat(begin + pad, size)] = data[within + np.repeat(start, size)]
    flat[begin + pad + size] = END
    places = np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1) + np.repeat(begin + pad, size + 1)
    packed = np.zeros(len(places), np.int64)
    for back in range(pad, -1, -1):
        packed = (packed << 8) | flat[places - back]
    return packed


@dataclass
class Model:
    """Log-ratio (toxic to ordinary) of each seen n-gram, and of an unseen byte after each seen context."""

    gram: np.ndarray
    gram_ratio: np.ndarray
    context: np.ndarray
    context_ratio: np.ndarray


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(inverse, v, len(unique)) for v in values), inverse


def shared_backoff(types: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each n-gram type's last byte after its context without the first byte, from the types of both classes."""
    probability = np.full(len(types), 1 / 256)
    for order in range(1, ORDER):
        mask = (1 << (8 * order)) - 1
        longer = np.unique(types & ((1 << (8 * (order + 1))) - 1))
        suffix, continued, _ = _grouped(longer & mask, np.ones(len(longer)))
        _, total, kinds, of = _grouped(suffix >> 8, continued, np.ones(len(suffix)))
        at = np.searchsorted(suffix, types & mask)
        probability = (np.maximum(continued - _DISCOUNT, 0)[at] + _DISCOUNT * kinds[of][at] * probability) / total[of][at]
    return probability


def fit(gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """gram: ascending types with their counts by class."""
    below = shared_backoff(gram)
    context = gram >> 8
    logs, unseen = [], []
    for count in (toxic, ordinary):
        known, total, kinds, of = _grouped(context, count, (count > 0).astype(float))
        weight = np.where(total > 0, _DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(count - _DISCOUNT, 0) / np.maximum(total[of], 1) + weight[of] * below))
        unseen.append(np.log(weight))
    return Model(gram, logs[0] - logs[1], known, unseen[0] - unseen[1]) if len(gram) else Model(gram, gram.astype(float), gram, gram.astype(float))


def _gathered(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return _grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))[:-1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram types with their counts by kind, gathered over pieces of text; rows without a label give types only."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["gram", *(f"n{k}" for k in range(KINDS))])
    for batch in pieces(batches, "text", PIECE):
        data, starts = joined(batch.column("text"))
        data = _LOWER[data]
        words = split_words(data, starts)
        if not len(words.hash):
            continue
        first, inverse, size = distinct_words(data, words)
        kind = batch.column("kind").to_numpy()[words.doc]
        each = [np.repeat(np.bincount(inverse[kind == k], minlength=len(first)), size + 1) for k in range(KINDS)]
        held.append(_grouped(grams(data, words.start[first], size), *each)[:-1])
        if sum(len(x[0]) for x in held) > 2 * GATHERED:
            held = [_gathered(held)]
            if len(held[0][0]) > GATHERED:
                yield rows(held.pop())
    if held:
        yield rows(_gathered(held))


def _in_texts(words: Words, inverse: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the numbers of its distinct words, ascending, and how often it has them, flat, and where each text begins."""
    pairs, n = np.unique(words.doc * max(1, distinct) + inverse, return_counts=True)
    doc, word = np.divmod(pairs, max(1, distinct))
    return np.searchsorted(doc, np.arange(len(words.first))), word, n


def _features(ratio: np.ndarray, size: np.ndarray, bound: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text: the length-normalised log-ratio of all its bytes, and the largest of a word. No words: zeros. ratio: of the n-grams of the distinct words."""
    out = np.zeros((len(bound) - 1, 2))
    if len(word):
        starts, has = np.cumsum(size + 1) - size - 1, np.flatnonzero(np.diff(bound))
        lengths = np.add.reduceat((size + 1)[word] * n, bound[:-1][has])
        each = np.add.reduceat(ratio, starts)
        out[has, 0] = np.add.reduceat(each[word] * n, bound[:-1][has]) / lengths
        out[has, 1] = np.maximum.reduceat((each / (size + 1))[word], bound[:-1][has])
    return out


def _scored(model: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model: all n-gram types, ascending, and their log-ratios."""
    gram, ratio = model
    for batch in pieces(batches, "text", PIECE):
        data, starts = joined(batch.column("text"))
        data = _LOWER[data]
        words = split_words(data, starts)
        first, inverse, size = distinct_words(data, words)
        found = ratio[np.searchsorted(gram, grams(data, words.start[first], size))] if len(first) else np.zeros(0)
        out = _features(found, size, *_in_texts(words, inverse, len(first)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("kind").cast(pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["doc_id", "kind", "mean", "most"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of about BLOCK bytes as one row: their ids and kinds, their distinct words, and for each text the numbers of its words and how often it has them."""
    for batch in pieces(batches, "text", BLOCK):
        data, starts = joined(batch.column("text"))
        data = _LOWER[data]
        words = split_words(data, starts)
        first, inverse, size = distinct_words(data, words)
        bound, word, n = _in_texts(words, inverse, len(first))
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = data[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(words.start[first], size)]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([one(batch.column("doc_id").cast(pa.int64())), one(batch.column("kind").cast(pa.int32())), one(pa.array(bound, pa.int32())),
                                          one(pa.array(word, pa.int32())), one(pa.array(n, pa.int32())), pa.array([flat.tobytes()], pa.binary()), one(pa.array(size, pa.int32()))], names=_BLOCK_FIELDS)


_BLOCK_FIELDS = ["doc", "kind", "bound", "word", "n", "flat", "size"]
_BLOCK_ROW = "doc array<bigint>, kind array<int>, bound array<int>, word array<int>, n array<int>, flat binary, size array<int>"


def _block_grams(flat: bytes, size: np.ndarray) -> np.ndarray:
    return grams(np.frombuffer(flat, np.uint8), np.cumsum(size) - size, size)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, flat, size in zip(batch.column("block").to_pylist(), batch.column("flat"), batch.column("size"), strict=True):
            unique = np.unique(_block_grams(flat.as_py(), size.values.to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), block)), pa.array(unique)], names=["block", "gram"])


def stored_blocks(rows: DataFrame) -> DataFrame:
    """rows: doc_id, kind, text. A block gets its number where it is stored."""
    return stored(rows.select("doc_id", "kind", "text").mapInArrow(_blocks, _BLOCK_ROW).withColumn("block", F.monotonically_increasing_id()), "blocks")


def gram_rows(blocks: DataFrame) -> DataFrame:
    """(block, gram): the distinct n-grams of each block."""
    return blocks.select("block", "flat", "size").mapInArrow(_gram_rows, "block long, gram long")


def _mask(order: int) -> Column:
    return F.lit((1 << (8 * order)) - 1).cast("long")


def backoff_table(types: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(suffix, below): ``shared_backoff`` by aggregation, for the n-gram types (gram) of a table without repeats. A context has at most 256 successors.

    Tables that the result reads are added to ``made``.
    """
    level, upper = {}, types.select("gram")
    for order in range(ORDER - 1, 0, -1):
        level[order] = upper = stored(upper.groupBy(F.col("gram").bitwiseAND(_mask(order)).alias("gram")).agg(F.count(F.lit(1)).alias("continued")), f"order-{order}")
    made += level.values()
    lower = None
    for order in range(1, ORDER):
        same = W.partitionBy(F.shiftright("gram", 8))
        now = level[order].select("gram", "continued", F.sum("continued").over(same).alias("total"), F.count(F.lit(1)).over(same).alias("kinds"))
        if lower is None:
            now = now.withColumn("below", F.lit(1 / 256))
        else:
            now = now.withColumn("suffix", F.col("gram").bitwiseAND(_mask(order - 1))).join(lower, "suffix")
        lower = now.select(F.col("gram").alias("suffix"), ((F.greatest(F.col("continued") - _DISCOUNT, F.lit(0.0)) + _DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")).alias("below"))
    return lower


def ratio_table(counts: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Log-ratio of each n-gram type: r0 of the model without the curve's folds, r1 of the model of all.

    counts: gram, n0 to n3 (whether of the curve's folds x 2 + class), zeros for types that only texts without a label have; no repeats.
    """
    same = W.partitionBy(F.shiftright("gram", 8))
    names = [f"{m}{c}" for m in (0, 1) for c in (0, 1)]
    some = counts.select("gram", *(F.col(f"n{c}").alias(f"c0{c}") for c in (0, 1)), *((F.col(f"n{c}") + F.col(f"n{2 + c}")).alias(f"c1{c}") for c in (0, 1)))
    some = some.select("gram", *(f"c{x}" for x in names), *(F.sum(f"c{x}").over(same).alias(f"t{x}") for x in names), *(F.sum((F.col(f"c{x}") > 0).cast("long")).over(same).alias(f"k{x}") for x in names))
    some = some.withColumn("suffix", F.col("gram").bitwiseAND(_mask(ORDER - 1))).join(backoff_table(counts, [] if made is None else made), "suffix")

    def log(x: str) -> Column:
        total = F.col(f"t{x}")
        weight = F.when(total > 0, _DISCOUNT * F.col(f"k{x}") / F.greatest(total, F.lit(1))).otherwise(F.lit(1.0))
        return F.log(F.greatest(F.col(f"c{x}") - _DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1)) + weight * F.col("below"))

    return some.select("gram", *((log(f"{m}1") - log(f"{m}0")).alias(f"r{m}") for m in (0, 1)))


def _of_block(found: pa.Table, texts: pa.Table) -> pa.Table:
    """``_features`` of the texts of a block by the log-ratios of its n-grams."""
    row = {c: texts.column(c).combine_chunks() for c in texts.column_names}
    doc, kind, bound, word, n, size = (row[c].flatten() for c in ("doc", "kind", "bound", "word", "n", "size"))
    bound, word, n, size = (x.to_numpy().astype(np.int64) for x in (bound, word, n, size))
    ratio = np.zeros(0)
    if len(word):
        order = np.argsort(found.column("gram").to_numpy())
        ratio = found.column("r").to_numpy()[order][np.searchsorted(found.column("gram").to_numpy()[order], _block_grams(row["flat"][0].as_py(), size))]
    out = _features(ratio, size, bound, word, n)
    return pa.table([doc, kind, pa.array(out[:, 0]), pa.array(out[:, 1])], names=["doc_id", "kind", "mean", "most"])


def block_features(blocks: DataFrame, ratios: DataFrame, model: str) -> DataFrame:
    """doc_id, kind, mean, most of each text by the log-ratios in column ``model``."""
    found = gram_rows(blocks).join(ratios.select("gram", F.col(model).alias("r")), "gram")
    return found.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_of_block, "doc_id long, kind int, mean double, most double")


def held_ratios(ratios: DataFrame, held: int = HELD) -> dict[str, np.ndarray] | None:
    """The columns of the log-ratios, by ascending n-gram, if there are no more than ``held``."""
    if ratios.count() > held:
        return None
    found = ratios.toArrow()
    order = np.argsort(found.column("gram").to_numpy())
    return {c: found.column(c).to_numpy()[order] for c in found.column_names}


def text_features(rows: DataFrame, ratios: DataFrame, known: dict[str, np.ndarray] | None, model: str, made: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, kind, mean, most of each row (doc_id, kind, text) by the log-ratios in column ``model``; known: those of ``held_ratios``.

    Tables that the result reads are added to ``made``.
    """
    if known is None:
        blocks = stored_blocks(rows)
        if made is not None:
            made.append(blocks)
        return block_features(blocks, ratios, model)
    shared = rows.sparkSession.sparkContext.broadcast((known["gram"], known[model]))  # at most HELD n-grams
    return rows.select("doc_id", "kind", "text").mapInArrow(lambda batches: _scored(shared.value, batches), "doc_id long, kind int, mean double, most double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last column of x is ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of all training rows; kind: whether of the curve's folds x 2 + class; of repeated labels the largest."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return usable.select("doc_id", (F.col("toxic") + 2 * (fold(F.col("doc_id")).isin(*CURVE_FOLDS)).cast("int")).cast("int").alias("kind"))


def labelled(texts: DataFrame, usable: DataFrame, most: int = LABELS) -> DataFrame:
    """text and kind of all texts; -1 without a label."""
    few = usable.count() <= most
    return texts.join(F.broadcast(usable) if few else usable, "doc_id", "left").select("text", F.coalesce("kind", F.lit(-1)).alias("kind"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held: int = HELD) -> tuple[DataFrame, dict[str, np.ndarray] | None, np.ndarray, np.ndarray]:
    """The stored log-ratios of all training rows, and as ``held_ratios``; scale and weights of the curve, fitted on rows of two folds that were scored without them."""
    usable = stored(usable_labels(labels), "labels")
    rows = docs.select("doc_id", "text").where("text IS NOT NULL")
    counts = labelled(rows, usable).mapInArrow(_counted, ", ".join(["gram long", *(f"n{k} long" for k in range(KINDS))]))
    counts = stored(counts.groupBy("gram").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(KINDS))), "grams")
    made = [counts]
    ratios = stored(ratio_table(counts, made), "ratios")
    erase(*made)
    known = held_ratios(ratios, held)
    own = usable.where("kind >= 2")
    share = min(1.0, fit_rows / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    made = [usable]
    unseen = text_features(rows.join(F.broadcast(chosen), "doc_id"), ratios, known, "r0", made).select("kind", "mean", "most").toArrow()  # bounded by fit_rows
    erase(*made)
    x, y = np.column_stack((unseen["mean"].to_numpy(), unseen["most"].to_numpy())), (unseen["kind"].to_numpy() % 2).astype(float)
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(2)
    weights = logistic(np.column_stack((x / scale, np.ones(len(x)))), y) if len(x) else np.zeros(3)
    return ratios, known, scale, weights


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), and both log-ratios of every document.

    Labels of rows whose crc32(doc_id) mod 5 is 0 are not used; the curve is fitted on rows of remainder 1 or 2, which a model without them has scored. A null or empty text scores what no evidence scores. Without
    labels every score is 0.5. Repeated rows score alike; a null doc_id is not held out; other columns are left out. No documents: no rows.
    """
    ratios, known, scale, weights = train(docs, labels, fit_rows, held)
    a, b, c = (float(w) for w in (weights[0] / scale[0], weights[1] / scale[1], weights[2]))
    x = F.col("mean") * a + F.col("most") * b + c
    scored = text_features(docs.select("doc_id", F.lit(-1).alias("kind"), "text"), ratios, known, "r1").withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("mean").alias("mean_log_ratio"), F.col("most").alias("largest_log_ratio"))
