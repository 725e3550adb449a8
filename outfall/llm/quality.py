"""Quality rules by line sequence labelling (operator 4).

A linear-chain conditional random field, trained here on a bounded sample of labelled documents, marks every line of a text as
content or boilerplate by Viterbi decoding. The words on content lines, as a share of all words, decide retention.
Every count covers the whole text; all counting is vectorised over the bytes of many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import pieces
from outfall.llm.words import Words, joined, spans_hashed, split_words, sums, windows

#: Labelled documents to fit on, at most.
FIT_ROWS = 2_000
#: Share of words on content lines from which a document stays.
CONTENT_SHARE = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC2:0xF5] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOUD = np.zeros(256, bool)
_LOUD[[ord(c) for c in "!?|{}[]=_~^\\/@"]] = True
_POINT = ~((np.arange(256) & 0xC0) == 0x80)


@dataclass
class Lines:
    """Per text: the base counts. Per line with a word: its text, words and features; bound gives each text's lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    words: np.ndarray
    bound: np.ndarray
    x: np.ndarray


def _first_seen(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where (doc, key) has occurred before."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return again


def repeated(words: Words, size: int = 3) -> np.ndarray:
    """True for words in a window of ``size`` words that occurs twice or more in its text."""
    key, at = windows(words, size)
    out = np.zeros(len(words.hash) + 1, np.int64)
    if len(key):
        doc = words.doc[at]
        order = np.lexsort((key, doc))
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(out, at[twice], 1)
        np.add.at(out, at[twice] + size, -1)
    return np.cumsum(out)[:-1] > 0


def measure(column: pa.Array) -> Lines:
    data, starts = joined(column)
    words = split_words(data, starts)
    n_words = np.diff(words.first)
    again = repeated(words)
    points = np.concatenate(([0], np.cumsum(_POINT[data])))
    word_points = points[words.end] - points[words.start]
    # Lines end at \n; the buffer has one after each text.
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    first = np.searchsorted(words.start, begins)
    last = np.searchsorted(words.start, ends)
    has = last > first
    begins, ends, first, last = begins[has], ends[has], first[has], last[has]
    line_doc = np.searchsorted(starts, begins, side="right") - 1
    dup = _first_seen(line_doc, spans_hashed(data, begins, ends))
    bound = np.searchsorted(line_doc, np.arange(len(starts)))
    counted = lambda table, a, b: (lambda c: c[b] - c[a])(np.concatenate(([0], np.cumsum(table[data]))))
    n = (last - first).astype(float)
    size = np.maximum(ends - begins, 1)
    letters = np.maximum(counted(_LETTER, begins, ends), 1)
    repeats = np.concatenate(([0], np.cumsum(again)))
    chars = np.concatenate(([0], np.cumsum(word_points)))
    mean = (chars[last] - chars[first]) / n
    final = data[words.end[last - 1] - 1] if len(last) else np.zeros(0, np.uint8)
    x = np.column_stack([
        np.minimum(1, counted(_SYMBOL, begins, ends) / n), np.minimum(1, counted(_LOUD, begins, ends) / n), counted(_UPPER, begins, ends) / letters,
        counted(_DIGIT, begins, ends) / size, (repeats[last] - repeats[first]) / n, dup, n <= 3, n >= 20, np.minimum(mean, 20) / 10,
        (final == ord(".")) | (final == ord("!")) | (final == ord("?")), np.ones(len(n)),
    ]) if len(n) else np.zeros((0, 11))
    return Lines(n_words, sums(word_points, words.first), sums(_SYMBOL[data].astype(np.int64), starts), sums(dup.astype(np.int64), bound),
                 sums(again.astype(np.int64), words.first), n, bound, x)


@dataclass
class Crf:
    """Weights of the features for content (against boilerplate) and scores of the steps between labels (0 boilerplate, 1 content)."""

    weights: np.ndarray
    step: np.ndarray


def _sequences(bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step over all sequences at once: the lines at this step, and for each the line before it."""
    size = np.diff(bound)
    order = np.argsort(-size, kind="stable")
    for k in range(int(size.max(initial=0))):
        at = bound[:-1][order[: int(np.searchsorted(-size[order], -k))]] + k
        yield at, at - 1


def viterbi(crf: Crf, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The best labels of the lines of each sequence; equal scores: content."""
    score = np.column_stack((np.zeros(len(x)), x @ crf.weights))
    back = np.zeros((len(x), 2), np.int8)
    for k, (at, before) in enumerate(_sequences(bound)):
        if k:
            into = score[before][:, :, None] + crf.step[None]
            back[at] = into[:, 1] >= into[:, 0]
            score[at] += into.max(axis=1)
    label = np.zeros(len(x), np.int8)
    steps = list(_sequences(bound))
    ends = np.zeros(len(x) + 1, bool)
    ends[bound[1:][np.diff(bound) > 0] - 1] = True
    for at, _ in reversed(steps):
        here = ends[at]
        label[at[here]] = score[at[here], 1] >= score[at[here], 0]
        label[at[~here]] = back[at[~here] + 1, label[at[~here] + 1]]
    return label


def _gradient(crf: Crf, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels and its gradient, by forward and backward sums over all sequences at once."""
    unary = np.column_stack((np.zeros(len(x)), x @ crf.weights))
    forward, backward = unary.copy(), np.zeros_like(unary)
    steps = list(_sequences(bound))
    for k, (at, before) in enumerate(steps):
        if k:
            forward[at] += np.logaddexp(forward[before, 0][:, None] + crf.step[0], forward[before, 1][:, None] + crf.step[1])
    for k in range(len(steps) - 1, 0, -1):
        at, before = steps[k]
        after = unary[at] + backward[at]
        backward[before] = np.logaddexp(crf.step[:, 0] + after[:, :1], crf.step[:, 1] + after[:, 1:])
    total = np.logaddexp(forward[:, 0] + backward[:, 0], forward[:, 1] + backward[:, 1])
    ends = bound[1:][np.diff(bound) > 0] - 1
    likely = unary[np.arange(len(y)), y].sum() - total[ends].sum()
    chance = np.exp(forward[:, 1] + backward[:, 1] - total)
    d_step = np.zeros((2, 2))
    for k, (at, before) in enumerate(steps):
        if k:
            pair = np.exp(forward[before][:, :, None] + crf.step[None] + (unary[at] + backward[at])[:, None, :] - total[at][:, None, None])
            np.add.at(d_step, (y[before], y[at]), 1)
            d_step -= pair.sum(axis=0)
            likely += crf.step[y[before], y[at]].sum()
    return likely, x.T @ (y - chance), d_step


def train(x: np.ndarray, y: np.ndarray, bound: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> Crf:
    """Gradient ascent with a step size of its own for each weight."""
    crf = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    first, second = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, rounds + 1):
        _, d_weights, d_step = _gradient(crf, x, y, bound)
        now = np.concatenate((crf.weights, crf.step.ravel()))
        g = np.concatenate((d_weights, d_step.ravel())) / max(1, len(y)) - ridge * now
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        now = now + 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
        crf = Crf(now[: x.shape[1]], now[x.shape[1]:].reshape(2, 2))
    return crf


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Crf:
    """Lines of documents of quality 1 are content, of quality 0 boilerplate; at most about ``fit_rows`` documents, chosen by hash.

    Without labels of both kinds the field is the rule "symbols, noise and repeats are boilerplate".
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, fit_rows / max(1, usable.count()))
    chosen = F.broadcast(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    found = rows.mapInArrow(_lines_of, "doc_id long, quality int, n int, x binary").orderBy("doc_id", "x").collect()
    x = np.concatenate([np.frombuffer(r["x"], np.float64).reshape(r["n"], -1) for r in found]) if found else np.zeros((0, 11))
    size = np.array([r["n"] for r in found], int)
    y = np.repeat([int(r["quality"] > 0) for r in found], size) if found else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        return Crf(np.array([-8.0, -8, -4, -2, -6, -4, 0, 1, 0, 1, 2]), np.array([[0.5, -0.5], [-0.5, 0.5]]))
    return train(x, y, np.concatenate(([0], np.cumsum(size))))


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = measure(batch.column("text"))
        cut = [found.x[a:b] for a, b in zip(found.bound[:-1], found.bound[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([len(c) for c in cut], pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())],
                                         names=["doc_id", "quality", "n", "x"])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _judge(crf: Crf, share: float, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        f = measure(batch.column("text"))
        content = sums(viterbi(crf, f.x, f.bound) * f.words, f.bound) / np.maximum(f.n_words, 1)
        failed = (f.n_words < 50) | (100 * f.n_repeat_words > 50 * f.n_words)
        columns = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(content), pa.array(~failed & (content >= share))],
                                         names=[*keep, *(c.split()[0] for c in RESULT.split(", "))])


def quality(docs: DataFrame, labels: DataFrame, keep: list[str], share: float = CONTENT_SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Columns ``keep`` of every document with its counts, base_failed, the share of words on content lines, and kept.

    A null or empty text has no words, hence fails. Repeated rows get equal results; no documents: no rows. Columns outside ``keep``
    are left out; ``keep`` may not name a result column.
    """
    crf = fit(docs, labels, fit_rows)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(lambda batches: _judge(crf, share, keep, batches), f"{kinds}, {RESULT}")
