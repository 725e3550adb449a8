"""Quality classifier as a sparse ensemble of rules (operator 11).

Statistics of every whole text are counted once and written. A random forest is grown on all labelled training rows; every path from a root of a tree to a
node becomes one conjunction of bounds on statistics. A logistic regression with a lasso penalty weighs these rules and sets most weights to zero; what is
left is compiled into one Spark column expression, which scores all documents without Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import pieces, stored
from outfall.llm.quality import repeated
from outfall.llm.words import joined, spans_hashed, split_words, sums

TREES = 24
DEPTH = 3
#: Penalty on the sum of the rules' weights.
LASSO = 1e-3
SEED = 11
#: Rows with this remainder of crc32(doc_id) modulo 4 are held out.
FOLDS, HELD_OUT = 4, 2
#: From this score a document is predicted to be of quality 1.
CUT = 0.7
STATISTICS = ("n_words", "mean_word", "longest_word", "distinct_share", "repeat_share", "symbol_share", "loud_share", "upper_share", "digit_share",
              "mark_share", "wide_share", "line_words", "short_line_share", "dup_line_share", "ended_line_share")


def _marks(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SYMBOL, _LOUD, _MARK, _END = _marks("#*$%&|<>"), _marks("!?{}[]=_~^\\/@"), _marks(".,;:"), _marks(".!?")
_UPPER, _DIGIT = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("0123456789")
_LETTER = _UPPER | _marks("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC2:0xF5] = True
_POINT = ~((np.arange(256) & 0xC0) == 0x80)


def _again(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where (doc, key) has been before."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    out = np.zeros(len(key), bool)
    out[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; all zero without words."""
    data, starts = joined(column)
    words = split_words(data, starts)
    n = np.diff(words.first)
    per = lambda table: sums(table[data].astype(np.int64), starts)
    points = np.concatenate(([0], np.cumsum(_POINT[data])))
    size = points[words.end] - points[words.start]
    chars = sums(size, words.first)
    longest = np.zeros(len(n))
    np.maximum.at(longest, words.doc, size)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    first, last = np.searchsorted(words.start, begins), np.searchsorted(words.start, ends)
    has = last > first
    begins, ends, first, last = begins[has], ends[has], first[has], last[has]
    doc = np.searchsorted(starts, begins, side="right") - 1
    bound = np.searchsorted(doc, np.arange(len(starts)))
    lines = np.diff(bound)
    line = lambda marked: sums(marked.astype(np.int64), bound) / np.maximum(lines, 1)
    some = np.maximum(n, 1)
    letters = np.maximum(per(_LETTER), 1)
    final = _END[data[words.end[last - 1] - 1]] if len(last) else np.zeros(0, bool)
    return np.column_stack([
        n, chars / some, longest, sums((~_again(words.doc, words.hash)).astype(np.int64), words.first) / some, sums(repeated(words).astype(np.int64), words.first) / some,
        per(_SYMBOL) / np.maximum(chars, 1), per(_LOUD) / np.maximum(chars, 1), per(_UPPER) / letters, per(_DIGIT) / np.maximum(chars, 1),
        per(_MARK) / some, (sums((~_POINT[data]).astype(np.int64), starts)) / np.maximum(chars, 1), n / np.maximum(lines, 1), line(last - first <= 3),
        line(_again(doc, spans_hashed(data, begins, ends))), line(final),
    ]).astype(np.float64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *STATISTICS])


@dataclass(frozen=True, order=True)
class Bound:
    """low < statistic <= high."""

    statistic: str
    low: float
    high: float

    def sql(self) -> str:
        sides = [f"{self.statistic} > {self.low!r}D"] * (self.low > -np.inf) + [f"{self.statistic} <= {self.high!r}D"] * (self.high < np.inf)
        return " AND ".join(sides)


Rule = tuple[Bound, ...]
_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def paths(tree: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """A rule for every node below the root of a printed tree; several bounds on one statistic are one interval."""
    way: list[tuple[int, str, str, float]] = []
    out = []
    for text in tree.splitlines():
        if m := _NODE.match(text):
            depth = len(m[1])
            way = [w for w in way if w[0] < depth] + [(depth, names[int(m[3])], m[4], float(m[5]))]
            box: dict[str, tuple[float, float]] = {}
            for _, name, side, value in way:
                low, high = box.get(name, (-np.inf, np.inf))
                box[name] = (low, min(high, value)) if side == "<=" else (max(low, value), high)
            out.append(tuple(sorted(Bound(name, *sides) for name, sides in box.items())))
    return out


def holds(rule: Rule) -> str:
    return f"CAST({' AND '.join(b.sql() for b in rule)} AS DOUBLE)"


@dataclass
class Model:
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """The model as a column expression over the statistics."""
        total = " + ".join([f"{self.intercept!r}D", *(f"{w!r}D * {holds(rule)}" for rule, w in self.weights.items())])
        return F.expr(f"1D / (1D + exp(-({total})))")


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> Model:
    """Rules and their weights from rows with the statistics and ``label`` (0 or 1). Labels of one kind or none: their smoothed share, without rules."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    n, ones = counts["n"], counts["ones"] or 0
    if not 0 < ones < n:
        return Model(float(np.log((ones + 1) / (n - ones + 1))), {})
    x = rows.select(array_to_vector(F.array(*STATISTICS)).alias("x"), "label", *STATISTICS)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(x)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    if not rules:
        return Model(float(np.log(ones / (n - ones))), {})
    held = x.select(array_to_vector(F.expr(f"array({', '.join(map(holds, rules))})")).alias("x"), "label")
    lines = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=100).fit(held)
    return Model(float(lines.intercept), {rule: float(w) for rule, w in zip(rules, lines.coefficients.toArray(), strict=True) if w})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS == HELD_OUT


def rule_quality(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text has no words and gets the score of that. Repeated rows get equal results; a null doc_id is never held out nor labelled. Of several
    labels of one document the smallest counts, a null label none. Without labels of both kinds the score is their smoothed share for all. No documents: no
    rows. Other columns are left out. ``options`` go to ``fit``.
    """
    found = stored(docs.select("doc_id", "text").mapInArrow(_count, ", ".join(["doc_id long", *(f"{s} double" for s in STATISTICS)])), "statistics")
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("label"))
    training = stored(found.where(~held_out(F.col("doc_id"))).join(usable, "doc_id").drop("doc_id"), "training")
    model = fit(training, **options)
    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
