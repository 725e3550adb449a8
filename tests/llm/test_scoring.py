"""Rule ensemble, centroid clustering and ranked search against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from outfall.llm import ensemble
from outfall.llm.centroids import LONGEST, MOST, cluster_vectors
from outfall.llm.ensemble import STATISTICS, Bound, Model, fit, holds, paths, rule_quality, statistics
from outfall.llm.search import Block, best_rows, masks_of, search, weight
from tests.llm.fixtures import DOCS, LOW, WORD, rows, texts

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string"


def vectors(n: int = 60) -> list[tuple]:
    rng = np.random.default_rng(5)
    found = [(i * 3, [float(np.float32(x)) for x in rng.normal(size=64) / 8], 1, "a", "b") for i in range(n)]
    found += [(1, None, 1, None, None), (2, [], 1, None, None), (4, [0.5] * 63, 1, None, None), (5, [float("nan")] * 64, 1, None, None), (7, [None] * 64, 1, None, None)]
    found += [(8, [float("inf")] + [0.0] * 63, 1, None, None), (10, [0.0] * 64, 1, None, None), (None, found[3][1], None, None, None), found[5], found[5]]
    return found + [(1000 + i, found[0][1], 2, None, None) for i in range(70)]


def clustered(found: list[tuple], k: int = 8, rounds: int = 10) -> list[tuple]:
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in found if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(x) for x in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c for j, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last]


def ordered(found: list) -> list[tuple]:
    return sorted((tuple(r) for r in found), key=repr)


def test_clusters_match_a_plain_loop(spark):
    found = vectors()
    got = cluster_vectors(spark.createDataFrame(found, VECTORS))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(clustered(found))


def test_few_vectors_and_none(spark):
    few = vectors(3)[:4]
    assert ordered(cluster_vectors(spark.createDataFrame(few, VECTORS)).collect()) == ordered(clustered(few))
    assert cluster_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    huge = [(1, [3e38] * 64, 1, None, None), (2, [-3e38] * 64, 1, None, None)]
    got = cluster_vectors(spark.createDataFrame(huge, VECTORS), n=1).collect()
    assert {r["distance"] for r in got} == {64 * MOST ** 2} and got[0]["inertia"] == min(128 * MOST ** 2, LONGEST)


def test_clusters_run_no_python(spark):
    plan = cluster_vectors(spark.createDataFrame(vectors(), VECTORS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "zip_with" in plan and "array_min" in plan


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    words = lambda text: TERM.findall((text or "").translate(LOW))
    found = [(d[0], c, sum(c.values())) for d in docs if (c := Counter(words(d[1])))]
    n, length = len(found), sum(size for *_, size in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, ts in asked.items():
        scores = [(sum(weight(n, df[t]) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // length))) for t in ts if c[t]), doc) for doc, c, size in found]
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(item, i + 1, doc, score) for i, (score, doc) in enumerate(best)]
    return out


@pytest.mark.parametrize(("top", "pass_terms"), [(50, 200_000), (3, 200_000), (1, 40)])
def test_search_matches_a_plain_loop(spark, top, pass_terms):
    docs = rows() + [(500 + i, "tie tie tie x1", None, "hot", 1, None, None, None) for i in range(40)]
    items = [(i, t) for i, t in enumerate(texts()[6:30:2])] + [(90, "TIE é"), (91, None), (92, "?! ."), (None, "word end"), (0, "tie"), (93, " ".join(f"x{i}" for i in range(200)))]
    items = [(*i, "clash") for i in items]
    got = search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string, score string"), top, pass_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(got.collect()) == ordered(ranked(docs, [i[:2] for i in items], top))


def test_search_of_nothing(spark):
    docs, none = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "the word")], "item_id long, text string")
    assert search(none, items).collect() == [] and search(docs, items.where("false")).collect() == []


def test_masks_stop_early_and_lose_nothing():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 3000, 90
    held = rng.random((n_docs, n_terms)) < rng.beta(0.4, 3, n_terms)
    term, tf = np.concatenate([np.flatnonzero(h) for h in held]), rng.integers(1, 6, held.sum())
    first = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
    block = Block(np.arange(n_docs), np.zeros(n_docs, bool), rng.integers(5, 400, n_docs), term, tf, first, rng.integers(0, 9000, n_terms), n_docs, 500_000)
    item = np.sort(rng.choice(n_terms, 70, replace=False))
    asked = np.isin(np.arange(n_terms), item)
    scores = block.score(np.arange(n_docs), asked)
    counted = []
    block.score, plain = lambda rows, asked: (counted.append(len(rows)), plain(rows, asked))[1], block.score
    found, got = best_rows(block, item, 20, 1)
    want = np.sort(scores)[::-1][:20]
    assert np.array_equal(np.sort(got)[::-1][:20], want) and np.array_equal(scores[found], got)
    assert set(np.flatnonzero(scores >= want[-1])) <= set(found.tolist())  # ties of the last place are all there
    assert sum(counted) < n_docs
    assert masks_of(5, [np.array([1, 3])] * 65)[:, 1].tolist() == [0, 1, 0, 1, 0]


TREE = """DecisionTreeClassificationModel: uid=dtc, depth=2, numNodes=5, numClasses=2, numFeatures=15
  If (feature 3 <= 0.5)
   If (feature 3 <= 0.25)
    Predict: 0.0
   Else (feature 3 > 0.25)
    Predict: 1.0
  Else (feature 3 > 0.5)
   If (feature 0 <= 1.0E-4)
    Predict: 1.0
   Else (feature 0 > 1.0E-4)
    Predict: 0.0
"""


def test_paths_of_a_tree():
    name, other = STATISTICS[3], STATISTICS[0]
    inf = math.inf
    assert paths(TREE) == [(Bound(name, -inf, 0.5),), (Bound(name, -inf, 0.25),), (Bound(name, 0.25, 0.5),), (Bound(name, 0.5, inf),),
                           tuple(sorted((Bound(name, 0.5, inf), Bound(other, -inf, 1e-4)))), tuple(sorted((Bound(name, 0.5, inf), Bound(other, 1e-4, inf))))]
    assert holds((Bound(name, 0.25, 0.5),)) == f"CAST({name} > 0.25D AND {name} <= 0.5D AS DOUBLE)"


def test_compiled_model_matches_arrays(spark):
    rng = np.random.default_rng(1)
    x = rng.random((200, len(STATISTICS)))
    rules = [r for r in paths(TREE)] + [(Bound(STATISTICS[5], 0.3, 0.8), Bound(STATISTICS[7], -math.inf, 0.6))]
    model = Model(-0.5, {r: float(w) for r, w in zip(rules, rng.normal(size=len(rules)), strict=True)})
    at = {s: i for i, s in enumerate(STATISTICS)}
    total = -0.5 + sum(w * np.all([(x[:, at[b.statistic]] > b.low) & (x[:, at[b.statistic]] <= b.high) for b in r], axis=0) for r, w in model.weights.items())
    got = spark.createDataFrame(x.tolist(), list(STATISTICS)).select(model.score().alias("s"))
    assert np.allclose([r["s"] for r in got.collect()], 1 / (1 + np.exp(-total)))


def test_statistics_of_plain_texts():
    found = [None, "", "A bb a bb A bb", "one two three.\none two three.\n\nx#$ 12 é!"]
    x = dict(zip(STATISTICS, statistics(pa.array(found)).T, strict=True))
    assert x["n_words"].tolist() == [0, 0, 6, 9] and x["longest_word"].tolist() == [0, 0, 2, 6]
    assert x["distinct_share"].tolist() == [0, 0, 3 / 6, 6 / 9] and x["dup_line_share"].tolist() == [0, 0, 0, 1 / 3]
    assert x["symbol_share"][3] == 2 / sum(map(len, WORD.findall(found[3]))) and x["ended_line_share"].tolist() == [0, 0, 0, 1]
    assert x["short_line_share"].tolist() == [0, 0, 0, 1] and x["line_words"].tolist() == [0, 0, 6, 3]


def test_lasso_leaves_few_rules(spark):
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(STATISTICS)))
    label = ((x[:, 4] <= 0.6) & (x[:, 5] > 0.2)).astype(float)
    frame = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, label, strict=True)], [*STATISTICS, "label"])
    model = fit(frame, trees=8)
    score = np.array([r["s"] for r in frame.select(model.score().alias("s")).collect()])
    assert 0 < len(model.weights) < 60 and ((score >= 0.5) == (label > 0)).mean() > 0.97


def test_held_out_accuracy_and_awkward_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "no id"), (-3, "x " * 50_000), (-3, "x " * 50_000)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True).withColumn("n_words", docs.text)
    more = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (4, None), (0, 1)], "doc_id long, quality int"))
    got = rule_quality(both, more, trees=8)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == docs.count() + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= ensemble.CUT) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == -3}) == 1 and not any(r["held_out"] for r in found if r["doc_id"] is None)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(known[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 50 and sum(y == p for y, p in held) / len(held) > 0.95


def test_no_labels_give_one_score(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rule_quality(docs, none).collect()} == {0.5}
    assert rule_quality(docs.where("false"), none).collect() == []
