"""Sharding and mixing."""

import math
import sys
import zlib
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fixtures import DOCS, rows  # noqa: E402

from outfall.llm.mixing import mix_schedule, mixed, tokens  # noqa: E402
from outfall.llm.sharding import histogram_shards, shard_documents, splitters  # noqa: E402


def test_shards_cover_all_rows_once(spark):
    data = rows()
    got = shard_documents(spark.createDataFrame(data, DOCS)).collect()
    expected = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in data)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_shards_are_even_although_all_rows_are_equal(spark):
    got = shard_documents(spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"))).groupBy("shard").count().collect()
    assert len(got) == 40 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 1


def test_shards_follow_the_key_and_replace_clashing_columns(spark):
    df = spark.range(500).selectExpr("id % 7 AS g", "id", "id % 13 AS size", "'old' AS shard")
    got = histogram_shards(df, F.col("size"), ["g"], ["id"], shards=5).orderBy("shard", "slot").collect()
    runs = [r["g"] for r in got]
    assert len(got) == 500 and sum(a != b for a, b in zip(runs, runs[1:], strict=False)) == 6  # equal groups are neighbours


def test_splitters_are_exact_without_tolerance(spark):
    sizes = [(f"{i * 37 % 1000:048X}", i % 11 + 1) for i in range(1000)]
    df = spark.createDataFrame(sizes, "__hs_key string, __hs_size long")
    total = sum(s for _, s in sizes)
    found = splitters(df, 8, total, 0)
    keys = sorted(sizes)
    for i, bound in enumerate(found, 1):
        below = sum(s for k, s in keys if k < bound)
        best = min(abs(sum(s for _, s in keys[:j]) - total * i / 8) for j in range(1001))
        assert abs(below - total * i / 8) == best
    assert found == sorted(found)


def test_no_rows_no_shards(spark):
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert mix_schedule(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_reaches_its_target_and_takes_everything(spark):
    data = [(i, "w " * (5 + i % 9), None, "hot" if i < 700 else f"s{i % 6}" if i % 2 else None, 0) for i in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = mix_schedule(docs, entropy=0.97, repeats=50.0, block_tokens=500).collect()
    assert {r["doc_id"] for r in got} == set(range(1000))
    by = {}
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["tokens"]
    share = [v / sum(by.values()) for v in by.values()]
    assert abs(-sum(s * math.log(s) for s in share) / math.log(len(by)) - 0.97) < 0.01
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in blocks.values())
    inside = [sum(r["tokens"] for r in got if r["block"] == b and r["source"] == "hot") / sum(r["tokens"] for r in got if r["block"] == b) for b in blocks]
    assert max(inside) - min(inside) < 0.15  # every block has the weights
    limited = mix_schedule(docs, entropy=1.0, repeats=2.0).groupBy("doc_id", "rk", "source").count().collect()
    assert {r["count"] for r in limited} <= {1, 2, 3} and max(r["count"] for r in limited) >= 2


def test_mix_passes_match_a_loop_over_the_permutation(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = mix_schedule(docs, budget=3000.0, entropy=0.9, repeats=4.0)
    units = {}
    for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "source", tokens().alias("w")).collect():
        key = (r["doc_id"], r["rk"], r["source"])
        units[key] = units.get(key, 0) + r["w"]
    plan = got.collect()
    weight = {r["source"]: r["weight"] for r in plan}
    for source, w in weight.items():
        mine = {k: t for k, t in units.items() if k[2] == source}
        total, take = sum(mine.values()), math.ceil(w * 3000.0 - 1e-6)
        expected, turn = [], 0
        hashed = {(r["doc_id"], r["rk"], r["p"]): r["h"] for r in spark.createDataFrame([(*k[:2], p) for k in mine for p in range(take // total + 2)], "doc_id long, rk long, p int").withColumn("h", F.xxhash64(F.lit(17), "p", "rk", "doc_id")).collect()}
        while turn * total < take:
            at = turn * total
            order = sorted(mine, key=lambda k: ((hashed[k[0], k[1], turn] % (1 << 64) >> 32) % (1 << 31) * 64 // (1 << 31), hashed[k[0], k[1], turn]))
            for k in order:
                if at < take:
                    expected.append((str(k[0]), k[1], turn))
                at += mine[k]
            turn += 1
        assert sorted((str(r["doc_id"]), r["rk"], r["pass"]) for r in plan if r["source"] == source) == sorted(expected)


def test_mixed_rows_are_whole_documents(spark):
    data = rows()
    docs = spark.createDataFrame(data, DOCS)
    got = mixed(docs, docs.columns).collect()
    assert {tuple(r) for r in got} == set(data) and len(got) >= len(data)
