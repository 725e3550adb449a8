"""Near-duplicate vectors, the n-gram join, line dedup, components and the pipeline."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fixtures import DOCS, LOW, WORD, rows, sentence  # noqa: E402

import corpus_pipeline  # noqa: E402
from outfall.llm import jaccard, lattice, lines  # noqa: E402
from outfall.llm.common import components, stored  # noqa: E402
from outfall.llm.words import joined, shingles, split_words  # noqa: E402


def closure(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (200, 201)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_shingles_are_those_of_the_pattern():
    some = [None, "", " \t", "A b\x0bc", "é　x y", "one two three four five six", "one two three four five", "z" * 5000 + " " + "q w " * 3000]
    data, starts = joined(pa.array(some).slice(0))
    w = split_words(data, starts, lower=True, piece=64)
    assert [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in some for x in WORD.findall(t or "")]
    names = [x.translate(LOW) for t in some for x in WORD.findall(t or "")]
    assert len(set(w.hash.tolist())) == len(set(names)) and len(set(zip(names, w.hash.tolist(), strict=True))) == len(set(names))
    flat, bound = shingles(w, 5)
    sets = []
    for t in some:
        x = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(x[i:i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set())
    assert np.diff(bound).tolist() == list(map(len, sets))
    assert len(set(flat.tolist())) == len(set().union(*sets))


def test_lattice_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(500, 8)) * 3
    p = lattice.decode(y)
    own = ((y - p / 2) ** 2).sum(axis=1)
    near = ((y[:, None] - (p[:, None] + lattice._AROUND[None]) / 2) ** 2).sum(axis=2).min(axis=1)
    assert np.all(own <= near + 1e-9) and lattice._AROUND.shape == (240, 8)


def test_links_of_vectors(spark):
    rng = np.random.default_rng(5)
    center = rng.normal(size=(6, 32))
    data = [(i * 3 % 1001, (center[i % 6] + rng.normal(size=32) * (0.2 if i % 2 else 0.3)).tolist()) for i in range(400)]
    data += [(2000 + i, rng.normal(size=32).tolist()) for i in range(60)]
    data += [(3000, data[5][1]), (3001, data[5][1]), (3002, [2 * x for x in data[5][1]]), (3003, None), (3004, []), (3005, [0.0] * 32), (3006, [float("nan")] + [1.0] * 31), (3007, [None] + [1.0] * 31),
             (3008, [float("inf")] + [1.0] * 31), (3009, [1.0, 2.0]), (3010, [1.0, 2.0]), (None, data[5][1]), (data[7][0], data[7][1])]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in data], "vec_id long, embedding array<double>, node int, n int, cell string")
    got = lattice.link_vectors(df).collect()
    good = [i for i, (_, v) in enumerate(data) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(data[i][1]) / np.linalg.norm(data[i][1]) for i in good}
    links = [(a, b) for n, a in enumerate(good) for b in good[:n] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    degree = np.bincount(np.array(links).ravel(), minlength=len(data))
    root = closure(len(data), links)
    least = {}
    for i, (v, _) in enumerate(data):
        if v is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), v)
    expected = sorted((str(v), int(degree[i]), least.get(root[i])) for i, (v, _) in enumerate(data))
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.link_vectors(df.limit(0)).count() == 0


def test_blocks_meet_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 7)
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    df = spark.createDataFrame([(i, (base + rng.normal(size=16) * 0.05).tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in lattice.link_vectors(df).collect()} == {(89, 0)}


def brute_sets(data):
    sets = []
    for t in data:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def near_copies(seed=2):
    """Groups around a base, with edits near and beyond the threshold, and documents that only share passages."""
    rng = random.Random(seed)
    passage, out = sentence(rng, 60), []
    for g in range(8):
        base = sentence(rng, rng.randint(40, 160)).split(" ")
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(w[rng.randint(0, 6):] if k % 3 else w))
    out += [f"{sentence(rng, 30)} {passage} {sentence(rng, rng.randint(5, 60))}" for _ in range(40)] + [passage] * 3
    return out


def test_similar_components_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    data = rows() + [(1000 + i, t, None, None, None, None, None, None) for i, t in enumerate(near_copies())]
    got = jaccard.similar_components(spark.createDataFrame(data, DOCS)).collect()
    sets = brute_sets([d[1] for d in data])
    links = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = closure(len(data), links)
    least = {}
    for i, d in enumerate(data):
        if d[0] is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), d[0])
    expected = sorted((str(d[0]), len(sets[i]), str(least.get(root[i]))) for i, d in enumerate(data))
    assert len(links) > 200 and sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected


def test_similar_sets_share_what_is_needed(spark):
    for n in range(1, 400):
        for m in range(-(-n * 75 // 100), n + 1):
            share = -(-75 * (n + m) // 175)  # smallest overlap of a link
            while 100 * share < 75 * (n + m - share):
                share += 1
            if share <= m:
                common = share - (n - int(jaccard.first_count(np.array([n]))[0]))  # at least so many of them are among n's first
                del common
                lead = max(1, m * jaccard.LEAD // 100)
                assert min(n, n - share + lead) <= jaccard.first_count(np.array([n]))[0] and min(m, m - share + lead) <= jaccard.first_count(np.array([m]))[0]
    need = {r["n"]: r["k"] for r in spark.range(1, 400).withColumnRenamed("id", "n").withColumn("k", F.expr(jaccard.needed("n"))).collect()}
    assert all(need[n] == max(1, -(-n * 75 // 100) * jaccard.LEAD // 100) for n in need)


def test_one_of_each_group_stays(spark):
    data = rows() + [(1000 + i, t, None, None, None, None, None, None) for i, t in enumerate(near_copies(4))]
    docs = spark.createDataFrame(data, DOCS)
    kept = jaccard.keep_one(docs).collect()
    assert {tuple(r) for r in kept} <= set(data) and len({tuple(r) for r in kept}) == len(kept)
    again = jaccard.similar_components(stored(spark.createDataFrame(kept, DOCS), "kept")).where("comp IS NOT NULL")
    assert again.count() == again.select("comp").distinct().count()
    whole = jaccard.similar_components(docs)
    assert again.count() == whole.where("comp IS NOT NULL").select("comp").distinct().count()
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def kept_lines(data):
    """By the definition: lines in the order of documents; a line goes if any earlier line equals it or is one word away."""
    order = sorted({(d[0], d[1]) for d in data if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = [], {}
    for doc, text in order:
        left, gone = [], 0
        for line in text.split("\n"):
            w = WORD.findall(line.translate(LOW))
            if w and any(w == o or max(len(w), len(o)) >= 10 and min(len(w), len(o)) >= 10 and lines.within_one(w, o) for o in seen):
                gone += 1
            else:
                left.append(line)
            if w:
                seen.append(w)
        out[doc, text] = ("\n".join(left), gone)
    return out


def test_lines_match_all_pairs(spark):
    data = [d for d in rows(6) if d[0] is not None]  # the order of null ids is that of a hash
    rng = random.Random(1)
    base = sentence(rng, 14).split(" ")
    for i in range(60):
        w = list(base)
        kind = rng.randrange(4)
        at = rng.randrange(len(w))
        if kind == 0:
            w[at] = f"x{i}"
        elif kind == 1:
            del w[at]
        elif kind == 2:
            w.insert(at, f"y{i % 3}")
        data.append((5000 - i, "\n".join([" ".join(w), "", sentence(rng, 3), " ".join(base[:9])]), None, None, None, None, None, None))
    got = lines.dedup_lines(spark.createDataFrame(data, DOCS), ["doc_id", "text", "h"]).collect()
    expected = kept_lines(data)
    assert sorted((r["doc_id"], r["text"], r["n_removed"], r["h"]) for r in got if r["text"] is not None) == sorted((d[0], *expected[d[0], d[1]], d[6]) for d in data if d[1] is not None)
    assert sum(r["text"] is None for r in got) == sum(d[1] is None for d in data)


def test_lines_of_null_ids_come_last(spark):
    line = "The very same line that is long enough to be a line."
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame([(None, line), (4, line + "\n" + line), (9, line)], "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {None: 1, 4: 1, 9: 1}
    assert lines.line_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_within_one_word():
    assert lines.within_one("a b c".split(), "a b c".split()) and lines.within_one("a b c".split(), "a x c".split()) and lines.within_one("a b c".split(), "a c".split()) and lines.within_one("a c".split(), "a b c".split())
    assert not lines.within_one("a b c".split(), "a c b".split()) and not lines.within_one("a b c d".split(), "a b".split()) and not lines.within_one("a b c".split(), "x b y".split())


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    clean = [(i, "\n".join(sentence(rng, 30) for _ in range(4)), "en", "hot" if i < 40 else f"s{i % 3}", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}$$$" for w in sentence(rng, 80).split()), "en", "hot", 0) for i in range(20)] + [(200, None, None, None, None), (201, "", "en", None, 0), (202, "same " * 90, "en", "hot", 0)]
    copies = [(300 + i, clean[i][1], "en", "s1", 0) for i in range(5)]
    docs = [(*d, "kept", 1) for d in clean + junk + copies]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, h int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] < 100), 0) for d in clean[::2] + junk[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stored(stage(spark, now, str(tmp_path)), "stage")
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
        if n < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    assert seen[0] == {d[0] for d in clean + copies}
    assert seen[1] == seen[2] == seen[3] == seen[4] == {d[0] for d in clean}
    assert now.where("n_tokens < 100").count() == 0
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()} == {tuple(r) for r in now.select("doc_id", "n_tokens").collect()}


def test_asking_classes_are_dealt_into_parts(spark):
    asking = spark.range(2000).selectExpr("id AS sig", "7L AS g", "id AS comp", "3 AS blocks")
    placed = spark.range(5000, 5150).selectExpr("id AS sig", "7L AS g", "id AS comp")
    met = jaccard.openings(asking, placed, spark.createDataFrame([(7, 3)], "g long, blocks int")).collect()
    frames = {}
    for r in met:
        frames.setdefault((r["g"], r["block"], r["part"]), ([], []))[r["member"]].append(r["sig"])
    assert max(len(q) for q, _ in frames.values()) < 2 * jaccard.PART and max(len(m) for _, m in frames.values()) < 2 * jaccard.BLOCK
    pairs = [(q, m) for qs, ms in frames.values() for q in qs for m in ms]
    assert len(pairs) == len(set(pairs)) == 2000 * 150


def test_only_sets_that_can_need_another_group_meet_others(spark):
    rng = random.Random(8)
    kept = []
    for sig in range(120):
        n, g = rng.choice((4, 60, 200)), sig % 5
        kept += [(t, sig, g, n) for t in {rng.randrange(100 * g, 100 * g + 100) for _ in range(30)} | {rng.randrange(1000, 1020) for _ in range(sig % 25)}]
    need = {n: max(1, -(-n * 75 // 100) * jaccard.LEAD // 100) for n in (4, 60, 200)}
    groups, of, size = {}, {}, {}
    for t, sig, g, n in kept:
        groups.setdefault(t, set()).add(g)
        of.setdefault(sig, set()).add(t)
        size[sig] = (n, g)
    expected = {(s, g) for s in of for g in range(5) if g != size[s][1] and sum(g in groups[t] for t in of[s]) >= need[size[s][0]]}
    across = jaccard.shared_across(spark.createDataFrame(kept, "token long, sig long, g long, n int")).localCheckpoint()
    assert {(r["token"], r["sig"]) for r in across.collect()} == {(t, s) for t, s, _, _ in kept if len(groups[t]) > 1}
    asking = jaccard.able(across)
    met = asking.join(across.select("token", F.col("g").alias("other")).distinct(), "token").where("g <> other").groupBy("sig", "other").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    assert {(r["sig"], r["other"]) for r in met.where(f"c >= {jaccard.needed('n')}").collect()} == expected
    left = {r["sig"] for r in asking.collect()}
    assert left == {s for s in of if sum(len(groups[t]) > 1 for t in of[s]) >= need[size[s][0]]} and len(left) < len({s for t, s, _, _ in kept if len(groups[t]) > 1})


def test_tokens_of_the_same_groups_meet_other_groups_once(spark):
    rng = random.Random(9)
    kept = []
    for sig in range(300):
        n, g = rng.choice((4, 60, 200, 400)), sig % 20
        shared = {t for p in range(sig % 4) for t in range(1000 * p, 1000 * p + 60)}  # passages of many groups
        pair = {5000 + 100 * (g // 2) + t for t in rng.sample(range(100), 50)} if sig % 3 else set()  # of two groups
        kept += [(t, sig, g, n) for t in shared | pair | {100_000 + 100 * g + t for t in range(10)}]
    groups, of, size = {}, {}, {}
    for t, sig, g, n in kept:
        groups.setdefault(t, set()).add(g)
        of.setdefault(sig, set()).add(t)
        size[sig] = (n, g)
    need = {n: max(1, -(-n * 75 // 100) * jaccard.LEAD // 100) for n in (4, 60, 200, 400)}
    expected = {(s, g) for s in of for g in range(20) if g != size[s][1] and sum(g in groups[t] for t in of[s]) >= need[size[s][0]]}
    held, lead = jaccard.by_mark(jaccard.shared_across(spark.createDataFrame(kept, "token long, sig long, g long, n int")))
    got = {(r["sig"], r["g"]) for r in jaccard.candidates(jaccard.able(held, "sum(w)"), lead).collect()}
    assert expected <= got and len(got) < 1.2 * len(expected)
    assert {r["sig"]: r["w"] for r in held.groupBy("sig").agg(F.sum("w").alias("w")).collect()} == {s: w for s in of if (w := sum(len(groups[t]) > 1 for t in of[s]))}
    met = held.join(lead, ["k", "x", "y"]).where("g <> other").count()
    assert 20 * met < sum(len(groups[t]) - 1 for t, *_ in kept)  # by token


def test_copies_whose_frequent_tokens_end_anywhere_gather_in_few_groups(spark):
    rng = random.Random(10)
    shared = [(t, sig, jaccard.MANY) for sig in range(300) for t in range(1, 60 + rng.randrange(60)) if rng.random() < 0.9]
    least = spark.range(300).selectExpr("id AS sig", "id AS doc_id", "id AS rk", "400L AS n")
    told = jaccard.grouped(spark.createDataFrame([*shared, (1000, 7, jaccard.MANY)], "token long, sig long, df int"), least)
    assert {(r["token"], r["sig"]) for r in told.select("token", "sig").collect()} == {(t, s) for t, s, _ in shared}  # one that a single set holds leads nowhere
    assert told.select("g").distinct().count() < 8 and told.select("sig", "g").distinct().count() == 300


def test_of_two_groups_the_smaller_asks(spark):
    rng = random.Random(11)
    met = []
    for many in (100, 500):
        # a family: one large group, and as many copies that stand alone as it has sets in ten
        size = {sig: (400, 0 if sig < many else sig) for sig in range(many + many // 10)}
        kept = [(t, sig, g, n) for sig, (n, g) in size.items() for t in range(150) if rng.random() < 0.9]
        kept += [(t, 5000 + i, 6000 + i, n) for i, n in enumerate((100, 300, 533, 534, 2000)) for t in range(150)]  # one group of each size
        size |= {5000 + i: (n, 6000 + i) for i, n in enumerate((100, 300, 533, 534, 2000))}
        frame = spark.createDataFrame(kept, "token long, sig long, g long, n int")
        sizes = jaccard.extents(frame.select("sig", "g", "n").distinct())
        held, lead = jaccard.by_mark(jaccard.shared_across(frame))
        got = {(r["sig"], r["g"]) for r in jaccard.candidates(jaccard.able(held, "sum(w)"), lead, sizes).collect()}
        room = {g: sum(x == g for _, x in size.values()) for _, g in size.values()}
        near = lambda n, m: 100 * min(n, m) >= 75 * max(n, m)
        expected = {(s, h) for s, (n, g) in size.items() for m, h in set(size.values()) if (room[h], h) > (room[g], g) and near(n, m)}
        assert got == expected
        met.append(len([s for s, _ in got if s < many]))
    assert met == [0, 0]  # by either side, before: as many as the large group has sets, for each small one


def test_rows_that_are_asked_for_pass_the_bit_table(spark):
    rows = spark.range(20000).selectExpr("xxhash64(id) AS rk", "id")
    asked = rows.where("id % 50 = 0")
    left = {r["id"] for r in jaccard.maybe(rows, asked.select("rk")).collect()}
    assert {i for i in range(0, 20000, 50)} <= left and len(left) < 3000
    assert jaccard.maybe(rows, asked.where("id < 0")).count() == 0


def test_rows_of_one_key_are_one_class(spark):
    data = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f g h"), (7, "x y z u v w a b c"), (9, "x y z u v w a b c"), (9, None), (None, "x y z u v w a b c d")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similar_components(docs).collect())
    sets = brute_sets([t for _, t in data])
    links = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = closure(len(data), links)
    least = {r: min(d[0] for i, d in enumerate(data) if root[i] == r and d[0] is not None) for r in set(root) if any(root[i] == r and d[0] is not None for i, d in enumerate(data))}
    assert got == sorted((str(d), len(sets[i]), str(least.get(root[i]))) for i, (d, _) in enumerate(data))
