"""Chat formatting, SentencePiece, toxicity, quality and page extraction."""

import collections
import hashlib
import html
import random
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fixtures import DOCS, LOW, WORD, rows, texts  # noqa: E402

from outfall.llm import chat, pages, pieces, quality, toxicity  # noqa: E402
from outfall.llm.words import joined  # noqa: E402


def test_escape_is_reversible():
    rng = random.Random(5)
    bits = [*chat.MARKS, "\\", "[", "<", "/INST]", "s>", "x", "\\\\", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(m in chat.escape(text) for m in chat.MARKS)


def test_conversations_are_read_back(spark, monkeypatch):
    data = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None), (2, None, "system", "sys [INST]"), (None, 3, None, "who"), (None, 1, "tool[/ROLE]", "😀\\"),
            (3, 0, "assistant", "x" * 20_000), (3, 1, "assistant", "y " * 90_000), (4, 1, "user", "q"), (4, 1, "assistant", "p")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in data], "conv_id long, turn long, role string, text string, ids string, chunk int")
    got = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    said = "</s>[INST] ok [/INST]"
    groups = collections.defaultdict(list)
    for c, t, r, x in data + [(-1, 0, "user", said), (-1, 1, "assistant", said)]:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        learned = "".join(x for _, r, x in g if r == "assistant")
        assert got[c]["n_turns"] == len(g) and got[c]["same_text"]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_turns_leave_the_extra_conversation(spark):
    assert [r["conv_id"] for r in chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-1]


@pytest.fixture(scope="module")
def raw():
    return Path(pieces.MODEL).read_bytes()


def test_best_paths_match_the_library_as_a_unigram_model(raw):
    import sentencepiece

    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at + 9] + b"\x01" + raw[at + 10:])
    v = pieces.vocabulary(raw)
    known = [" ".join(WORD.findall(t))[:1500] for t in texts() if t and t.isascii()]
    flat, bound = pieces.encode_texts(v, known)
    for i, ids in enumerate(library.encode(known, num_threads=1)):
        assert flat[bound[i]:bound[i + 1]].tolist() == ids


def test_every_text_is_restored(raw):
    v = pieces.vocabulary(raw)
    some = [t for t in texts() if t] + [" lead", "tail ", "a\x00b", "▁x"]
    flat, bound = pieces.encode_texts(v, some)
    assert pieces.decode_texts(v, flat, bound) == [t.replace("▁", " ") for t in some]


def test_chunks_of_any_size_give_the_same_tokens(raw):
    v, rng = pieces.vocabulary(raw), random.Random(8)
    for n in range(60):
        text = "".join(rng.choice("aabcdeth é" if n % 2 else "aaab") for _ in range(rng.randint(1, 200)))
        chunk = rng.choice((1, 2, 3, 7, 16, 40))
        whole = f"▁{text}".replace(" ", "▁")
        many = -(-len(whole) // chunk)
        cut = [pieces.Stretch.of(v, whole[k * chunk:(k + 1) * chunk + v.longest - 1], min(chunk, len(whole) - k * chunk)) for k in range(many)]
        scan = pieces._combine(v.longest)(pd.DataFrame({"row": [0] * many, "k": range(many), "matrix": [pieces.transfer(v, s).tobytes() for s in cut]}))
        found = [(0, k, *f) for k, s in enumerate(cut) for f in pieces.paths(v, s, np.frombuffer(scan.entering[k], np.int64), scan.exits[k])]
        assert pieces._chained(pd.DataFrame(found, columns=["row", "k", "leave", "enter", "ids"])).ids[0].tolist() == pieces.encode_texts(v, [text])[0].tolist()


def test_encoding_in_spark(spark, raw):
    docs = spark.createDataFrame(rows(), DOCS)
    v = pieces.vocabulary(raw)
    flat, bound = pieces.encode_texts(v, [r[1] or "" for r in rows()])
    expected = sorted((str(r[0]), flat[bound[i]:bound[i + 1]].tolist()) for i, r in enumerate(rows()))
    got = pieces.encode(docs, ["doc_id", "h"], chunk=5000).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == expected
    assert all(r["restored"] for r in pieces.token_digest(docs).collect())
    assert pieces.encode(docs.limit(0), ["doc_id"]).count() == 0


def test_merges_match_the_library(spark, raw):
    import sentencepiece

    library, v, rng = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.vocabulary(raw), random.Random(9)
    some = [t for t in texts() if t] + [" lead", "tail ", "a\x00b", "▁x", "the world has unemployment", "   ", "x" * 300, "=" * 70 + "ab" * 400, "no   three\t\n    four"]
    some += ["".join(rng.choice("aabcdeth é\n梦" if n % 2 else "aaab  ") for _ in range(rng.randint(1, 200))) for n in range(200)]
    expected = library.encode(some, num_threads=1)
    flat, bound = pieces.merge_texts(v, [pieces.marked(t) for t in some])
    for i, ids in enumerate(expected):
        assert flat[bound[i]:bound[i + 1]].tolist() == ids, some[i]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in pieces.encode_merges(docs, ["doc_id"], chunk=150).collect()} == dict(enumerate(expected))
    assert {r["doc_id"]: r["ids_sha256"] for r in pieces.token_digest(docs).collect()} == {i: hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for i, ids in enumerate(expected)}


def scanned(v, text, chunk):
    whole = pieces.marked(text)
    at = [(a, min(a + chunk, len(whole)), min(a, v.longest)) for a in range(0, len(whole), chunk)]
    cut = [pieces.Part.of(v, whole[a - left:b + v.longest - 1], left, b - a) for a, b, left in at]
    made = [pieces.transfer_merges(v, s) for s in cut]
    frame = pd.DataFrame({"row": 0, "k": range(len(cut)), "into": [m[0] for m in made], "out": [m[1] for m in made], "cells": [m[2].tobytes() for m in made]})
    top = pieces._product((0, 0), frame)
    cells = np.frombuffer(top.cells[0], np.int64)
    assert (cells == 0).sum() == 1  # one path leads through the whole text
    given = pieces._handed_down(frame.assign(enter=0, leave=int(top.out[0][cells.argmax()])))
    return np.concatenate([pieces.trace_merges(v, s, a, b) for s, a, b in zip(cut, given.enter, given.leave, strict=True)]).tolist()


def test_transfer_matrices_of_merges_give_the_library_s_ids(raw):
    import sentencepiece

    library, v, rng = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.vocabulary(raw), random.Random(3)
    kinds = ["aabcdeth é\n梦", "aaab  ", "=-_ ab", "▁▁ x", "the and ing er", "你好 我们在的中文字", "абвгд ежик", "\x00\x01é\u0301👍🏽 ", " ", "x"]
    for n in range(30):
        text = "".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randint(1, 120)))
        for chunk in ((1, 64), (3,), (7, 16))[n % 3]:
            assert scanned(v, text, chunk) == library.encode(text), (text, chunk)


def test_every_step_of_the_library_is_allowed_and_no_other(raw):
    import sentencepiece

    library, v = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.vocabulary(raw)
    for word in ("unemployment", "internationalization", "x" * 30, "straße", "梦想"):
        cp = pieces.points("▁" + word)
        allowed = pieces.steps(v, cp, len(cp))
        paths = {0: [[(0, v.longest + 1)]]}
        for end in range(1, len(cp) + 1):  # all paths of allowed steps, by brute force
            paths[end] = [p + [(end, size)] for size in range(1, min(end, v.longest) + 1) for p in paths[end - size] if allowed[end - size, p[-1][1], size]]
            assert len(paths[end]) == 1
        ids = pieces._ids(v, cp, [(e - n, e) for e, n in paths[len(cp)][0][1:]])
        assert ids.tolist() == library.encode(word)


def test_one_giant_word_over_many_chunks_and_levels(spark, raw, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "FAN", 4)
    library, rng = sentencepiece.SentencePieceProcessor(model_proto=raw), random.Random(5)
    giant = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))  # 40 chunks, three levels
    some = [giant, giant[:5001] + " two words " + giant[7:12_000], "é" * 6000, " " * 5000, "short", None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)] + [(1, some[1], "x")], "doc_id long, text string, ids string")
    got = pieces.encode_merges(docs, ["doc_id", "text"], chunk=5000).collect()
    assert len(got) == len(some) + 1
    for r in got:
        assert r["ids"] == library.encode(some[r["doc_id"]] or "") and r["text"] == (some[r["doc_id"]] or "")


def _counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_quality_counts_are_exact(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels, ["doc_id", "text"]).collect()
    assert len(got) == len(rows())
    for r in got:
        n, *rest = _counts(r["text"])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [n, *rest]
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality.quality(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_viterbi_and_gradient_match_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    crf = quality.Crf(rng.normal(size=3), rng.normal(size=(2, 2)))
    size = [4, 0, 1, 6]
    bound = np.concatenate(([0], np.cumsum(size)))
    x = rng.normal(size=(sum(size), 3))
    y = rng.integers(0, 2, len(x))
    score = lambda a, b, labels, c=crf: sum(labels[i] * (x[a + i] @ c.weights) for i in range(b - a)) + sum(c.step[p, q] for p, q in zip(labels, labels[1:], strict=False))
    got = quality.viterbi(crf, x, bound)

    def likely(c):
        return sum(score(a, b, y[a:b].tolist(), c) - np.log(sum(np.exp(score(a, b, s, c)) for s in product((0, 1), repeat=int(b - a)))) for a, b in zip(bound, bound[1:], strict=False) if b > a)

    for a, b in zip(bound, bound[1:], strict=False):
        if b > a:
            assert tuple(got[a:b]) == max(product((0, 1), repeat=int(b - a)), key=lambda s, a=a, b=b: score(a, b, s))
    value, d_weights, d_step = quality._gradient(crf, x, y, bound)
    assert abs(value - likely(crf)) < 1e-9
    for k in range(3):
        w = crf.weights.copy()
        w[k] += 1e-6
        assert abs((likely(quality.Crf(w, crf.step)) - value) / 1e-6 - d_weights[k]) < 1e-4
    for i, j in product((0, 1), repeat=2):
        s = crf.step.copy()
        s[i, j] += 1e-6
        assert abs((likely(quality.Crf(crf.weights, s)) - value) / 1e-6 - d_step[i, j]) < 1e-4


def _train_rows(spark, n=400):
    rng = random.Random(4)
    plain = ["thing", "over", "other", "person", "water", "answer", "under", "there", "weather"]
    data = [(i, " ".join(rng.choice(plain) for _ in range(rng.randint(20, 60))) + (" vile" + rng.choice(("er", "ly", "st", "ness")) if i % 5 == 0 else "")) for i in range(n)]
    data += [(n, None), (n + 1, ""), (None, "vileness there"), (n + 2, "water " * 20_000 + "vilely"), (0, data[0][1])]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(n)] + [(None, 1, 1), (3, None, None), (0, 1, 1)]
    return (spark.createDataFrame([(*d, "e") for d in data], "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows(spark):
    import zlib

    docs, labels = _train_rows(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        toxic = r["doc_id"] is None or r["doc_id"] == 402 or r["doc_id"] < 400 and r["doc_id"] % 5 == 0
        assert r["predicted"] == int(toxic), r
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_counts_are_of_all_rows_whatever_the_curve_is_fitted_on(spark):
    docs, labels = _train_rows(spark)
    ratios = [{(r["doc_id"], r["mean_log_ratio"], r["largest_log_ratio"]) for r in toxicity.toxicity(docs, labels, n).collect()} for n in (60, 20_000)]
    assert ratios[0] == ratios[1]


def test_scores_are_the_same_by_held_ratios_and_by_joins(spark):
    docs, labels = _train_rows(spark)
    every = [{(r["doc_id"], r["held_out"], round(r["score"], 9), round(r["mean_log_ratio"], 9), round(r["largest_log_ratio"], 9)) for r in toxicity.toxicity(docs, labels, held=n).collect()} for n in (0, toxicity.HELD)]
    assert every[0] == every[1] and len(every[0]) == docs.distinct().count()


def test_texts_are_not_shuffled_to_few_labels(spark):
    docs, labels = _train_rows(spark)
    usable, was = toxicity.usable_labels(labels).localCheckpoint(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few, many = toxicity.labelled(docs, usable), toxicity.labelled(docs, usable, 10)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
        assert ["Exchange hashpartitioning" in p for p in plans] == [False, True]
        assert few.count() == docs.count() and few.exceptAll(many).count() == many.exceptAll(few).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_task_hands_on_each_type_once(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 200)
    some = [t for t in texts() if t]
    kinds = [i % 5 - 1 for i in range(len(some))]
    batches = [pa.RecordBatch.from_arrays([pa.array(some[i::3]), pa.array(kinds[i::3], pa.int32())], names=["text", "kind"]) for i in range(3)]
    expected = collections.defaultdict(lambda: [0] * toxicity.KINDS)
    for text, kind in zip(some, kinds, strict=True):
        for word in WORD.findall(text.translate(LOW)):
            raw = bytes(toxicity.ORDER - 1) + word.encode() + bytes([toxicity.END])
            for i in range(toxicity.ORDER, len(raw) + 1):
                n = expected[int.from_bytes(raw[i - toxicity.ORDER:i], "big")]
                if kind >= 0:
                    n[kind] += 1
    out = list(toxicity._counted(iter(batches)))
    got = [(r["gram"], [r[f"n{k}"] for k in range(toxicity.KINDS)]) for b in out for r in b.to_pylist()]
    assert len(out) == 1 and len(got) == len(expected) and dict(got) == dict(expected)
    monkeypatch.setattr(toxicity, "GATHERED", 100)  # more types than a task gathers: parts, with the same sums
    out, total = list(toxicity._counted(iter(batches))), collections.defaultdict(lambda: [0] * toxicity.KINDS)
    for r in (r for b in out for r in b.to_pylist()):
        total[r["gram"]] = [x + r[f"n{k}"] for k, x in enumerate(total[r["gram"]])]
    assert len(out) > 1 and dict(total) == dict(expected)


def test_joining_texts_takes_no_index_by_byte():
    import tracemalloc

    some = pa.array([None, "", "é"] + ["word " * 100_000] * 8 + ["end"]).slice(1)
    tracemalloc.start()
    data, starts = joined(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = [(t or "") + "\n" for t in some.to_pylist()]
    assert data.tobytes() == "".join(plain).encode() and starts.tolist() == [0, *np.cumsum([len(t.encode()) for t in plain]).tolist()]
    assert joined(pa.array([None, "a"]))[1].tolist() == [0, 1, 3]
    assert peak < 4 * len(data)


def test_ratios_match_the_arrays(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(300)]
    size = np.array([len(w) for w in words])
    gram = np.unique(toxicity.grams(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(size) - size, size))
    n = rng.integers(0, 4, (len(gram), 4)) * (rng.random((len(gram), 1)) < 0.7)  # types without a label have no counts
    counts = spark.createDataFrame([(g, *r) for g, r in zip(gram.tolist(), n.tolist(), strict=True)], "gram long, " + ", ".join(f"n{k} long" for k in range(4)))
    got = {r["gram"]: r for r in toxicity.ratio_table(counts).collect()}
    assert len(got) == len(gram)
    for m, some in enumerate(([0], [0, 2])):
        model = toxicity.fit(gram, n[:, [k + 1 for k in some]].sum(axis=1).astype(float), n[:, some].sum(axis=1).astype(float))
        assert np.allclose([got[g][f"r{m}"] for g in gram.tolist()], model.gram_ratio)


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(200)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w) for w in words])
    gram, n = np.unique(toxicity.grams(data, np.cumsum(size) - size, size), return_counts=True)
    below = dict(zip(gram.tolist(), toxicity.shared_backoff(gram), strict=True))
    assert all(0 < p <= 1 for p in below.values())
    # Over all bytes after a context the shared model sums to one, by plain counts: what the seen bytes leave is the weight of the shorter context.
    order = toxicity.ORDER - 1
    types = {k: {g & ((1 << 8 * k) - 1) for g in gram.tolist()} for k in range(1, toxicity.ORDER + 1)}

    def chance(context: int, byte: int, k: int) -> float:
        if not k:
            return 1 / 256
        after = {}
        for g in types[k + 1]:
            if (g & ((1 << 8 * k) - 1)) >> 8 == context:
                after[g & 255] = after.get(g & 255, 0) + 1
        shorter = chance(context & ((1 << 8 * max(0, k - 2)) - 1), byte, k - 1)
        total = sum(after.values())
        return (max(after.get(byte, 0) - 0.75, 0) + 0.75 * len(after) * shorter) / total if total else shorter

    for g in gram.tolist()[::97]:
        context = (g >> 8) & ((1 << 8 * (order - 1)) - 1)
        assert np.isclose(chance(context, g & 255, order), below[g])
        assert np.isclose(sum(chance(context, b, order) for b in range(256)), 1)
    model = toxicity.fit(gram, n.astype(float), n.astype(float))
    assert np.allclose(model.gram_ratio, 0) and np.allclose(model.context_ratio, 0)


CASES = [
    ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>A<li>B</ul></nav><article><h1>Head</h1><p>One &amp; two<br>three <b>bo</b>ld<p>Four &lt;x&gt; 5 < 6</article><footer>End</footer></body></html>",
     "Head One & two three bold Four <x> 5 < 6"),
    ("<body><div class='cookie-notice'>We use cookies</div><main><p>Text that is here, a whole sentence.</p><aside class=\"related\"><a href='/x'>More of this</a></aside><p>And another one that follows.</p></main>"
     "<section class=comments><p>I liked this, and I say so at length.</p></section><form><label>Mail</label></form>", "Text that is here, a whole sentence. And another one that follows."),
]


@pytest.fixture(scope="module")
def labeller():
    page = CASES[0][0]
    sample = [pages.blocks(page.replace("One", w).replace("Four", f"{w} and a longer sentence, with words.")) for w in ("Some", "Other", "Words", "Here", "There", "Over", "Under", "Again")]
    return pages.train(sample)


@pytest.mark.parametrize(("page", "expected"), CASES)
def test_pages(labeller, page, expected):
    found = pages.blocks(page)
    score = labeller.scores(pages.read([found]))
    assert " ".join(b.text for b, s in zip(found, score, strict=True) if s >= 0) == expected


def test_blocks_decode_once_and_close_raw_elements():
    assert [b.text for b in pages.blocks("<p>a &amp;lt; b&nbsp;&#233;</p><!-- <p>x</p> --><style>p{}</style><p title='a>b'>c<script>never closed <p>d")] == ["a &lt; b é", "c"]
    assert pages.blocks("") == [] and [b.text for b in pages.blocks("plain  text\n here")] == ["plain text here"]
    assert html.unescape("&eacute;") == "é"


def test_labeller_gradient():
    rng = np.random.default_rng(0)
    some = [pages.layouts(["a b c.", "d e f g."], ["x y"], rng) for _ in range(3)]
    model, r, y = pages.Labeller.fresh(), pages.read([p for p, _ in some]), np.array([v for _, labels in some for v in labels], float)
    g = model.gradient(r, y)
    loss = lambda: float(np.mean(np.logaddexp(0, model.scores(r)) - y * model.scores(r)))
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = model.p[k][i]
        model.p[k][i] = old + 1e-5
        up = loss()
        model.p[k][i] = old - 1e-5
        down = loss()
        model.p[k][i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6


def test_extract_in_spark(spark):
    data = [(i, f"u{i}", CASES[0][0].replace("One", f"Word{i}")) for i in range(40)] + [(50, None, None), (51, "e", ""), (None, "n", CASES[0][0]), (0, "u0", CASES[0][0].replace("One", "Word0"))]
    got = pages.extract(spark.createDataFrame([(*d, "t") for d in data], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(data)
    by = {r["page_id"]: r for r in got}
    assert by[50]["text"] == by[51]["text"] == "" and by[7]["text"] == CASES[0][1].replace("One", "Word7") and by[7]["n_chars"] == len(by[7]["text"])
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sequences_of_lines_of_a_null_text():
    found = quality.measure(pa.array([None, "", "a b"]))
    assert found.n_words.tolist() == [0, 0, 2] and found.bound.tolist() == [0, 0, 0, 1]
