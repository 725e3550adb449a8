"""Extraction and matching against brute force in plain Python."""

import math
import re
from collections import Counter

from outfall.operators import extract, match
from outfall.rules.pack import RulePackError, builtin_pack, make_pack

import pytest

KEYS = ["path_in_tree"]
PRINTABLE = set(range(0x20, 0x7F)) | {9}


def brute_strings(data: bytes):
    out = []
    for m in re.finditer(rb"[\t\x20-\x7e]{6,8192}", data):
        out.append((m.group().decode(), m.start(), "ascii"))
    for m in re.finditer(rb"(?:[\t\x20-\x7e]\x00){6,8192}", data):
        out.append((m.group().replace(b"\0", b"").decode(), m.start(), "utf-16le"))
    return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def entropy(v):
    return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())


def frame(spark, contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path_in_tree string, content binary")


def test_strings_equal_brute_force(spark):
    wide = "wide secret value".encode("utf-16le")
    contents = [
        b"", b"short", b"\x00\x01abcdef\x02" + "é".encode() + b"ghijkl", b"x" * 8197, b"y" * 8198, b"\xffA" + wide + b"\x01tail of it",
        b"odd" + b"\x00" + wide, b"a\tb c d e\nnext line here\r\n", b"".join(bytes([i % 256]) for i in range(3000)), b"ab\n" * 50 + b"line six\n" * 700,
    ]
    rows = extract.extract_strings(frame(spark, contents), KEYS).collect()
    for i, c in enumerate(contents):
        got = sorted([(r.value, r.byte_offset, r.encoding) for r in rows if r.path_in_tree == f"f{i}"], key=lambda r: (r[1], r[2], r[0]))
        assert got == brute_strings(c), i


def test_every_rule_fires_on_its_positives_only(spark):
    pack = builtin_pack()
    texts = [(f"{r['id']}|{kind}|{i}", bytearray(t.encode())) for r in pack.rules for kind in ("positive", "negative") for i, t in enumerate(r[kind])]
    df = spark.createDataFrame(texts, "path_in_tree string, content binary")
    hits = {(r.path_in_tree, r.rule_id) for r in match.scan(df, pack, KEYS).collect()}
    for name, _ in texts:
        rule, kind, _number = name.split("|")
        assert ((name, rule) in hits) == (kind == "positive"), name


def test_raw_matches_equal_finditer(spark):
    pack = builtin_pack()
    samples = [t for r in pack.rules for t in r["positive"]]
    contents = [("; ".join(samples[i:] + samples[:i])).encode() for i in range(0, len(samples), 6)]
    contents.append(b"\x01\x02" + samples[0].encode("utf-16le") + b"\x03" + samples[4].encode())
    got = Counter((r.path_in_tree, r.rule_id, r.pattern_no, r.value, r.byte_offset) for r in match.raw_matches(frame(spark, contents), pack, KEYS).collect())
    want = Counter()
    for i, c in enumerate(contents):
        for value, offset, encoding in brute_strings(c):
            width = 2 if encoding == "utf-16le" else 1
            for p in pack.patterns():
                for m in re.finditer(p["regex"], value, re.MULTILINE):
                    if m.group(p["capture"]):
                        want[(f"f{i}", p["rule_id"], p["pattern_no"], m.group(p["capture"]), offset + m.start() * width)] += 1
    assert got == want


def test_evidence_never_shows_the_value(spark):
    secret = "q7Zp2Lk9Vx4Tn8Rw1Yb6Mc3H"
    text = f"secret: '{secret}' again {secret}"
    rows = match.scan(frame(spark, [text.encode(), b"\x00\x00" + text.encode("utf-16le")]), builtin_pack(), KEYS).collect()
    assert {r.encoding for r in rows} == {"ascii", "utf-16le"}
    for r in rows:
        assert secret not in r.context and ".".join(secret) not in r.context
        assert "q7Zp" in r.value_masked and secret not in r.value_masked
        assert r.entropy == round(entropy(secret), 3)
        assert not hasattr(r, "value_plaintext")


def test_gates_of_a_test_rule(spark):
    rule = dict(id="near", name="Near", category="c", severity="high", patterns=[dict(regex=r"\b([A-Za-z0-9/+]{24})\b", capture=1)],
                requires_nearby=["Token_Key"], nearby_window=20, shape_policy="strict", require_mixed_case=True)
    pack = make_pack([rule], [], "1", "h")
    good = "aB3" * 4 + "xY7z" * 3
    texts = [f"token_key {good}", f"far away from it                        {good} x", "token_key " + "0123456789abcdef01234567", "token_key " + "abcdefghijklmnopqrstuvwx",
             "token_key " + "a" * 130]
    hits = {r.path_in_tree for r in match.scan(frame(spark, [t.encode() for t in texts]), pack, KEYS).collect()}
    assert hits == {"f0"}


def test_blob_run_length_limit(spark):
    rule = dict(id="t", name="T", category="c", severity="low", patterns=[dict(regex=r"(KEY[a-z]{17})", capture=1)])
    pack = make_pack([rule], [], "1", "h")
    key = "KEY" + "abcdefghijklmnopq"
    texts = ["A" * 99 + key + ":", "A" * 100 + key + ":"]  # runs of 119 and 120
    assert {r.path_in_tree for r in match.scan(frame(spark, [t.encode() for t in texts]), pack, KEYS).collect()} == {"f0"}


@pytest.mark.parametrize("change", [{"severity": "urgent"}, {"patterns": []}, {"patterns": ["("]}, {"patterns": ["a*"]}, {"patterns": [{"regex": "a(b)", "capture": 2}]}])
def test_bad_rules_are_fatal(change):
    rule = {"id": "r", "name": "R", "category": "c", "severity": "low", "patterns": ["x(y)"], **change}
    with pytest.raises(RulePackError):
        make_pack([rule], [], "1", "h")


def test_result_does_not_depend_on_partitioning(spark):
    contents = [t.encode() for r in builtin_pack().rules for t in r["positive"]]
    df = frame(spark, contents)
    one = match.scan(df.coalesce(1), builtin_pack(), KEYS)
    many = match.scan(df.repartition(7), builtin_pack(), KEYS)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_sql_functions(spark):
    from outfall.functions.register import register_functions

    register_functions(spark)
    big = b"\x01".join([b"text line %06d" % i for i in range(400_000)]) + "wide secret".encode("utf-16le")
    rows = [("big", bytearray(big)), ("none", None), ("empty", bytearray()), ("odd", bytearray(b"odd\0" + "wide value here".encode("utf-16le")))]
    spark.createDataFrame(rows, "path_in_tree string, content binary").createOrReplaceTempView("outfall_test_files")
    found = spark.sql("SELECT f.path_in_tree, s.* FROM outfall_test_files f, LATERAL outfall_strings(f.content) s")
    want = extract.extract_strings(spark.table("outfall_test_files"), KEYS)
    assert found.count() == want.count() == 400_002 and found.exceptAll(want).isEmpty()
    cases = [("npm", "@a b/c", "1.0+x"), ("golang", "github.com/x/é", "v1"), ("pypi", "lib", ""), ("npm", "plain", "2")]
    from pyspark.sql import functions as F

    from outfall.functions import text as T

    frame = spark.createDataFrame(cases, "e string, n string, v string")
    for r in frame.select(F.expr("outfall_purl(e, n, v)").alias("a"), T.purl(F.col("e"), F.col("n"), F.col("v")).alias("b")).collect():
        assert r["a"] == r["b"]


def test_the_pack_is_the_one_findings_were_made_with():
    """Fixed digests of what must not change: rules, expressions, limits, benign values."""
    import hashlib
    import json

    pack = builtin_pack()
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16]
    rules = [{k: r[k] for k in sorted(r) if k not in ("patterns", "positive", "negative", "remediation")} for r in pack.rules]
    patterns = [[(p["regex"], p["capture"]) for p in r["patterns"]] for r in pack.rules]
    assert (len(pack.rules), len(pack.patterns()), len(pack.false_positives)) == (20, 39, 54)
    assert (digest(rules), digest(patterns), digest(pack.false_positives)) == DIGESTS


DIGESTS = ("cfee3cd5c97f42cd", "9fd53a4f011e1014", "cf517772d7cdf50e")
