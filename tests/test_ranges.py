"""Files read as ranges give the rows of a whole read, wherever the borders fall."""

import os
import random

from outfall.operators import extract, match
from outfall.operators.candidates import Finder, required, trigger
from outfall.rules.pack import builtin_pack, make_pack
from outfall.sources.artifacts import artifact_files
from outfall.sources.ranges import LOOKBACK, RangeReader, artifact_ranges

KEYS = ["path_in_tree"]
SIZE = 2 * LOOKBACK


def contents() -> dict[str, bytes]:
    rng = random.Random(4)
    words = [b"plain words here", b"token = 'q7Zp2Lk9Vx4Tn8Rw1Yb6Mc3H'", b"/home/jenkins/ws/a.c", b"\xc3\xa9", b"x", "wide secret value".encode("utf-16le"), b"\0", b"\n"]
    mixed = b"\n".join(rng.choice(words) for _ in range(40_000))
    secret = b"secret: 'q7Zp2Lk9Vx4Tn8Rw1Yb6Mc3H'"
    border = bytearray(b"\x01" * (3 * SIZE + 77))
    for at, text in ((SIZE - 9, secret), (2 * SIZE - 20, secret.decode().encode("utf-16le")), (3 * SIZE - 5, b"short7!"), (3 * SIZE + 40, secret)):
        border[at:at + len(text)] = text
    run = b"\x02" * 13 + b"a b c d " * (5 * SIZE // 8) + secret + b"\x03tail of the file"
    wide = b"\x02" * 5 + ("ab cd ef " * (2 * SIZE // 9) + secret.decode() + " end").encode("utf-16le") + b"\x03\x03last one"
    odd = b"\x02" + wide
    return {"mixed": mixed, "border": bytes(border), "run": run, "all": b"z" * (4 * SIZE), "wide": wide, "odd": odd, "empty": b"", "small": secret, "sub/exact": b"y" * SIZE}


def test_ranges_equal_whole_files(spark, tmp_path):
    for name, data in contents().items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    whole = artifact_files(spark, str(tmp_path))
    parts = artifact_ranges(spark, str(tmp_path), SIZE)
    rows = parts.collect()
    assert {r.path_in_tree for r in rows} == set(contents()) and max(len(r.content) for r in rows) <= SIZE + LOOKBACK + 16_444
    for f in (extract.extract_strings, extract.extract_ascii, extract.extract_utf16le, lambda a, k: match.scan(a, builtin_pack(), k)):
        one, many = f(whole, KEYS), f(parts, KEYS)
        assert one.count() == many.count() > 0
        assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_sparse_file_beyond_two_gib(spark, tmp_path):
    path = tmp_path / "image.bin"
    secret = b"secret: 'q7Zp2Lk9Vx4Tn8Rw1Yb6Mc3H'"
    places = [100, (1 << 31) - 7, (3 << 30) - len(secret)]
    with open(path, "wb") as f:
        for at in places:
            f.seek(at)
            f.write(secret)
    assert path.stat().st_size == 3 << 30
    files = RangeReader({"path": str(path)}).partitions()
    assert len(files) == 48 and all(len(p.ranges) == 1 for p in files)
    # the ranges that hold something; 45 others hold zeros only and would only take time
    rows = artifact_ranges(spark, str(path)).where(" OR ".join(f"{at} BETWEEN range_start - 65536 AND range_end + 65536" for at in places))
    found = match.scan(rows, builtin_pack(), KEYS).where("rule_id = 'generic-high-entropy-assignment'").collect()
    assert sorted(r.byte_offset for r in found) == places and {r.path_in_tree for r in found} == {"image.bin"}


def test_required_literals():
    assert required(r"abc[0-9]+defgh") == ["defgh"]
    assert required(r"(?i)(?:Token|SECRET)\s*=") == ["token", "secret"]
    assert required(r"(foo)?[a-z]+") is None and required(r"ab\d") is None
    assert required(r"(?:http|ab)x+") is None and required("x(?:foo1|bar2){2,}") == ["foo1", "bar2"]
    assert trigger({"needs": [["="], ["(?i)", "Pass", "KEY"]], "regex": "x"}) == ("words", ["pass", "key"])
    assert trigger({"needs": [], "regex": r"\d+"}) == ("every", [])


def test_two_thousand_rules_read_a_content_once(spark):
    rules = [dict(id=f"r{i:04}", name="R", category="c", severity="low", shape_policy="off", patterns=[rf"word{i:04}=([a-z]{{3}})\b"]) for i in range(2000)]
    rules.append(dict(id="digits", name="D", category="c", severity="low", shape_policy="off", patterns=[r"\b\d{9}\b"]))
    pack = make_pack(rules, [], "1", "h")
    texts = [f"a WORD{i:04}=abc word{i:04}=abc, word{i + 1:04}=xyz" for i in range(0, 2000, 50)] + ["only 123456789 here"]
    df = spark.createDataFrame([(str(i), bytearray(t.encode())) for i, t in enumerate(texts)], "path_in_tree string, content binary")
    got = sorted((r.path_in_tree, r.rule_id, r.byte_offset) for r in match.scan(df, pack, KEYS).collect())
    want = [(str(k), f"r{i:04}", 15) for k, i in enumerate(range(0, 2000, 50))] + [(str(k), f"r{i + 1:04}", 29) for k, i in enumerate(range(0, 2000, 50))] + [("40", "digits", 5)]
    assert got == sorted(want)
    finder = Finder.of(pack.patterns())
    assert len(finder.patterns) == 2000 and len(finder.every) == 1 and not finder.expressions
