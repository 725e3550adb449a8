"""Rule and policy documents, stored files."""

import hashlib

import pytest

from outfall.queries import QUERIES
from outfall.rules.pack import RulePackError, load_pack
from outfall.sources import artifacts
from outfall.sources.artifacts import artifact_files
from outfall.sources.policies import load_policy

RULES = """
rules:
  - id: demo
    name: Demo
    category: c
    severity: low
    patterns:
      - regex: 'demo-(?P<code>[0-9]{4})'
        capture: code
"""


def test_yaml_pack_and_hash(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text(RULES)
    (tmp_path / "false_positives.yaml").write_text("known_benign:\n  g:\n    - demo\n    - 'null'\n")
    (tmp_path / "VERSION").write_text("2.1.0\n")
    pack = load_pack(str(tmp_path))
    assert pack.hash == hashlib.sha256(b"b.yaml" + RULES.encode()).hexdigest()
    assert (pack.version, pack.false_positives) == ("2.1.0", ("demo", "null"))
    assert pack.patterns()[0]["capture"] == 1 and pack.patterns()[0]["regex"] == "demo-(?<code>[0-9]{4})"
    (tmp_path / "c.yaml").write_text(RULES)
    with pytest.raises(RulePackError):
        load_pack(str(tmp_path))


def test_yaml_policy(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "policy.yaml"
    path.write_text("version: 1\nname: team\nblock:\n  severity_at_or_above: none\n  rules: [b, a]\nbudgets:\n  low: 3\n")
    policy = load_policy(str(path))
    assert (policy.name, policy.floor, policy.block_rules, policy.budgets) == ("team", None, ("a", "b"), {"low": 3})


def test_files_are_read_whole_or_cut_and_flagged(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"0123456789")
    (tmp_path / "y.bin").write_bytes(b"abc")
    rows = {r.path_in_tree: r for r in artifact_files(spark, str(tmp_path), max_bytes=5).collect()}
    assert (bytes(rows["d/x.bin"].content), rows["d/x.bin"].truncated, rows["d/x.bin"].size_bytes) == (b"01234", True, 10)
    assert (bytes(rows["y.bin"].content), rows["y.bin"].truncated) == (b"abc", False)


def test_digest_of_files_of_any_size(spark, tmp_path, monkeypatch):
    """a file of 2 GiB and more has a digest; the same ones by Spark, by blocks, cut, and where only Spark can read."""
    small, large = tmp_path / "small", tmp_path / "large"
    contents = {"a b/x %41.bin": b"0123456789" * 50, "y.bin": bytes(range(256)) * 40}
    for name, data in contents.items():
        (small / name).parent.mkdir(parents=True, exist_ok=True)
        (small / name).write_bytes(data)
    digests = lambda **o: {r.path_in_tree: (r.size_bytes, r.truncated, r.sha256) for r in artifacts.artifact_files(spark, str(small), digest=True, **o).collect()}
    whole = {n: (len(d), False, hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    cut = {n: (len(d), len(d) > 600, hashlib.sha256(d[:600]).hexdigest()) for n, d in contents.items()}
    assert digests() == whole and digests(max_bytes=600) == cut
    monkeypatch.setattr(artifacts, "WHOLE_BYTES", 0)
    monkeypatch.setattr(artifacts, "BLOCK", 256)
    assert digests() == whole and digests(max_bytes=600) == cut
    monkeypatch.setattr(artifacts, "_streamable", lambda path: False)
    assert digests() == whole
    monkeypatch.undo()
    large.mkdir()
    with open(large / "image.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    found = hashlib.sha256()
    for _ in range(512):
        found.update(bytes(4 << 20))
    found.update(bytes(5))
    (row,) = QUERIES["src_01_artifact_files"](spark, str(large)).collect()
    assert tuple(row) == ("image.bin", (2 << 30) + 5, False, found.hexdigest())
