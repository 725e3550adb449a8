"""Rule packs: validated on the driver (a few KB), used as small dimensions."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfall.rules import builtin

try:  # rule folders may be YAML or JSON; YAML needs PyYAML
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

SEVERITIES = ("critical", "high", "medium", "low", "info")
MAX_DIMENSION_ROWS = 20_000
FP_FILE = "false_positives"

RULE_SCHEMA = (
    "rule_id string, name string, category string, severity string, severity_rank int, confidence double,"
    " cwe string, remediation string, tags array<string>, min_entropy double, min_length int, max_length int,"
    " encodings array<string>, requires_nearby array<string>, nearby_window int, shape_policy string,"
    " require_mixed_case boolean, rejects array<string>"
)
PATTERN_SCHEMA = "pattern_ix int, rule_id string, pattern_no int, regex string, capture int"


class RulePackError(ValueError):
    """A pack that cannot be trusted; raised before any job starts."""


@dataclass(frozen=True)
class RulePack:
    version: str
    hash: str
    rules: tuple[dict, ...]
    false_positives: tuple[str, ...]

    def enabled(self) -> list[dict]:
        return sorted((r for r in self.rules if r["enabled"]), key=lambda r: r["id"])

    def patterns(self) -> list[dict]:
        """Enabled patterns in scan order; the position is ``pattern_ix``."""
        rows = []
        for rule in self.enabled():
            for number, pattern in enumerate(rule["patterns"]):
                rows.append({"pattern_ix": len(rows), "rule_id": rule["id"], "pattern_no": number, **pattern})
        return rows

    def rules_df(self, spark: SparkSession) -> DataFrame:
        """``rules``: one row per enabled rule."""
        rows = [
            (
                r["id"], r["name"], r["category"], r["severity"], SEVERITIES.index(r["severity"]), r["confidence"],
                r["cwe"], r["remediation"], r["tags"], r["min_entropy"], r["min_length"], r["max_length"],
                r["encodings"], r["requires_nearby"], r["nearby_window"], r["shape_policy"],
                r["require_mixed_case"], r["rejects_matching"],
            )
            for r in self.enabled()
        ]
        return dimension(spark, rows, RULE_SCHEMA)

    def patterns_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p["pattern_ix"], p["rule_id"], p["pattern_no"], p["regex"], p["capture"]) for p in self.patterns()]
        return dimension(spark, rows, PATTERN_SCHEMA)

    def false_positives_df(self, spark: SparkSession) -> DataFrame:
        return dimension(spark, [(v,) for v in self.false_positives], "fp_value string")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension; it is broadcast if its size, which is known here, allows it."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_DIMENSION_ROWS else df


def _java_pattern(expression: str) -> str:
    return expression.replace("(?P<", "(?<")


def _compile(expression: str, where: str) -> re.Pattern:
    try:
        return re.compile(expression, re.MULTILINE)
    except re.error as exc:
        raise RulePackError(f"{where}: invalid expression {expression!r}: {exc}") from None


def _pattern(raw, where: str) -> dict:
    spec = raw if isinstance(raw, dict) else {"regex": raw}
    compiled = _compile(spec["regex"], where)
    if compiled.match(""):
        raise RulePackError(f"{where}: {spec['regex']!r} matches the empty string")
    capture = spec.get("capture", 0)
    if isinstance(capture, str):
        capture = compiled.groupindex.get(capture, -1)
    if not 0 <= capture <= compiled.groups:
        raise RulePackError(f"{where}: no capture group {spec.get('capture')!r}")
    return {"regex": _java_pattern(spec["regex"]), "capture": capture, "needs": spec.get("needs", [])}


def build_rule(entry: dict, where: str = "<memory>") -> dict:
    missing = [k for k in ("id", "name", "category", "severity", "patterns") if not entry.get(k)]
    if missing:
        raise RulePackError(f"{where}: missing {', '.join(missing)}")
    where = f"{where}: {entry['id']}"
    if entry["severity"] not in SEVERITIES:
        raise RulePackError(f"{where}: unknown severity {entry['severity']!r}")
    rejects = [str(x) for x in entry.get("rejects_matching") or ()]
    for expression in rejects:
        _compile(expression, where)
    tests = entry.get("tests") or {}
    return {
        "id": entry["id"], "name": entry["name"], "category": entry["category"], "severity": entry["severity"],
        "patterns": [_pattern(p, where) for p in entry["patterns"]],
        "confidence": float(entry.get("confidence", 0.5)), "cwe": entry.get("cwe"),
        "remediation": (entry.get("remediation") or "").strip(), "tags": list(entry.get("tags") or ()),
        "min_entropy": float(entry.get("min_entropy", 0.0)), "min_length": int(entry.get("min_length", 0)),
        "max_length": int(entry.get("max_length", 4096)),
        "encodings": list(entry.get("encodings") or ("ascii", "utf-16le")),
        "requires_nearby": list(entry.get("requires_nearby") or ()),
        "nearby_window": int(entry.get("nearby_window", 120)),
        "shape_policy": str(entry.get("shape_policy", "context")),
        "require_mixed_case": bool(entry.get("require_mixed_case", False)),
        "rejects_matching": [_java_pattern(x) for x in rejects], "enabled": bool(entry.get("enabled", True)),
        "positive": list(tests.get("positive") or ()), "negative": list(tests.get("negative") or ()),
    }


def make_pack(entries: list[dict], false_positives, version: str, digest: str, where: str = "<memory>") -> RulePack:
    rules = [build_rule(entry, where) for entry in entries]
    ids = [r["id"] for r in rules]
    duplicates = sorted({i for i in ids if ids.count(i) > 1})
    if duplicates:
        raise RulePackError(f"duplicate rule id {', '.join(duplicates)}")
    return RulePack(version, digest, tuple(rules), tuple(sorted(set(false_positives))))


def builtin_pack() -> RulePack:
    content = json.dumps([builtin.RULES, builtin.FALSE_POSITIVES], sort_keys=True)
    values = [v for group in builtin.FALSE_POSITIVES.values() for v in group]
    return make_pack(builtin.RULES, values, builtin.VERSION, hashlib.sha256(content.encode()).hexdigest(), "builtin")


def _parse(path: Path) -> dict:
    text = path.read_text(encoding="utf-8-sig")
    if path.suffix == ".json":
        return json.loads(text) or {}
    if yaml is None:
        raise RulePackError("YAML rule files need PyYAML; use JSON files instead")
    return yaml.safe_load(text) or {}


def load_pack(directory: str) -> RulePack:
    """Read a folder of rule files.  The hash covers (name, bytes) by sorted name."""
    folder = Path(directory)
    files = sorted(p for p in folder.glob("*") if p.suffix in (".yaml", ".json"))
    rule_files = [p for p in files if p.stem != FP_FILE]
    if not rule_files:
        raise RulePackError(f"no rule files in {directory}")
    digest = hashlib.sha256()
    entries: list[dict] = []
    for path in rule_files:
        digest.update(path.name.encode())
        digest.update(path.read_bytes())
        entries.extend(_parse(path).get("rules", []))
    benign = [str(v) for p in files if p.stem == FP_FILE for g in _parse(p).get("known_benign", {}).values() for v in g]
    version_file = folder / "VERSION"
    version = version_file.read_text().strip() if version_file.is_file() else "0.0.0-dev"
    return make_pack(entries, benign, version, digest.hexdigest(), directory)
