"""Release policies and waivers: small documents, checked before any job runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions.text import SEVERITY_RANKS

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

UNLIMITED = -1
MAX_INLINE_POLICIES = 1000
# Fixed values
MODES = ("new_only", "all")
POSTURES = ("fail", "warn", "pass")


class PolicyError(ValueError):
    """A policy document that must not be guessed at."""


@dataclass(frozen=True)
class Policy:
    name: str = "default"
    floor: str | None = "high"
    block_categories: tuple[str, ...] = ()
    block_rules: tuple[str, ...] = ()
    budgets: dict[str, int] = field(default_factory=dict)
    baseline_mode: str = "new_only"
    on_degraded: str = "fail"
    trust_llm_dismissals: bool = False
    max_waiver_days: int = 90
    require_owner: bool = True
    require_reason: bool = True

    def struct(self) -> Column:
        """The policy as one struct literal; exploding it needs no join."""
        texts = "array<string>"
        rank = None if self.floor is None else SEVERITY_RANKS[self.floor]
        return F.struct(
            F.lit(self.name).alias("policy"), F.lit(rank).cast("int").alias("floor_rank"),
            F.array(*map(F.lit, self.block_categories)).cast(texts).alias("block_categories"),
            F.array(*map(F.lit, self.block_rules)).cast(texts).alias("block_rules"),
            F.lit(self.baseline_mode).alias("baseline_mode"), F.lit(self.on_degraded).alias("on_degraded"),
            F.lit(self.trust_llm_dismissals).alias("trust_llm_dismissals"), F.lit(self.max_waiver_days).alias("max_waiver_days"),
            *[F.lit(self.budgets.get(s, UNLIMITED)).alias(f"budget_{s}") for s in SEVERITY_RANKS],
        )


def with_policies(df: DataFrame, policies: list[Policy]) -> DataFrame:
    """Every row under every policy."""
    if not policies:
        raise PolicyError("no policies")
    blocks = [policies[i:i + MAX_INLINE_POLICIES] for i in range(0, len(policies), MAX_INLINE_POLICIES)]
    every = [df.select("*", F.inline(F.array(*[p.struct() for p in block]))) for block in blocks]
    return reduce(DataFrame.unionAll, every)


def _mapping(raw, what: str) -> dict:
    if raw is None:
        return {}
    if not isinstance(raw, dict):
        raise PolicyError(f"{what} must be a mapping")
    return raw


def _choice(raw, allowed: tuple[str, ...], what: str) -> str:
    text = str(raw).strip().lower()
    if text not in allowed:
        raise PolicyError(f"{what}: {raw!r} is not one of {', '.join(allowed)}")
    return text


def _names(raw, what: str) -> tuple[str, ...]:
    if raw is None:
        return ()
    if not isinstance(raw, list):
        raise PolicyError(f"{what} must be a list")
    return tuple(sorted({str(x).strip() for x in raw} - {""}))


def _number(raw, what: str, least: int) -> int:
    try:
        number = int(raw)
    except (TypeError, ValueError):
        raise PolicyError(f"{what} must be an integer") from None
    if number < least:
        raise PolicyError(f"{what} must be at least {least}")
    return number


def parse_policy(document: dict) -> Policy:
    if _number(document.get("version", 1), "version", 1) != 1:
        raise PolicyError("only policy version 1 is known")
    block, waivers = _mapping(document.get("block"), "block"), _mapping(document.get("waivers"), "waivers")
    floor = block.get("severity_at_or_above", "high")
    off = floor is None or str(floor).strip().lower() in ("none", "off", "")
    budgets = {
        _choice(k, tuple(SEVERITY_RANKS), "budgets"): _number(v, f"budgets.{k}", UNLIMITED)
        for k, v in _mapping(document.get("budgets"), "budgets").items()
    }
    return Policy(
        name=str(document.get("name", "default")).strip() or "default",
        floor=None if off else _choice(floor, tuple(SEVERITY_RANKS), "block.severity_at_or_above"),
        block_categories=_names(block.get("categories"), "block.categories"),
        block_rules=_names(block.get("rules"), "block.rules"),
        budgets=budgets,
        baseline_mode=_choice(_mapping(document.get("baseline"), "baseline").get("mode", "new_only"), MODES, "baseline.mode"),
        on_degraded=_choice(document.get("on_degraded", "fail"), POSTURES, "on_degraded"),
        trust_llm_dismissals=bool(document.get("trust_llm_dismissals", False)),
        max_waiver_days=_number(waivers.get("max_ttl_days", 90), "waivers.max_ttl_days", 1),
        require_owner=bool(waivers.get("require_owner", True)),
        require_reason=bool(waivers.get("require_reason", True)),
    )


def load_policy(path: str) -> Policy:
    file = Path(path)
    if not file.is_file():
        raise PolicyError(f"policy file {path} does not exist")
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        return parse_policy(_mapping(json.loads(text), path))
    if yaml is None:
        raise PolicyError("YAML policies need PyYAML; use JSON instead")
    try:
        return parse_policy(_mapping(yaml.safe_load(text), path))
    except yaml.YAMLError as exc:
        raise PolicyError(f"{path}: {exc}") from None


def waiver_validate(waivers: DataFrame, policy: Policy) -> DataFrame:
    """Waivers with an ``error`` column: null means valid.  ``waivers``: finding_id, reason, owner, expires."""
    def blank(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    counts = waivers.groupBy("finding_id").agg(F.count("*").alias("_n"))
    error = F.when(blank("finding_id"), "finding_id is required").when(F.col("_n") > 1, "duplicate waiver")
    if policy.require_reason:
        error = error.when(blank("reason"), "a reason is required")
    if policy.require_owner:
        error = error.when(blank("owner"), "an owner is required")
    error = error.when(F.col("expires").isNull(), "an expires date is required")
    joined = waivers.join(counts, waivers["finding_id"].eqNullSafe(counts["finding_id"])).drop(counts["finding_id"])
    return joined.withColumn("error", error).drop("_n")


def valid_waivers(waivers: DataFrame, policy: Policy) -> DataFrame:
    return waiver_validate(waivers, policy).where("error IS NULL").drop("error")
