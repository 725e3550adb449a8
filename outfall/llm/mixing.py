"""Mixing sources to target weights by temperature (operator 3): DataFrame functions.

Shares of tokens by source are raised to an exponent between 0 (equal) and 1 (as they are) and normalised. The exponent is the largest that
reaches the target entropy, raised if needed until no source is repeated more often than the limit. A source's token budget is filled by
permutations of its documents, pass after pass; budgets are then dealt into blocks that all have the target weights, and
each block is permuted. Sums along a permutation are taken inside hash ranges and then over the ranges, so a source of any size is spread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outfall.llm.common import row_key, stored

#: Entropy to reach, as a share of that of equal weights.
ENTROPY = 0.95
#: Passes over a source, at most.
REPEATS = 2.0
BLOCK_TOKENS = 262_144
#: Grid points of one search round; the interval shrinks by as many.
_GRID = 32


@dataclass
class Mix:
    """The exponent, and what holds at it."""

    exponent: float
    entropy: float
    most_repeats: float
    least_repeats: float
    budget: float


def tokens(text: str = "text") -> Column:
    """Words of a text and one for its end."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long") + 1


def weighed(sources: DataFrame, exponents: list[float], budget: float | None) -> list[Mix]:
    """Entropy and repetition at each exponent. Without a budget it is the smallest that takes every source once."""
    grid = sources.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).withColumn("raw", F.pow(F.col("total") / F.col("largest"), F.col("a")))
    found = grid.groupBy("a").agg(F.sum("raw").alias("z"), F.sum(F.col("raw") * F.log("raw")).alias("e"), F.max(F.col("raw") / F.col("total")).alias("most"), F.min(F.col("raw") / F.col("total")).alias("least"))
    out = []
    for r in found.orderBy("a").collect():
        spent = budget if budget is not None else r["z"] / r["least"]
        out.append(Mix(r["a"], math.log(r["z"]) - r["e"] / r["z"], spent * r["most"] / r["z"], spent * r["least"] / r["z"], spent))
    return out


def find_exponent(sources: DataFrame, entropy: float, repeats: float, budget: float | None, rounds: int = 4) -> Mix:
    """The largest exponent with at least the entropy, or if repeats are then over the limit, the smallest with repeats inside it.

    Both bounds are found by the same bisection, a grid of points a round: entropy falls and repetition falls as the exponent rises.
    If even the natural shares (1) repeat a source too often, because of the budget, the exponent is 1.
    """
    def last(holds) -> float:
        """Largest grid point at which ``holds``; it holds from 0 up to some point."""
        low, width = 0.0, 1.0
        for _ in range(rounds):
            points = [low + width * i / _GRID for i in range(_GRID + 1)]
            good = [m.exponent for m in weighed(sources, points, budget) if holds(m)]
            low, width = max(good, default=low), width / _GRID
            if low >= 1.0:
                return 1.0
        return low

    step = _GRID ** -rounds
    by_entropy = last(lambda m: m.entropy >= entropy)
    at = weighed(sources, [by_entropy], budget)[0]
    if at.most_repeats <= repeats * (1 + 1e-9):
        return at
    return weighed(sources, [min(1.0, last(lambda m: m.most_repeats > repeats) + step)], budget)[0]


def mix_schedule(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, rows_per_range: int = 50_000) -> DataFrame:
    """Rows to train on, in order of (block, slot): doc_id, rk, source, pass, tokens, copies, and the mix's exponent and weight.

    Fully repeated rows (equal doc_id, text and source) are one unit of ``copies`` rows that are taken together. A null source is a source; a null
    or empty text weighs one token. Without a budget of tokens every unit is taken at least once, sources with little weight once, the
    others up to ``repeats`` passes. With one, the last pass of a source takes units while their start lies inside the source's budget.
    Ties of the permuting hash are broken by the unit. Other columns are left out. No documents: no rows.
    """
    units = stored(docs.select("doc_id", row_key(docs).alias("rk"), "source", tokens().alias("w")).groupBy("doc_id", "rk", "source").agg(F.count(F.lit(1)).alias("copies"), F.sum("w").alias("tokens")), "units")
    plain = units.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    whole = plain.agg(F.count(F.lit(1)).alias("k"), F.max("total").alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    sources = stored(plain.withColumn("largest", F.lit(whole["largest"]).cast("long")), "sources")
    m = find_exponent(sources, entropy * math.log(whole["k"]), repeats, budget) if whole["k"] else Mix(1.0, 0.0, 1.0, 1.0, 0.0)
    normal = sum(r["raw"] for r in sources.groupBy().agg(F.sum(F.pow(F.col("total") / F.col("largest"), F.lit(m.exponent))).alias("raw")).collect() if r["raw"]) or 1.0
    # Tokens to take of each source, exact integers from here on. The slack keeps a budget that is the whole source from losing its last unit to rounding.
    wanted = sources.withColumn("weight", F.pow(F.col("total") / F.col("largest"), F.lit(m.exponent)) / F.lit(normal)) \
        .withColumn("take", F.ceil(F.col("weight") * F.lit(m.budget) - F.lit(1e-6)).cast("long")).drop("n", "largest")
    ranges = max(64, math.ceil(whole["n"] / rows_per_range))
    passes = units.withColumnRenamed("source", "of").join(wanted, F.expr("of <=> source")).drop("of")
    dealt = passes.withColumn("pass", F.explode(F.expr("sequence(0, int((take - 1) div total))"))) \
        .withColumn("h", F.xxhash64(F.lit(seed), "pass", "rk", "doc_id")).withColumn("range", F.pmod(F.shiftrightunsigned("h", 32), F.lit(1 << 31)).cast("long") * ranges / F.lit(1 << 31)).withColumn("range", F.floor("range").cast("int"))
    # Ranges of the hash follow each other in the order of (range, h, ...).
    before = Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(dealt.groupBy("source", "pass", "range").agg(F.sum("tokens").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumnRenamed("source", "of").select("of", F.col("pass").alias("p"), F.col("range").alias("r"), "start"), "starts")
    inside = Window.partitionBy("source", "pass", "range").orderBy("h", "rk", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    along = dealt.withColumn("sum", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, F.expr("of <=> source AND p = pass AND r = range"))
    taken = along.withColumn("at", F.col("pass") * F.col("total") + F.col("start") + F.col("sum")).where("at < take")
    blocks = max(1, math.ceil(m.budget / block_tokens))
    placed = taken.withColumn("block", F.floor(F.col("at") * F.lit(blocks) / F.col("take")).cast("int"))
    order = Window.partitionBy("block").orderBy("o", "h", "rk", "pass", "doc_id", "source")
    return placed.withColumn("o", F.xxhash64(F.lit(seed + 1), "h", "source")).withColumn("slot", (F.row_number().over(order) - 1).cast("long")).select(
        "block", "slot", "doc_id", "rk", "source", F.col("pass").cast("int").alias("pass"), "tokens", "copies", F.lit(m.exponent).alias("exponent"), "weight")


def mixed(docs: DataFrame, keep: list[str], **how) -> DataFrame:
    """Columns ``keep`` of each document, as many rows of it as the schedule takes it."""
    times = mix_schedule(docs, **how).groupBy("doc_id", "rk", "source").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    rows = docs.withColumn("__rk", row_key(docs)).alias("d").join(times.alias("t"), F.expr("d.__rk = t.rk AND d.doc_id <=> t.doc_id AND d.source <=> t.source"))
    return rows.select(*(F.col(f"d.`{k}`") for k in keep), F.explode(F.sequence(F.lit(1), F.col("t.__times"))).alias("__copy")).drop("__copy")
