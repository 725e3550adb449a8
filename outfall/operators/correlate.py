"""Evidence to findings: grouping, scoring, suppression, clustering, locations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.session import cut

# Scores and clusters must stay comparable.
ENTROPY_STRONG = 4.5
ENTROPY_WEAK = 2.5
CLUSTER_ABOVE = 20
SAMPLES = 3

GROUP = ["run_id", "rule_id", "value_hash"]


@dataclass(frozen=True)
class Correlation:
    findings: DataFrame
    locations: DataFrame
    suppressed: DataFrame
    unknown_rules: DataFrame


def glob_regex(pattern: Column) -> Column:
    """Shell pattern as a whole-string expression; ``*`` also crosses ``/``.

    The pattern is cut into stars, question marks, closed brackets and single characters. A bracket that does not close is a
    character; ranges that run backwards hold nothing, so no pattern makes the matching fail.
    """
    def quoted(c: Column) -> Column:
        return F.when(c.rlike(r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]$"), F.concat(F.lit("\\"), c)).otherwise(c)

    def bracket(part: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(part, r"^\[!?", ""), r"\]$", "")
        members = F.regexp_extract_all(inner, F.lit(r"([\s\S]-[\s\S]|[\s\S])"), 1)
        members = F.filter(members, lambda m: (F.length(m) == 1) | (F.substring(m, 1, 1) <= F.substring(m, 3, 1)))
        one = F.transform(members, lambda m: F.when(F.length(m) == 1, quoted(m)).otherwise(F.concat(quoted(F.substring(m, 1, 1)), F.lit("-"), quoted(F.substring(m, 3, 1)))))
        other = F.substring(part, 2, 1) == "!"
        return F.when(F.size(members) == 0, F.when(other, F.lit(".")).otherwise(F.lit("(?!)"))).otherwise(
            F.concat(F.when(other, F.lit("[^")).otherwise(F.lit("[")), F.array_join(one, ""), F.lit("]")))

    parts = F.regexp_extract_all(pattern, F.lit(r"(\[!?+\]?+[^\]]*\]|[\s\S])"), 1)
    body = F.transform(parts, lambda x: F.when(x == "*", F.lit(".*")).when(x == "?", F.lit(".")).when(F.length(x) > 1, bracket(x)).otherwise(quoted(x)))
    return F.concat(F.lit("(?s)^"), F.array_join(body, ""), F.lit("$"))


def confidence(base: Column, min_entropy: Column, peak: Column, hits: Column, wide: Column) -> Column:
    """Declared confidence moved by entropy, repetition and wide copies, within 0.05..0.99."""
    by_entropy = (
        F.when(peak >= ENTROPY_STRONG, 0.15).when((peak <= ENTROPY_WEAK) & (min_entropy == 0), -0.15).otherwise(0.0)
    )
    score = base + by_entropy + F.when(hits > 1, 0.05).otherwise(0.0) + F.when(wide, 0.05).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(0.99)), 3)


def evidence_places(evidence: DataFrame) -> DataFrame:
    """One row per group and place.  The fine key keeps a hot value off a single task."""
    context = F.col("context") if "context" in evidence.columns else F.lit(None).cast("string")
    first = F.min(F.struct(F.col("encoding"), F.col("value_masked"), F.col("entropy"), context.alias("context")))
    return evidence.groupBy(*GROUP, "path_in_tree", "byte_offset").agg(
        first.alias("first"),
        F.max("entropy").alias("peak"),
        F.count("*").alias("hits"),
        F.max((F.col("encoding") == "utf-16le").cast("int")).alias("wide"),
    )


def group_evidence(places: DataFrame) -> DataFrame:
    """One row per (run, rule, value): the anchor is the first place by path, offset, encoding."""
    anchor = F.min(
        F.struct(
            F.col("path_in_tree"), F.coalesce("byte_offset", F.lit(0)).alias("at"), F.col("first.encoding"),
            F.col("byte_offset"), F.col("first.value_masked"), F.col("first.entropy"), F.col("first.context"),
        )
    )
    return places.groupBy(*GROUP).agg(
        anchor.alias("anchor"), F.max("peak").alias("peak"), F.sum("hits").alias("evidence_count"), F.max("wide").alias("wide")
    )


def evidence_groups(evidence: DataFrame) -> DataFrame:
    """What :func:`group_evidence` makes of the places, from the evidence itself in one pass.

    All of it combines on the map side, so a hot value reaches a task as one row of each partition.
    """
    context = F.col("context") if "context" in evidence.columns else F.lit(None).cast("string")
    anchor = F.min(
        F.struct(
            F.col("path_in_tree"), F.coalesce("byte_offset", F.lit(0)).alias("at"), F.col("encoding"),
            F.col("byte_offset"), F.col("value_masked"), F.col("entropy"), context.alias("context"),
        )
    )
    return evidence.groupBy(*GROUP).agg(
        anchor.alias("anchor"), F.max("entropy").alias("peak"), F.count("*").alias("evidence_count"),
        F.max((F.col("encoding") == "utf-16le").cast("int")).alias("wide"),
    )


def probe(pattern: Column) -> Column:
    """Struct (tail, size, text): the longer of the pattern's literal beginning and literal end; a path it covers has it in the same place."""
    head, tail = F.regexp_extract(pattern, r"^[^*?\[]*", 0), F.regexp_extract(pattern, r"[^*?\[\]]*$", 0)
    longer = F.length(tail) > F.length(head)
    text = F.when(longer, tail).otherwise(head)
    return F.struct(longer.alias("tail"), F.length(text).alias("size"), text.alias("text"))


def covered_groups(groups: DataFrame, suppressions: DataFrame) -> DataFrame:
    """(run, rule, value) of the groups whose anchor path an exemption covers.

    A path is looked up by its beginnings and ends of the sizes that patterns of its (rule, value) have, so it meets the patterns that share
    their literal part with it, not all of them; the expression runs on those only.
    """
    s = suppressions.select("rule_id", "value_hash", "path_pattern", probe(F.col("path_pattern")).alias("p")).select("rule_id", "value_hash", "path_pattern", "p.*")
    sizes = s.groupBy("rule_id", "value_hash").agg(F.collect_set(F.struct("tail", "size")).alias("sizes"))  # at most two for each length of a pattern
    asked = groups.select(*GROUP, F.col("anchor.path_in_tree").alias("path")).join(sizes, ["rule_id", "value_hash"])
    asked = asked.select(*GROUP, "path", F.inline("sizes")).where(F.col("size") <= F.length("path"))
    asked = asked.withColumn("text", F.when(F.col("tail"), F.expr("right(path, size)")).otherwise(F.expr("left(path, size)")))
    met = asked.join(s, ["rule_id", "value_hash", "tail", "size", "text"])
    return met.where(F.regexp_like("path", glob_regex(F.col("path_pattern")))).select(*GROUP).distinct()


def suppressed_groups(groups: DataFrame, suppressions: DataFrame, how: str) -> DataFrame:
    """Groups (``left_semi``) or all others (``left_anti``) whose anchor path an exemption covers."""
    return groups.join(covered_groups(groups, suppressions), GROUP, how)


def score_groups(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Join the rule dimension; groups of unknown rules drop out here."""
    extra = [c for c in ("cwe", "remediation", "tags") if c in rules.columns]
    dim = rules.select("rule_id", "title", "category", "severity", F.col("confidence").alias("base"), "min_entropy", *extra)
    joined = groups.join(dim, "rule_id")
    return joined.select(
        "run_id", "rule_id", "value_hash",
        T.finding_id(F.col("rule_id"), F.col("value_hash"), F.col("anchor.path_in_tree"), F.col("anchor.byte_offset")).alias("id"),
        "title", "category", "severity",
        confidence(F.col("base"), F.col("min_entropy"), F.col("peak"), F.col("evidence_count"), F.col("wide") == 1).alias("confidence"),
        F.col("anchor.value_masked").alias("value_masked"), F.col("anchor.entropy").alias("entropy"),
        F.col("anchor.context").alias("context"), F.col("anchor.path_in_tree").alias("anchor_path"), "evidence_count", *extra,
    )


def cluster_rules(findings: DataFrame, above: int = CLUSTER_ABOVE) -> DataFrame:
    """One row per (run, rule) with more than ``above`` findings.

    The hash runs over the hashes of id prefixes, each of them over the value
    hashes in id order: one definition for every size, and no list grows with
    the cluster by more than one in 65 536 of it.  A task holds the lists of
    many clusters at once, so prefixes are first joined by their own beginnings
    and a cluster's list has 256 texts and three samples each at most.
    """
    sizes = findings.groupBy("run_id", "rule_id").agg(F.count("*").alias("members")).where(F.col("members") > above)
    members = findings.join(sizes, ["run_id", "rule_id"]).withColumn("part", F.substring("id", 1, 4))
    ordered = F.array_sort(F.collect_list(F.struct("id", "value_hash", "value_masked")))
    parts = members.groupBy("run_id", "rule_id", "members", "part").agg(
        ordered.alias("o"),
        F.max("confidence").alias("confidence"),
        F.min(F.struct("id", "anchor_path", "entropy", "context")).alias("anchor"),
        F.min(F.struct("title", "category", "severity")).alias("rule"),
    )
    text = F.concat_ws(",", F.transform("o", lambda x: x["value_hash"]))
    parts = parts.select(
        "run_id", "rule_id", "members", "part", F.sha2(text, 256).alias("text"),
        F.slice("o", 1, SAMPLES).alias("top"), "confidence", "anchor", "rule",
    )

    def joined(rows: DataFrame, *key) -> DataFrame:
        grouped = rows.groupBy("run_id", "rule_id", "members", *key).agg(
            F.array_sort(F.collect_list(F.struct("part", "text"))).alias("texts"),
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, SAMPLES).alias("top"),
            F.max("confidence").alias("confidence"), F.min("anchor").alias("anchor"), F.min("rule").alias("rule"),
        )
        return grouped.withColumn("text", F.concat_ws(",", F.transform("texts", lambda x: x["text"]))).drop("texts")

    merged = joined(joined(parts, F.substring("part", 1, 2).alias("head")).withColumnRenamed("head", "part"))
    merged = merged.withColumn("value_hash", F.sha2(F.concat(F.lit("cluster:"), F.col("rule_id"), F.lit(":"), F.col("text")), 256))
    masks = F.concat_ws(", ", F.transform("top", lambda x: x["value_masked"]))
    count = F.col("members").cast("string")
    return merged.select(
        "run_id", "rule_id", "value_hash",
        T.finding_id(F.col("rule_id"), F.col("value_hash"), F.col("anchor.anchor_path"), F.lit(None).cast("bigint")).alias("id"),
        F.concat(F.col("rule.title"), F.lit(" ("), count, F.lit(" distinct values)")).alias("title"),
        F.col("rule.category").alias("category"), F.col("rule.severity").alias("severity"), "confidence",
        F.concat(count, F.lit(" values, e.g. "), masks).alias("value_masked"),
        F.col("anchor.entropy").alias("entropy"), F.col("anchor.context").alias("context"),
        F.col("anchor.anchor_path").alias("anchor_path"), F.col("members"),
    )


def correlate(evidence: DataFrame, rules: DataFrame, suppressions: DataFrame | None = None) -> Correlation:
    """Deduplicated, scored findings with every place they occur.

    The scored groups (one row per run, rule and value) feed the cluster sizes,
    the clusters, the findings and the locations, so they are checkpointed once.
    """
    groups = evidence_groups(evidence)
    known = groups
    suppressed = groups.select(*GROUP).where(F.lit(False))
    if suppressions is not None:
        groups = cut(groups)  # read for the exemptions, for the others and for unknown rules
        covered = cut(covered_groups(groups, suppressions))
        suppressed = covered.join(rules, "rule_id", "left_semi").select(*GROUP)
        known = groups.join(covered, GROUP, "left_anti")
    unknown = groups.join(rules, "rule_id", "left_anti").groupBy("run_id", "rule_id").agg(F.count("*").alias("dropped"))
    findings, ids = findings_of(known, rules)
    locations = (
        evidence.select(*GROUP, "path_in_tree", "byte_offset", "encoding").join(ids, GROUP)
        .groupBy("run_id", "finding_id", "path_in_tree", "byte_offset")
        .agg(F.min(F.struct("member_id", "encoding"))["encoding"].alias("encoding"))
    )
    return Correlation(findings, locations, suppressed, unknown)


def findings_of(groups: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of groups, clusters included, and the finding of each group (finding_id; member_id as if there were no clusters)."""
    single = cut(score_groups(groups, rules))
    clusters = cluster_rules(single)
    heads = clusters.select("run_id", "rule_id", F.col("id").alias("cluster_id"))
    marked = single.join(heads, ["run_id", "rule_id"], "left")
    kept = marked.where(F.col("cluster_id").isNull()).drop("cluster_id").withColumn("members", F.lit(1).cast("bigint"))
    extra = [c for c in ("cwe", "remediation", "tags") if c in rules.columns]
    grouped = clusters.join(rules.select("rule_id", *extra), "rule_id").withColumn("evidence_count", F.lit(None).cast("bigint"))
    if "tags" in extra:
        grouped = grouped.withColumn("tags", F.array_append("tags", F.lit("clustered")))
    findings = kept.unionByName(grouped)
    ids = marked.select(*GROUP, F.coalesce("cluster_id", "id").alias("finding_id"), F.col("id").alias("member_id"))
    return findings, ids


def merge_groups(groups: DataFrame) -> DataFrame:
    """Groups whose evidence came in several parts as one row each, as :func:`group_evidence` makes of all of it."""
    return groups.groupBy(*GROUP).agg(F.min("anchor").alias("anchor"), F.max("peak").alias("peak"),
                                      F.sum("evidence_count").alias("evidence_count"), F.max("wide").alias("wide"))


def in_order(findings: DataFrame) -> DataFrame:
    """Severity, rule, id: the order every reader sees."""
    return findings.orderBy(T.severity_rank(F.col("severity")), "rule_id", "id")
