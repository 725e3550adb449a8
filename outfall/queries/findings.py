"""Queries on evidence and findings: correlation, suppression, clusters, locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.operators import correlate as C
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query

RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"

# correlation in SQL; ``{suppress}`` is an extra condition on the anchor
CORRELATION = """grouped AS (SELECT run_id, rule_id, value_hash, max(entropy) AS peak, count(*) AS n, bool_or(encoding = 'utf-16le') AS wide FROM evidence GROUP BY ALL),
anchors AS (SELECT run_id, rule_id, value_hash, path_in_tree, byte_offset, value_masked, entropy FROM evidence
  QUALIFY row_number() OVER (PARTITION BY run_id, rule_id, value_hash ORDER BY path_in_tree, byte_offset, encoding) = 1),
singles AS (SELECT run_id, rule_id, value_hash, substr(sha256(rule_id || chr(31) || value_hash || chr(31) || path_in_tree || chr(31) || byte_offset), 1, 32) AS id,
  title, category, severity, round(least(greatest(base_confidence + (CASE WHEN peak >= 4.5 THEN 0.15 WHEN peak <= 2.5 AND min_entropy = 0 THEN -0.15 ELSE 0 END)::DOUBLE
   + (CASE WHEN n > 1 THEN 0.05 ELSE 0 END)::DOUBLE + (CASE WHEN wide THEN 0.05 ELSE 0 END)::DOUBLE, 0.05), 0.99), 3) AS confidence,
  value_masked, entropy, path_in_tree AS anchor_path, n FROM grouped JOIN anchors USING (run_id, rule_id, value_hash) JOIN rule_dim USING (rule_id) WHERE {suppress}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, rule_id ORDER BY id) AS k, count(*) OVER (PARTITION BY run_id, rule_id) AS members FROM singles),
parts AS (SELECT run_id, rule_id, substr(id, 1, 4) AS part, sha256(string_agg(value_hash, ',' ORDER BY id)) AS text FROM ranked WHERE members > 20 GROUP BY ALL),
whole AS (SELECT run_id, rule_id, sha256('cluster:' || rule_id || ':' || string_agg(text, ',' ORDER BY part)) AS value_hash FROM parts GROUP BY run_id, rule_id),
heads AS (SELECT run_id, rule_id, members, any_value(whole.value_hash) AS value_hash,
  string_agg(value_masked, ', ' ORDER BY id) FILTER (WHERE k <= 3) AS samples, max(confidence) AS confidence, arg_min(anchor_path, id) AS anchor_path,
  arg_min(entropy, id) AS entropy, min(title) AS title, min(category) AS category, min(severity) AS severity FROM ranked JOIN whole USING (run_id, rule_id) WHERE members > 20 GROUP BY run_id, rule_id, members),
clusters AS (SELECT *, substr(sha256(rule_id || chr(31) || value_hash || chr(31) || anchor_path || chr(31) || '0'), 1, 32) AS id FROM heads),
final AS (SELECT run_id, id, rule_id, value_hash, title, category, severity, confidence, value_masked, entropy FROM ranked WHERE members <= 20
  UNION ALL SELECT run_id, id, rule_id, value_hash, title || ' (' || members || ' distinct values)', category, severity, confidence,
   members || ' values, e.g. ' || samples, entropy FROM clusters)"""
ALL = CORRELATION.format(suppress="true")
GLOB = "regexp_matches(path_in_tree, '^' || replace(replace(replace(path_pattern, '.', '\\.'), '*', '.*'), '?', '.') || '$')"
EXEMPT = f"EXISTS (SELECT 1 FROM suppressions s WHERE s.rule_id = grouped.rule_id AND s.value_hash = grouped.value_hash AND {GLOB})"
SUPPRESSED = CORRELATION.format(suppress=f"NOT {EXEMPT}")
EV = ("evidence", "rule_dim")


def rules(t: Inputs):
    return t.view("rule_dim").withColumnRenamed("base_confidence", "confidence")


def singles(t: Inputs):
    return C.score_groups(C.evidence_groups(t.evidence()), rules(t))


@query("agg_01_correlate", f"WITH {ALL} SELECT run_id, rule_id, value_hash, id, value_masked, CAST(n AS BIGINT) AS evidence_count FROM singles", EV)
def _(t):
    return singles(t).select("run_id", "rule_id", "value_hash", "id", "value_masked", "evidence_count")


@query("agg_02_locations", f"""WITH {ALL}, ids AS (SELECT r.run_id, r.rule_id, r.value_hash, r.id AS member_id, coalesce(c.id, r.id) AS finding_id FROM ranked r LEFT JOIN clusters c USING (run_id, rule_id))
SELECT run_id, finding_id, path_in_tree, byte_offset, arg_min(encoding, member_id || encoding) AS encoding FROM evidence JOIN ids USING (run_id, rule_id, value_hash) GROUP BY run_id, finding_id, path_in_tree, byte_offset""", EV)
def _(t):
    return C.correlate(t.evidence(), rules(t)).locations


@query("agg_03_confidence", f"WITH {ALL} SELECT run_id, id, confidence FROM singles", EV)
def _(t):
    return singles(t).select("run_id", "id", "confidence")


@query("agg_04_cluster", f"WITH {ALL} SELECT run_id, rule_id, id, value_hash, CAST(members AS BIGINT) AS members, confidence, entropy, samples FROM clusters", EV)
def _(t):
    return C.cluster_rules(singles(t)).select(
        "run_id", "rule_id", "id", "value_hash", "members", "confidence", "entropy",
        F.regexp_replace("value_masked", "^.*, e\\.g\\. ", "").alias("samples"))


@query("win_09_cluster_samples", f"WITH {ALL} SELECT run_id, rule_id, title || ' (' || members || ' distinct values)' AS title, members || ' values, e.g. ' || samples AS value_masked FROM clusters", EV)
def _(t):
    return C.cluster_rules(singles(t)).select("run_id", "rule_id", "title", "value_masked")


STAGED = """staged AS (SELECT 'rel.zip → f' || (s_suppkey % 100) AS path_in_tree, CASE WHEN max(s_acctbal) > 1000 THEN md5('art' || (s_suppkey % 100)) END AS artifact_id FROM supplier GROUP BY s_suppkey % 100)"""


@query("jon_02_evidence_artifact", f"""WITH {STAGED} SELECT run_id, coalesce(artifact_id, 'root') AS artifact_id, artifact_id IS NULL AS defaulted, CAST(count(*) AS BIGINT) AS evidence
FROM evidence LEFT JOIN staged USING (path_in_tree) GROUP BY ALL""", ("evidence",))
def _(t):
    """Evidence of a file the tree does not know goes to the root artifact."""
    number = (F.col("s_suppkey") % 100).cast("string")
    known = t.table("supplier").groupBy(number.alias("n")).agg((F.max("s_acctbal") > 1000).alias("known"))
    staged = known.select(F.concat(F.lit("rel.zip → f"), "n").alias("path_in_tree"), F.when(F.col("known"), F.md5(F.concat(F.lit("art"), "n"))).alias("artifact_id"))
    return attach_artifacts(t.evidence(), staged, F.lit("root")).groupBy("run_id", "artifact_id", "defaulted").agg(F.count("*").alias("evidence"))


def attach_artifacts(evidence, artifacts, root):
    joined = evidence.join(artifacts, "path_in_tree", "left")
    return joined.withColumn("defaulted", F.col("artifact_id").isNull()).withColumn("artifact_id", F.coalesce("artifact_id", root))


@query("jon_03_unknown_rules", """SELECT run_id, rule_id, CAST(count(DISTINCT value_hash) AS BIGINT) AS dropped FROM evidence
WHERE rule_id NOT IN (SELECT rule_id FROM rule_dim) GROUP BY run_id, rule_id""", EV)
def _(t):
    return C.correlate(t.evidence(), rules(t)).unknown_rules


@query("jon_04_suppression", f"""WITH {SUPPRESSED.replace(', singles AS', ', singles AS', 1)}, gone AS (SELECT run_id, count(*) AS n FROM grouped JOIN anchors USING (run_id, rule_id, value_hash) WHERE rule_id IN (SELECT rule_id FROM rule_dim) AND {EXEMPT} GROUP BY run_id)
SELECT f.run_id, CAST(count(*) AS BIGINT) AS findings, CAST(coalesce(max(gone.n), 0) AS BIGINT) AS suppressed FROM final f LEFT JOIN gone USING (run_id) GROUP BY f.run_id""", ("evidence", "rule_dim", "suppressions"))
def _(t):
    result = C.correlate(t.evidence(), rules(t), t.view("suppressions"))
    gone = result.suppressed.groupBy("run_id").agg(F.count("*").alias("suppressed"))
    kept = result.findings.groupBy("run_id").agg(F.count("*").alias("findings"))
    return kept.join(gone, "run_id", "left").na.fill(0)


@query("srt_01_ordered_findings", f"WITH {ALL} SELECT run_id, id, rule_id, value_hash, title, category, severity, confidence, value_masked, entropy FROM final", EV)
def _(t):
    found = C.correlate(t.evidence(), rules(t)).findings
    return C.in_order(found).select("run_id", "id", "rule_id", "value_hash", "title", "category", "severity", "confidence", "value_masked", "entropy")
