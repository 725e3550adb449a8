"""Queries that read stored results: listings, searches, trees, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.operators import match
from outfall.operators import reading as D
from outfall.operators import runs as R
from outfall.plans import exports as X
from outfall.queries import findings as QF
from outfall.queries import oracle as O
from outfall.queries.gate import RANK, projected
from outfall.queries.history import LINKED, SEV, files, links
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query
from outfall.rules.pack import builtin_pack

RF = ("runs", "findings")
RFL = ("runs", "findings", "finding_locations")
NEW = f"{LINKED}, marked AS (SELECT f.*, o.id IS NULL AS is_new FROM findings f LEFT JOIN old o ON o.run_id = f.run_id AND o.id = f.id)"


def marked(t: Inputs):
    found = t.view("findings")
    return R.with_is_new(found, R.baseline_ids(links(t), found))


@query("srt_02_list_findings", f"""WITH {NEW} SELECT run_id, id, rule_id, severity, status, is_new FROM marked WHERE severity IN ('critical', 'high', 'low') AND status = 'open' AND category IN ('cat-0', 'cat-1', 'cat-3') AND is_new
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {RANK}, rule_id, id) <= 3""", RF)
def _(t):
    return D.list_findings(marked(t), ["critical", "high", "low"], ["open"], ["cat-0", "cat-1", "cat-3"], new_only=True, limit=3).select(
        "run_id", "id", "rule_id", "severity", "status", "is_new")


@query("srt_03_search_findings", f"""WITH {NEW} SELECT m.run_id, m.id, m.title FROM marked m WHERE is_new AND status <> 'false_positive' AND (contains(lower(title || ' ' || rule_id || ' ' || category), '→ f7')
 OR EXISTS (SELECT 1 FROM finding_locations l WHERE l.run_id = m.run_id AND l.finding_id = m.id AND contains(lower(path_in_tree), '→ f7')))""", RFL)
def _(t):
    return D.search_findings(marked(t), t.view("finding_locations"), " → F7", new_only=True, hide_dismissed=True).select("run_id", "id", "title")


NODES = ("artifacts",)
PLACES = """places AS (SELECT 'pkg-' || (l_suppkey % 5) || '.zip' AS run_id, 'pkg-' || (l_suppkey % 5) || '.zip → d' || (l_partkey % 20) || ' → f' || l_partkey AS path_in_tree, l_orderkey AS byte_offset FROM lineitem)"""


def places(t: Inputs):
    root = F.concat(F.lit("pkg-"), F.col("l_suppkey") % 5, F.lit(".zip"))
    path = F.concat(root, F.lit(" → d"), F.col("l_partkey") % 20, F.lit(" → f"), F.col("l_partkey"))
    return t.table("lineitem").select(root.alias("run_id"), path.alias("path_in_tree"), F.col("l_orderkey").alias("byte_offset"))


@query("srt_05_bounded_tree", f"""WITH {PLACES}, c AS (SELECT run_id, path_in_tree, count(*) AS n FROM places GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY depth, path_in_tree) AS k, count(*) OVER (PARTITION BY run_id) AS total FROM artifacts),
s AS (SELECT * FROM r WHERE k <= 150) SELECT s.run_id, s.path_in_tree, s.depth, CAST(coalesce(c.n, 0) AS BIGINT) AS finding_count, total > 150 AS truncated FROM s LEFT JOIN c USING (run_id, path_in_tree)
WHERE s.depth = 1 OR EXISTS (SELECT 1 FROM s p WHERE p.run_id = s.run_id AND p.path_in_tree = s.parent_path_in_tree)""", NODES)
def _(t):
    return D.bounded_tree(t.view("artifacts"), D.artifact_counts(places(t)), limit=150).select("run_id", "path_in_tree", "depth", "finding_count", "truncated")


@query("srt_06_file_listing", """SELECT run_id, path_in_tree, size_bytes, CAST(greatest(count(*) OVER (PARTITION BY run_id) - 60, 0) AS BIGINT) AS more FROM artifacts QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY path_in_tree) <= 60""", NODES)
def _(t):
    return D.file_listing(t.view("artifacts")).select("run_id", "path_in_tree", "size_bytes", "more")


@query("srt_08_scannable", "SELECT 'conversations/' || conv_id || '/' || turn AS path_in_tree, CAST(strlen(text) AS BIGINT) AS size_bytes FROM conversations WHERE strlen(text) >= 8")
def _(t):
    from outfall.sources import artifacts as A

    rows = t.table("conversations")
    key = F.concat(F.lit("conversations/"), "conv_id", F.lit("/"), "turn")
    return A.scannable(A.artifact_text(rows, key, "text")).select("path_in_tree", "size_bytes")


@query("agg_11_artifact_finding_counts", f"""WITH {PLACES}, up AS (SELECT run_id, path_in_tree FROM places UNION ALL SELECT run_id, regexp_replace(path_in_tree, ' → [^→]*$', '') FROM places UNION ALL SELECT run_id, run_id FROM places)
SELECT run_id, path_in_tree, CAST(count(*) AS BIGINT) AS subtree_count FROM up GROUP BY ALL""")
def _(t):
    return D.subtree_counts(places(t))


@query("jon_12_plaintext_reveal", f"""WITH {QF.ALL}, ids AS (SELECT r.run_id, r.rule_id, r.value_hash, coalesce(c.id, r.id) AS finding_id FROM ranked r LEFT JOIN clusters c USING (run_id, rule_id)),
loc AS (SELECT DISTINCT run_id, finding_id, path_in_tree, byte_offset FROM evidence JOIN ids USING (run_id, rule_id, value_hash)),
v AS (SELECT DISTINCT l.run_id, finding_id, 'plain-' || e.value_hash AS value FROM loc l JOIN evidence e USING (run_id, path_in_tree, byte_offset) QUALIFY row_number() OVER (PARTITION BY l.run_id, finding_id ORDER BY 'plain-' || e.value_hash) >= 1),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY run_id, finding_id ORDER BY value) <= 500)
SELECT run_id, finding_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(value, ',' ORDER BY value)) AS digest FROM k GROUP BY run_id, finding_id""", QF.EV)
def _(t):
    from outfall.operators import correlate as C

    evidence = t.evidence().withColumn("value_plaintext", F.concat(F.lit("plain-"), "value_hash"))
    shown = D.plaintexts(C.correlate(evidence, QF.rules(t)).locations, evidence)
    return shown.select("run_id", "finding_id", F.size("values").cast("bigint").alias("n"), F.md5(F.array_join("values", ",")).alias("digest"))


@query("jon_13_retained_artifacts", f"""WITH {PLACES} SELECT a.run_id, a.path_in_tree FROM (SELECT *, size_bytes * 1000 AS size, CASE WHEN size_bytes > 45000 THEN 'k' END AS storage_key FROM artifacts) a
WHERE size <= 33554432 AND storage_key IS NULL AND EXISTS (SELECT 1 FROM places p WHERE p.run_id = a.run_id AND p.path_in_tree = a.path_in_tree)""", NODES)
def _(t):
    stored = t.view("artifacts").withColumn("storage_key", F.when(F.col("size_bytes") > 45000, F.lit("k"))).withColumn("size_bytes", F.col("size_bytes") * 1000)
    return D.retained(stored, places(t)).select("run_id", "path_in_tree")


@query("jon_14_identification", """SELECT run_id, path_in_tree, CASE WHEN size_bytes > 20000 THEN 'text' ELSE 'data' END AS kind, CASE WHEN size_bytes > 20000 THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type FROM artifacts""", NODES)
def _(t):
    artifacts = t.view("artifacts")
    found = artifacts.select("run_id", "path_in_tree", F.expr("if(size_bytes > 20000, 'text', 'data')").alias("kind"), F.expr("if(size_bytes > 20000, 'text/plain', 'application/octet-stream')").alias("media_type"))
    bare = artifacts.withColumns({"kind": F.lit("unknown"), "media_type": F.lit(None).cast("string")})
    return D.apply_identification(bare, found).select("run_id", "path_in_tree", "kind", "media_type")


@query("jon_17_search_evidence", r"""SELECT run_id, rule_id, value_masked, path_in_tree, byte_offset FROM evidence WHERE regexp_matches(value_masked, '^v\*{3}[1-4]2$') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY path_in_tree, byte_offset, rule_id) <= 40""", ("evidence",))
def _(t):
    return D.search_evidence(t.evidence(), r"^v\*{3}[1-4]2$").select("run_id", "rule_id", "value_masked", "path_in_tree", "byte_offset")


@query("agg_15_field_report", f"""WITH {QF.ALL}, fl AS (SELECT DISTINCT run_id, path_in_tree FROM evidence), a AS (SELECT run_id, count(*) AS files, sum(length(path_in_tree) * 100) AS bytes FROM fl GROUP BY run_id),
m AS (SELECT run_id, count(*) AS matches FROM evidence GROUP BY run_id), f AS (SELECT run_id, count(*) AS findings, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEV)} FROM final GROUP BY run_id)
SELECT run_id, CAST(files AS BIGINT) AS files, CAST(bytes AS BIGINT) AS bytes, CAST(matches AS BIGINT) AS matches, CAST(findings AS BIGINT) AS findings, {', '.join(SEV)} FROM a JOIN m USING (run_id) JOIN f USING (run_id)""", QF.EV)
def _(t):
    from outfall.operators import correlate as C

    evidence = t.evidence()
    artifacts = evidence.select("run_id", "path_in_tree").distinct().withColumn("size_bytes", (F.length("path_in_tree") * 100).cast("bigint"))
    return D.field_report(evidence, C.correlate(evidence, QF.rules(t)).findings, artifacts)


@query("agg_15_rule_spread", "SELECT rule_id, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT run_id) AS BIGINT) AS artifacts FROM evidence GROUP BY rule_id", ("evidence",))
def _(t):
    return D.rule_spread(t.evidence())


@query("agg_18_summary_context", f"""WITH m AS (SELECT 'pkg-' || (CAST(substr(run_id, 2) AS BIGINT) % 7) AS run_id, id || '-' || run_id AS id, rule_id, title, severity, 'mask' AS value_masked FROM findings),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {RANK}, rule_id, id) AS k, count(*) OVER (PARTITION BY run_id) AS total FROM m),
tl AS (SELECT run_id, concat_ws(', ', {', '.join(f"CASE WHEN count(*) FILTER (WHERE severity = '{s}') > 0 THEN count(*) FILTER (WHERE severity = '{s}') || ' {s}' END" for s in SEV)}) AS tally FROM m GROUP BY run_id)
SELECT run_id, CAST(total AS BIGINT) AS total, tally, string_agg('- [' || severity || '] ' || title || ' (' || rule_id || ') = ' || value_masked, chr(10) ORDER BY k) || CASE WHEN total > 40 THEN chr(10) || '- ... and ' || (total - 40) || ' more, already counted above' ELSE '' END AS lines
FROM r JOIN tl USING (run_id) WHERE k <= 40 GROUP BY run_id, total, tally""", ("findings",))
def _(t):
    run = F.concat(F.lit("pkg-"), F.substring("run_id", 2, 20).cast("bigint") % 7)
    found = t.view("findings").select(run.alias("run_id"), F.concat("id", F.lit("-"), "run_id").alias("id"), "rule_id", "title", "severity", F.lit("mask").alias("value_masked"))
    return D.summary_context(found)


@query("agg_19_requeue_attempts", "SELECT run_id, CAST(count(*) AS BIGINT) AS attempts FROM run_updates WHERE status = 'queued' GROUP BY run_id", ("run_updates",))
def _(t):
    from outfall.streaming.recovery import requeue_attempts

    audit = t.view("run_updates").select("run_id", F.when(F.col("status") == "queued", "run_requeued").otherwise("run_started").alias("action"))
    return requeue_attempts(audit)


@query("agg_20_stage_status", """SELECT event_id, CASE WHEN event_id % 10 = 7 THEN 'truncated' WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'completed' WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'signup' THEN 'oom' ELSE 'failed' END AS status,
 CASE WHEN event_id % 10 = 7 THEN 'depth; size of ' || user_id END AS error, round(value, 3) AS duration_s FROM events""")
def _(t):
    kind = F.col("event_type")
    results = t.table("events").select(
        "event_id", F.when(kind == "view", "completed").when(kind == "error", "timeout").when(kind == "signup", "oom").otherwise("error").alias("outcome"),
        (F.col("event_id") % 3).alias("exit_code"), (F.col("event_id") % 10 == 7).alias("truncated"),
        F.array(F.lit("depth"), F.concat(F.lit("size of "), "user_id")).alias("reasons"), F.col("value").alias("duration_s"))
    return D.stage_status(results).select("event_id", "status", "error", "duration_s")


# --- exports -----------------------------------------------------------------------
LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"


@query("snk_02_sarif_results", f"""WITH {LINKED}, l AS (SELECT run_id, finding_id AS id, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS uri, arg_min(byte_offset, (path_in_tree, byte_offset)) AS byte_offset FROM finding_locations GROUP BY ALL)
SELECT f.run_id, f.rule_id, CAST(dense_rank() OVER (PARTITION BY f.run_id ORDER BY f.rule_id) - 1 AS INT) AS rule_index, {LEVEL} AS level, title || ': ****' || CASE WHEN o.id IS NULL THEN ' (introduced by this build)' ELSE '' END AS message,
 coalesce(uri, 'unknown') AS uri, byte_offset, CASE WHEN byte_offset IS NOT NULL THEN 4 END AS byte_length, f.id AS fingerprint, severity, category, status, o.id IS NULL AS is_new
FROM findings f LEFT JOIN l ON l.run_id = f.run_id AND l.id = f.id LEFT JOIN old o ON o.run_id = f.run_id AND o.id = f.id""", RFL)
def _(t):
    found = t.view("findings")
    return X.sarif_rows(projected(t, found, X.with_rule_index(found)).withColumn("value_masked", F.lit("****")))


@query("snk_02_sarif_rules", f"""WITH w AS (SELECT *, {RANK} AS rank FROM findings), g AS (SELECT run_id, rule_id, arg_min(severity, rank) AS worst, min(title) AS title, min(category) AS category FROM w GROUP BY ALL)
SELECT run_id, rule_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY rule_id) - 1 AS INT) AS rule_index, title, category, worst, CASE worst WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
 CASE worst WHEN 'critical' THEN '9.5' WHEN 'high' THEN '7.5' WHEN 'medium' THEN '5.0' WHEN 'low' THEN '3.0' ELSE '1.0' END AS security_severity FROM g""", ("findings",))
def _(t):
    return X.sarif_rule_rows(t.view("findings"))


@query("snk_06_rule_catalog", f"""WITH {O.scan_ctes()} SELECT r.category, CAST(count(DISTINCT r.rule_id) AS BIGINT) AS rules, CAST(count(k.val) AS BIGINT) AS hits FROM rules r LEFT JOIN kept k USING (rule_id) GROUP BY r.category""", ("texts",))
def _(t):
    pack = builtin_pack()
    hits = match.scan(t.artifacts(), pack, ["path_in_tree"]).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return pack.rules_df(t.spark).join(hits, "rule_id", "left").groupBy("category").agg(F.count("*").alias("rules"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
