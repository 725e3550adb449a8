"""Queries on run history: predecessors, differences, summaries, posture."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.operators import runs as R
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query

SEV = ["critical", "high", "medium", "low", "info"]
COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS {s}" for s in SEV)
PREV = """prev AS (SELECT *, last_value(CASE WHEN status = 'completed' THEN run_id END IGNORE NULLS) OVER (PARTITION BY name ORDER BY created_at, run_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run_id FROM runs)"""
LINKED = f"""{PREV}, old AS (SELECT DISTINCT p.run_id, f.id FROM prev p JOIN findings f ON f.run_id = p.previous_run_id),
now_ AS (SELECT DISTINCT f.run_id, f.id FROM findings f JOIN prev p ON p.run_id = f.run_id WHERE p.previous_run_id IS NOT NULL),
diff AS (SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'fixed' ELSE 'inherited' END AS change
  FROM now_ n FULL JOIN old o ON n.run_id = o.run_id AND n.id = o.id)"""
TOTALS = f"totals AS (SELECT r.*, {COUNTS}, CAST(count(severity) AS BIGINT) AS total FROM runs r LEFT JOIN (SELECT run_id, severity FROM findings) f USING (run_id) GROUP BY ALL)"
RF = ("runs", "findings")
FILES = "files AS (SELECT 'r' || l_orderkey AS run_id, count(DISTINCT l_suppkey % 100) AS artifact_count FROM lineitem GROUP BY 1)"


def links(t: Inputs):
    return R.previous_runs(t.view("runs")).select("run_id", F.col("previous_run_id").alias("baseline_id"))


def files(t: Inputs):
    """Artifacts of each run: the distinct files its findings were seen in."""
    return t.view("finding_locations").select("run_id", "path_in_tree").distinct()


def summary(t: Inputs):
    return R.run_summary(t.view("runs"), t.view("findings"), files(t), links(t))


@query("jon_05_baseline_is_new", f"WITH {LINKED} SELECT f.run_id, f.id, o.id IS NULL AS is_new FROM findings f LEFT JOIN old o ON f.run_id = o.run_id AND f.id = o.id", RF)
def _(t):
    found = t.view("findings")
    return R.with_is_new(found, R.baseline_ids(links(t), found)).select("run_id", "id", "is_new")


@query("jon_06_run_diff", f"WITH {LINKED} SELECT run_id, id, change FROM diff", RF)
def _(t):
    return R.run_diff(t.view("findings"), links(t))


@query("jon_07_previous_run", f"WITH {PREV} SELECT run_id, name, previous_run_id FROM prev", ("runs",))
def _(t):
    return R.previous_runs(t.view("runs")).select("run_id", "name", "previous_run_id")


@query("jon_08_expected_duration", """WITH done AS (SELECT root_sha256, run_id, finished_at, epoch(finished_at - started_at)::DOUBLE AS seconds FROM runs WHERE status = 'completed'),
two AS (SELECT *, row_number() OVER (PARTITION BY root_sha256 ORDER BY finished_at DESC, run_id DESC) AS k FROM done QUALIFY k <= 2)
SELECT r.run_id, CASE WHEN a.run_id = r.run_id THEN b.seconds ELSE a.seconds END AS expected_s FROM runs r
LEFT JOIN two a ON a.root_sha256 = r.root_sha256 AND a.k = 1 LEFT JOIN two b ON b.root_sha256 = r.root_sha256 AND b.k = 2""", ("runs",))
def _(t):
    return R.expected_duration(t.view("runs")).select("run_id", "expected_s")


REQUESTS = """requests AS (SELECT p.run_id, o_custkey % 9 = 0 AS has_supplied_ids, CASE WHEN o_custkey % 4 = 0 THEN 'r' || o_custkey END AS baseline_run_id, p.previous_run_id
 FROM prev p JOIN orders ON p.run_id = 'r' || o_orderkey)"""


@query("jon_09_baseline_precedence", f"""WITH {PREV}, {REQUESTS}, c AS (SELECT q.*, b.run_id AS found FROM requests q LEFT JOIN runs b ON b.run_id = coalesce(q.baseline_run_id, q.previous_run_id) AND b.status = 'completed')
SELECT run_id, CASE WHEN has_supplied_ids THEN 'supplied_ids' WHEN found IS NULL THEN 'none' WHEN baseline_run_id IS NOT NULL THEN 'explicit_run' ELSE 'previous_run' END AS source,
 CASE WHEN NOT has_supplied_ids THEN found END AS baseline_id FROM c""", ("runs",))
def _(t):
    extra = t.table("orders").select(
        F.concat(F.lit("r"), "o_orderkey").alias("run_id"), (F.col("o_custkey") % 9 == 0).alias("has_supplied_ids"),
        F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("r"), "o_custkey")).alias("baseline_run_id"))
    requests = R.previous_runs(t.view("runs")).select("run_id", "previous_run_id").join(extra, "run_id")
    return R.resolve_baselines(requests, t.view("runs")).select("run_id", "source", "baseline_id")


@query("set_03_introduced", f"WITH {LINKED} SELECT run_id, id FROM now_ EXCEPT SELECT run_id, id FROM old", RF)
def _(t):
    found, link = t.view("findings"), links(t)
    current = found.select("run_id", "id").distinct().join(link.where("baseline_id IS NOT NULL"), "run_id", "left_semi")
    return current.exceptAll(R.baseline_ids(link, found))


@query("set_04_inherited", f"WITH {LINKED} SELECT run_id, id FROM now_ INTERSECT SELECT run_id, id FROM old", RF)
def _(t):
    found = t.view("findings")
    return found.select("run_id", "id").intersect(R.baseline_ids(links(t), found))


@query("set_05_reproducibility", """WITH m AS (SELECT run_id, root_sha256 AS fingerprint FROM runs), p AS (SELECT fingerprint, id, count(*) AS seen FROM (SELECT DISTINCT run_id, id FROM findings) JOIN m USING (run_id) GROUP BY ALL),
n AS (SELECT fingerprint, count(*) AS runs FROM m GROUP BY 1) SELECT fingerprint, CAST(runs AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS ids, CAST(count(*) FILTER (WHERE seen < runs) AS BIGINT) AS unstable_ids
FROM p JOIN n USING (fingerprint) GROUP BY fingerprint, runs""", RF)
def _(t):
    return R.reproducible(t.view("findings"), t.view("runs").withColumnRenamed("root_sha256", "fingerprint"))


@query("agg_05_severity_counts", f"""WITH {LINKED} SELECT f.run_id, {COUNTS}, {', '.join(f"CAST(count(*) FILTER (WHERE severity = '{s}' AND o.id IS NULL) AS BIGINT) AS new_{s}" for s in SEV)}
FROM findings f LEFT JOIN old o ON f.run_id = o.run_id AND f.id = o.id GROUP BY f.run_id""", RF)
def _(t):
    found = t.view("findings")
    marked = R.with_is_new(found, R.baseline_ids(links(t), found))
    return R.severity_counts(marked, new=F.col("is_new"))


@query("agg_06_category_rollup", """SELECT run_id, category, CAST(count(*) AS BIGINT) AS findings,
 ['critical', 'high', 'medium', 'low', 'info'][min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END)] AS worst FROM findings GROUP BY run_id, category""", ("findings",))
def _(t):
    return R.category_rollup(t.view("findings")).orderBy("run_id", F.desc("findings"), "category")


@query("agg_13_degraded_stages", """SELECT r.run_id, CASE WHEN s.error IS NULL THEN 'completed' ELSE 'degraded' END AS status, coalesce(s.error, '') AS error FROM runs r LEFT JOIN
 (SELECT run_id, string_agg(DISTINCT analyzer || ' (' || status || ')', '; ' ORDER BY analyzer || ' (' || status || ')') AS error FROM stages WHERE status IN ('timeout', 'oom', 'failed', 'truncated') GROUP BY run_id) s USING (run_id)""", ("runs", "stages"))
def _(t):
    return R.run_status(t.view("runs"), t.view("stages"))


@query("agg_17_run_summary", f"""WITH {LINKED}, {TOTALS}, {FILES}, nw AS (SELECT run_id, count(*) AS n FROM diff WHERE change = 'new' GROUP BY run_id)
SELECT t.run_id, t.name, t.status, total AS finding_count, {', '.join(SEV)}, CAST(coalesce(artifact_count, 1) AS BIGINT) AS artifact_count,
 CAST(CASE WHEN p.previous_run_id IS NOT NULL THEN coalesce(nw.n, 0) END AS BIGINT) AS new_since_previous
FROM totals t JOIN prev p USING (run_id) LEFT JOIN files USING (run_id) LEFT JOIN nw USING (run_id)""", RF)
def _(t):
    return summary(t)


@query("agg_14_fleet_posture", f"""WITH {LINKED}, {TOTALS}, {FILES}, nw AS (SELECT run_id, count(*) AS n FROM diff WHERE change = 'new' GROUP BY run_id),
s AS (SELECT t.*, coalesce(artifact_count, 1) AS artifact_count, coalesce(nw.n, 0) AS n FROM totals t LEFT JOIN files USING (run_id) LEFT JOIN nw USING (run_id)),
cur AS (SELECT * FROM s WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY coalesce(name, run_id) ORDER BY created_at DESC, run_id DESC) = 1)
SELECT CAST(count(*) AS BIGINT) AS artifacts, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in SEV)}, CAST(sum(critical + high) AS BIGINT) AS blocking, CAST(sum(artifact_count) AS BIGINT) AS files_analysed,
 (SELECT CAST(sum(n) AS BIGINT) FROM s WHERE status = 'completed') AS introduced, (SELECT count(*) FROM s WHERE status = 'failed') AS failed_runs, (SELECT count(*) FROM s WHERE status = 'degraded') AS degraded_runs FROM cur""", RF)
def _(t):
    return R.fleet_posture(summary(t).join(t.view("runs").select("run_id", "created_at"), "run_id"))


@query("win_04_latest_per_artifact", """SELECT coalesce(name, run_id) AS artifact, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY coalesce(name, run_id) ORDER BY created_at DESC, run_id DESC) = 1""", ("runs",))
def _(t):
    return R.latest_per_artifact(t.view("runs"))


@query("win_07_severity_trend", f"""WITH {TOTALS} SELECT run_id, created_at, {', '.join(SEV)}, total, CAST(greatest(max(total) OVER (), 1) AS BIGINT) AS ceiling FROM totals WHERE status = 'completed'""", RF)
def _(t):
    return R.severity_trend(t.view("runs"), t.view("findings")).orderBy("created_at", "run_id")


@query("win_08_run_over_run", f"""WITH {TOTALS}, l AS (SELECT *, lag(total) OVER (PARTITION BY name ORDER BY created_at, run_id) AS previous_total FROM totals)
SELECT run_id, name, total, previous_total, coalesce(total > previous_total, false) AS rising FROM l""", RF)
def _(t):
    return R.run_over_run(t.view("runs"), t.view("findings")).select("run_id", "name", "total", "previous_total", "rising")


@query("win_11_first_seen", """SELECT f.run_id, f.id, first_value(f.run_id) OVER (PARTITION BY name, f.id ORDER BY created_at, f.run_id) AS first_seen_run_id FROM findings f JOIN runs r ON r.run_id = f.run_id""", RF)
def _(t):
    return R.first_seen(t.view("findings"), t.view("runs"))


@query("srt_04_runs_page", "SELECT run_id, name, status, created_at FROM runs ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 100", ("runs",))
def _(t):
    return t.view("runs").select("run_id", "name", "status", "created_at").orderBy(F.desc("created_at"), "run_id").offset(100).limit(50)


@query("agg_12_stage_evidence", """SELECT run_id, CASE encoding WHEN 'ascii' THEN 'static' ELSE 'static-wide' END AS analyzer, CAST(count(*) AS BIGINT) AS evidence_count FROM evidence GROUP BY ALL""", ("evidence",))
def _(t):
    analyzer = F.when(F.col("encoding") == "ascii", "static").otherwise("static-wide").alias("analyzer")
    return t.evidence().groupBy("run_id", analyzer).agg(F.count("*").alias("evidence_count"))
