"""Queries on progress, recovery, claims, streams, stored runs and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.functions.register import register_functions
from outfall.operators import extract
from outfall.operators import gate as G
from outfall.operators import match
from outfall.plans import scan as PS
from outfall.queries import oracle as O
from outfall.queries.findings import RANK
from outfall.queries.inputs import VIEWS, Inputs
from outfall.queries.registry import query
from outfall.rules.pack import builtin_pack
from outfall.session import cut
from outfall.sources.policies import Policy
from outfall.sources.sinks import read_manifest, read_run, scratch
from outfall.streaming import progress as PR
from outfall.streaming.recovery import orphan_sweep, requeue_attempts
from outfall.streaming.scan import read_findings, read_verdicts, scan_stream

U = ("run_updates",)
TERMINAL = "('completed', 'degraded', 'failed', 'cancelled')"


@query("stm_01_run_phase", f"""WITH s AS (SELECT run_id, arg_max(status, (ts, event_id)) AS status, arg_max(stage_status, (ts, event_id)) FILTER (WHERE analyzer = 'unpack') AS "unpack", arg_max(stage_status, (ts, event_id)) FILTER (WHERE analyzer = 'static') AS static FROM run_updates GROUP BY run_id)
SELECT *, CASE WHEN status IN {TERMINAL} THEN 'done' WHEN static IN ('pending', 'running') THEN 'static' WHEN static IS NOT NULL THEN 'report' WHEN "unpack" IN ('pending', 'running') THEN 'unpack' WHEN "unpack" IS NOT NULL THEN 'index' ELSE 'queued' END AS phase FROM s""", U)
def _(t):
    return PR.run_phase(t.view("run_updates"))


CHANGES = f"""p AS (SELECT *, status || '|' || analyzer || '|' || stage_status AS payload FROM run_updates), l AS (SELECT *, lag(payload) OVER w AS before, min(CASE WHEN status IN {TERMINAL} THEN (ts, event_id) END) OVER (PARTITION BY run_id) AS fin FROM p WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id))"""


@query("stm_02_progress_changes", f"WITH {CHANGES} SELECT run_id, ts, event_id, payload FROM l WHERE payload IS DISTINCT FROM before AND (fin IS NULL OR (ts, event_id) <= fin)", U)
def _(t):
    return PR.progress_changes(t.view("run_updates"))


@query("stm_02_progress_stream", f"WITH {CHANGES} SELECT run_id, event_id, payload FROM l WHERE payload IS DISTINCT FROM before AND (fin IS NULL OR (ts, event_id) <= fin)", U)
def _(t):
    """The stateful stream over the events table, drained once, read back from its sink."""
    return _drain(t, PR.progress_stream(_updates(t)), "progress").select("run_id", "event_id", "payload")


def _updates(t: Inputs):
    schema = t.table("events").schema
    t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).createOrReplaceTempView("events")
    return t.spark.sql(VIEWS["run_updates"])


def _drain(t: Inputs, stream, name: str):
    base = scratch(t.spark, name)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").option("path", f"{base}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


SWEEP = """runs_ AS (SELECT 'e' || event_id AS run_id, status, ts AS created_at, CASE WHEN status = 'running' OR event_id % 4 = 0 THEN ts + INTERVAL 5 MINUTE END AS started_at FROM run_updates),
audit_ AS (SELECT 'e' || (event_id % 997) AS run_id, count(*) AS attempts FROM run_updates WHERE stage_status IN ('timeout', 'truncated') AND status = 'error' OR event_id % 5 = 0 GROUP BY 1),
aged AS (SELECT r.*, coalesce(attempts, 0) AS attempts, CAST(trunc(epoch(TIMESTAMP '2024-01-16 00:00:00') - epoch(coalesce(started_at, created_at))) AS BIGINT) AS age_s FROM runs_ r LEFT JOIN audit_ USING (run_id) WHERE status IN ('queued', 'running'))"""


@query("stm_03_orphan_sweep", f"""WITH {SWEEP}, d AS (SELECT *, CASE WHEN status = 'queued' AND started_at IS NULL THEN CASE WHEN age_s >= 300 THEN CASE WHEN attempts >= 2 THEN 'fail' ELSE 'requeue' END END WHEN age_s >= 3600 THEN 'fail' END AS action FROM aged)
SELECT run_id, action, age_s, CAST(attempts AS BIGINT) AS attempts, CASE WHEN status = 'queued' AND started_at IS NULL AND attempts >= 2 THEN 'orphaned in the queue: no worker claimed it after ' || attempts || ' requeue attempts'
 WHEN status = 'queued' AND started_at IS NULL THEN 'queued past the grace period with no worker' ELSE 'orphaned mid-analysis: no progress for ' || age_s || 's, past every stage timeout' END AS reason FROM d WHERE action IS NOT NULL""", U)
def _(t):
    rows = t.view("run_updates")
    started = F.when((F.col("status") == "running") | (F.col("event_id") % 4 == 0), F.expr("ts + INTERVAL 5 MINUTE"))
    runs = rows.select(F.concat(F.lit("e"), "event_id").alias("run_id"), "status", F.col("ts").alias("created_at"), started.alias("started_at"))
    audited = rows.where("stage_status IN ('timeout', 'truncated') AND status = 'error' OR event_id % 5 = 0")
    audit = audited.select(F.concat(F.lit("e"), F.col("event_id") % 997).alias("run_id"), F.lit("run_requeued").alias("action"))
    return orphan_sweep(runs, requeue_attempts(audit), F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'"))


@query("stm_03_overdue_stream", """WITH l AS (SELECT run_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS last_ts FROM run_updates GROUP BY run_id)
SELECT run_id, status FROM l WHERE status IN ('queued', 'running') AND last_ts + INTERVAL 12 HOUR <= (SELECT max(ts) FROM run_updates) - INTERVAL 1 HOUR""", U)
def _(t):
    """Open runs that no update has reached for half a day, from timers of the stream."""
    return _drain(t, PR.overdue_stream(_updates(t), 12 * 3600), "overdue").select("run_id", "status")


def step():
    return F.concat("run_id", F.lit(":"), "status")


@query("stm_04_claim_once", "SELECT run_id || ':' || status AS run_id, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, CAST(count(*) AS BIGINT) AS deliveries FROM run_updates GROUP BY ALL", U)
def _(t):
    """Each step of a run is claimed once."""
    return PR.claim_once(t.view("run_updates").withColumn("run_id", step()))


@query("stm_04_claim_stream", "SELECT DISTINCT run_id || ':' || status AS run_id FROM run_updates", U)
def _(t):
    claims = _updates(t).select(step().alias("run_id"), "ts", "event_id")
    return _drain(t, PR.claim_stream(claims, "3650 days"), "claims").select("run_id")


DOCS = "texts AS (SELECT 'documents/' || doc_id AS path_in_tree, text AS content FROM documents)"


def scored(source: str, run: str) -> str:
    """Findings of the SQL scan, clusters left out when no rule has more than 20 values in a run."""
    return f"""{O.scan_ctes()}, ev AS (SELECT {run} AS run_id, path_in_tree, rule_id, sha256(val) AS value_hash, byte_offset, title, severity FROM kept {source}),
one AS (SELECT run_id, rule_id, value_hash, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS p, CAST(arg_min(byte_offset, (path_in_tree, byte_offset)) AS BIGINT) AS o, any_value(severity) AS severity FROM ev GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY run_id, rule_id) AS members, substr(sha256(rule_id || chr(31) || value_hash || chr(31) || p || chr(31) || o), 1, 32) AS id FROM one)"""


@query("stm_05_scan_stream", f"""WITH {DOCS}, {scored("JOIN documents ON path_in_tree = 'documents/' || doc_id", "'docs-' || lang")}
SELECT run_id, rule_id, severity, CAST(sum(CASE WHEN members > 20 THEN 0 ELSE 1 END) AS BIGINT) AS single_findings, CAST(max(CASE WHEN members > 20 THEN 1 ELSE 0 END) AS BIGINT) AS clusters FROM sized GROUP BY run_id, rule_id, severity""")
def _(t):
    """Stream the documents table through the scan, in several micro-batches; the stored findings equal the batch ones."""
    base = _streamed(t)
    single = F.col("title").endswith("distinct values)")
    return read_findings(t.spark, base).groupBy("run_id", "rule_id", "severity").agg(
        F.count(F.when(~single, 1)).alias("single_findings"), F.count(F.when(single, 1)).alias("clusters"))


@query("stm_05_stream_gate", f"""WITH {DOCS}, {scored("JOIN documents ON path_in_tree = 'documents/' || doc_id", "'docs-' || lang")}, f AS (SELECT DISTINCT run_id, severity, CASE WHEN members > 20 THEN rule_id ELSE id END AS fid FROM sized)
SELECT r.run_id, CASE WHEN count(*) FILTER (WHERE severity IN ('critical', 'high')) > 0 THEN 'blocked' ELSE 'pass' END AS decision, count(fid) AS total_findings, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS violations
FROM (SELECT DISTINCT 'docs-' || lang AS run_id FROM documents) r LEFT JOIN f ON f.run_id = r.run_id GROUP BY r.run_id""")
def _(t):
    """The decision that the last micro-batch of each run left."""
    return read_verdicts(t.spark, _streamed(t)).select("run_id", "decision", "total_findings", "violations")


#: Bytes of text in a landed file, about.
LANDED_BYTES = 64 << 20


def _streamed(t: Inputs) -> str:
    """The documents in files of bounded size, half of them for each of two micro-batches, streamed through scan and gate."""
    base = scratch(t.spark, "scan")
    texts = t.table("documents").select(F.concat(F.lit("docs-"), "lang").alias("run_id"), F.concat(F.lit("documents/"), "doc_id").alias("path_in_tree"), F.encode("text", "UTF-8").alias("content"))
    size = texts.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    half = size // (2 * LANDED_BYTES) + 1
    texts.repartition(2 * half, "path_in_tree").write.parquet(f"{base}/landed")
    landed = t.spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", half).parquet(f"{base}/landed")
    scan_stream(landed, builtin_pack(), base, [Policy()], F.expr("DATE '2024-02-15'")).awaitTermination()
    return base


@query("snk_01_write_run", f"""WITH {scored("", "regexp_extract(path_in_tree, '^[^/ ]+', 0)")}
SELECT run_id, CAST((SELECT count(*) FROM ev WHERE ev.run_id = s.run_id) AS BIGINT) AS evidence, CAST(sum(CASE WHEN members > 20 THEN 0 ELSE 1 END) + count(DISTINCT CASE WHEN members > 20 THEN rule_id END) AS BIGINT) AS findings FROM sized s GROUP BY run_id""", ("texts",))
def _(t):
    """Scan into tables twice; the second write replaces the first."""
    run = F.regexp_extract("path_in_tree", "^[^/ ]+", 0)
    artifacts = t.artifacts().withColumn("run_id", run)
    base = scratch(t.spark, "runs")
    for _ in range(2):
        PS.scan_to_tables(artifacts, builtin_pack(), base)
    manifest = read_manifest(t.spark, base)
    rows = manifest.groupBy("run_id").agg(F.max(F.when(F.col("table") == "evidence", F.col("rows"))).alias("evidence"), F.max(F.when(F.col("table") == "findings", F.col("rows"))).alias("findings"))
    there = read_run(t.spark, base, "evidence", t.spark.createDataFrame([], "run_id string")).groupBy("run_id").agg(F.count("*").alias("evidence"))
    return rows.join(there, ["run_id", "evidence"])


@query("gat_06_scan_and_gate", f"""WITH {scored("", "'release'")}, f AS (SELECT rule_id, severity, CASE WHEN members > 20 THEN rule_id ELSE id END AS fid FROM sized), d AS (SELECT DISTINCT * FROM f)
SELECT 'release' AS run_id, CASE WHEN count(*) FILTER (WHERE severity IN ('critical', 'high')) > 0 THEN 'blocked' ELSE 'pass' END AS decision, count(*) AS total_findings, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS violations FROM d""", ("texts",))
def _(t):
    """From raw texts to a release decision."""
    from outfall.operators import correlate as C

    evidence = cut(match.scan(t.artifacts(), builtin_pack(), ["path_in_tree"]).withColumn("run_id", F.lit("release")))
    result = C.correlate(evidence, PS.rule_dimension(builtin_pack(), t.spark))
    gate: G.Gate = PS.gate_new(result.findings, result.locations, [Policy()], F.expr("DATE '2024-02-15'"))
    return gate.verdicts.select("run_id", "decision", "total_findings", "violations")


# --- SQL functions ---------------------------------------------------------------------
@query("udf_01_sql_functions", f"""WITH {O.strings_ctes()} SELECT path_in_tree, byte_offset, round({O.entropy('value')}, 6) AS entropy, {O.mask('value')} AS masked, substr(sha256('r' || chr(31) || sha256(value) || chr(31) || path_in_tree || chr(31) || byte_offset), 1, 32) AS id,
 CAST(least(byte_offset % 7, 5) + CASE WHEN byte_offset % 7 >= 5 THEN 94 ELSE 0 END AS INT) AS rank, regexp_replace(value, '([A-Za-z0-9+/=_-]{{4}})[A-Za-z0-9+/=_-]{{12,}}([A-Za-z0-9+/=_-]{{4}})', '\\1••••••••••••\\2', 'g') AS hidden FROM strings""", ("texts",))
def _(t):
    register_functions(t.spark)
    extract.extract_strings(t.artifacts(), ["path_in_tree"]).createOrReplaceTempView("outfall_strings")
    return t.spark.sql("""SELECT path_in_tree, byte_offset, round(outfall_entropy(value), 6) AS entropy, outfall_mask(value) AS masked,
        outfall_finding_id('r', sha2(value, 256), path_in_tree, byte_offset) AS id, outfall_severity_rank(element_at(array('critical', 'high', 'medium', 'low', 'info', 'none', ''), CAST(byte_offset % 7 AS INT) + 1)) AS rank, outfall_mask_secretish(value) AS hidden FROM outfall_strings""")


@query("udf_02_lateral_strings", f"WITH {O.strings_ctes()} SELECT path_in_tree, value, byte_offset, 'ascii' AS encoding FROM strings", ("texts",))
def _(t):
    register_functions(t.spark)
    t.artifacts().createOrReplaceTempView("outfall_artifacts")
    return t.spark.sql("SELECT a.path_in_tree, s.* FROM outfall_artifacts a, LATERAL outfall_strings(a.content) s")
