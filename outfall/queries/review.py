"""Queries on review: prompts, verdicts, proposals, status changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators import correlate as C
from outfall.operators import triage as V
from outfall.operators.gate import first_locations
from outfall.queries.findings import ALL, EV, RANK, rules
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query
from outfall.session import cut

PLACED = f"""{ALL}, ids AS (SELECT r.run_id, r.rule_id, r.value_hash, coalesce(c.id, r.id) AS finding_id FROM ranked r LEFT JOIN clusters c USING (run_id, rule_id)),
locs AS (SELECT DISTINCT run_id, finding_id AS id, path_in_tree, byte_offset FROM evidence JOIN ids USING (run_id, rule_id, value_hash)),
firsts AS (SELECT run_id, id, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS artifact_path, count(*) AS location_count FROM locs GROUP BY ALL),
placed AS (SELECT f.*, artifact_path, location_count FROM final f JOIN firsts USING (run_id, id)),
prompts AS (SELECT run_id, id, rule_id, value_hash, severity, 'Rule: ' || rule_id || chr(10) || 'Category: ' || category || chr(10) || 'Rule severity: ' || severity || chr(10) || 'Masked value: ' || value_masked || chr(10)
 || 'Value length: ' || length(value_masked) || ' (masked)' || chr(10) || 'Entropy: ' || entropy || chr(10) || 'Found in: ' || artifact_path || chr(10) || 'Occurrences in artifact: ' || location_count AS prompt FROM placed)"""


def placed(t: Inputs):
    """The findings with their first places; what reads them more than once stores them first."""
    result = C.correlate(t.evidence(), rules(t))
    return result.findings.join(first_locations(result.locations), ["run_id", "id"])


def prompts(t: Inputs):
    return V.triage_prompts(placed(t))


@query("tri_01_triage_prompts", f"WITH {PLACED} SELECT run_id, id, rule_id, value_hash, severity, prompt, sha256(prompt) AS prompt_hash FROM prompts", EV)
def _(t):
    return prompts(t)


@query("fn_18_explain_prompt", f"""WITH {PLACED} SELECT run_id, id, 'Rule: ' || rule_id || chr(10) || 'Category: ' || category || chr(10) || 'Title: ' || title || chr(10) || 'Severity: ' || severity || chr(10) || 'Masked value: ' || value_masked || chr(10)
 || 'Entropy: ' || entropy || chr(10) || 'Found in: ' || artifact_path || chr(10) || 'Occurrences in artifact: ' || location_count || chr(10) || 'CWE: CWE-200' AS prompt FROM placed""", EV)
def _(t):
    rows = placed(t).withColumns({"cwe": F.lit("CWE-200"), "remediation": F.lit(None).cast("string")})
    return rows.select("run_id", "id", V.explain_prompt().alias("prompt"))


# several findings share a rule and a value: ids differ by run, so runs are merged here
MERGED = "merged AS (SELECT 'all' AS run_id, id || '-' || run_id AS id, rule_id, value_hash, severity, prompt FROM prompts)"


@query("tri_02_triage_dedupe", f"""WITH {PLACED}, {MERGED} SELECT run_id, rule_id, value_hash, arg_min(id, ({RANK}, id)) AS id, CAST(count(*) AS BIGINT) AS findings FROM merged GROUP BY run_id, rule_id, value_hash""", EV)
def _(t):
    merged = prompts(t).withColumns({"id": F.concat("id", F.lit("-"), "run_id"), "run_id": F.lit("all")})
    return V.triage_calls(merged).select("run_id", "rule_id", "value_hash", "id", "findings")


VERDICT = "CASE ascii(substr(value_hash, 1, 1)) % 5 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'error' END"


def verdicts(found):
    digit = F.ascii(F.substring("value_hash", 1, 1)) % 5
    verdict = F.when(digit == 0, "true_positive").when(digit == 1, "false_positive").when(digit == 2, "needs_review").when(digit == 3, "error")
    calls = V.triage_calls(V.triage_prompts(found)).withColumn("verdict", verdict)
    return calls.withColumn("duration_s", F.length("prompt") / 100.0)


def judged(found):
    return V.apply_verdicts(found.withColumns({"status": F.lit("open"), "detected_by": F.lit("rule")}), verdicts(found))


JUDGED = f"""{PLACED}, judged AS (SELECT *, {VERDICT} AS verdict FROM placed)"""


@query("tri_03_apply_verdicts", f"""WITH {JUDGED} SELECT run_id, id, severity, verdict, CASE WHEN verdict IS NULL OR verdict = 'error' THEN 'open' WHEN verdict = 'false_positive' AND {RANK} <= 1 THEN 'needs_review' WHEN verdict = 'false_positive' THEN 'false_positive'
 WHEN verdict = 'true_positive' THEN 'confirmed' ELSE 'needs_review' END AS status, CASE WHEN verdict IS NULL OR verdict = 'error' THEN 'rule' ELSE 'both' END AS detected_by FROM judged""", EV)
def _(t):
    return judged(cut(placed(t))).select("run_id", "id", "severity", "verdict", "status", "detected_by")


@query("jon_15_verdict_findings", f"""WITH {JUDGED} SELECT run_id, severity, coalesce(verdict, 'none') AS verdict, CAST(count(*) AS BIGINT) AS findings, CAST(count(*) FILTER (WHERE verdict = 'false_positive' AND {RANK} <= 1) AS BIGINT) AS floored FROM judged GROUP BY run_id, severity, coalesce(verdict, 'none')""", EV)
def _(t):
    verdict = F.coalesce("verdict", F.lit("none"))
    floored = (F.col("verdict") == "false_positive") & (F.col("status") == "needs_review")
    return judged(cut(placed(t))).groupBy("run_id", "severity", verdict.alias("verdict")).agg(F.count("*").alias("findings"), F.count(F.when(floored, 1)).alias("floored"))


@query("agg_16_triage_summary", f"""WITH {JUDGED}, s AS (SELECT run_id, round(sum(length(prompt) / 100.0::DOUBLE), 2) AS duration_s FROM prompts GROUP BY run_id)
SELECT run_id, CAST(count(*) AS BIGINT) AS triaged, CAST(count(*) FILTER (WHERE verdict = 'true_positive') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE verdict = 'false_positive') AS BIGINT) AS dismissed,
 CAST(count(*) FILTER (WHERE verdict = 'needs_review') AS BIGINT) AS needs_review, CAST(count(*) FILTER (WHERE verdict = 'error') AS BIGINT) AS errors, any_value(duration_s) AS duration_s FROM judged JOIN s USING (run_id) WHERE verdict IS NOT NULL GROUP BY run_id""", EV)
def _(t):
    found = cut(placed(t))
    return V.triage_summary(judged(found), verdicts(found))


# replies in the shapes models give: plain, fenced, wrapped in prose, broken, unknown word
def replies(t: Inputs):
    n = F.col("doc_id") % 5
    body = F.concat(F.lit('{"verdict": "'), F.when(F.col("toxic") == 1, "True_Positive ").otherwise("false_positive"), F.lit('", "reasoning": "label '), "quality", F.lit('"}'))
    text = (
        F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Sure. "), body, F.lit(" Hope it helps.")))
        .when(n == 3, F.lit("I cannot tell {")).otherwise(F.lit('{"verdict": "maybe"}'))
    )
    return t.table("labels").select("doc_id", text.alias("response"))


@query("tri_04_parse_verdicts", """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN CASE WHEN toxic = 1 THEN 'true_positive' ELSE 'false_positive' END ELSE 'error' END AS verdict,
 CASE WHEN doc_id % 5 < 3 THEN 'label ' || quality WHEN doc_id % 5 = 3 THEN 'model did not return parseable JSON' ELSE 'unrecognised verdict ''maybe''' END AS reasoning FROM labels""")
def _(t):
    return V.parse_verdicts(replies(t)).drop("response")


@query("fn_16_tolerant_json", """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN '{"verdict": "' || CASE WHEN toxic = 1 THEN 'True_Positive ' ELSE 'false_positive' END || '", "reasoning": "label ' || quality || '"}' WHEN doc_id % 5 = 4 THEN '{"verdict": "maybe"}' END AS payload FROM labels""")
def _(t):
    return replies(t).select("doc_id", T.tolerant_json(F.col("response")).alias("payload"))


@query("tri_05_validate_proposals", """WITH p AS (SELECT p_partkey, p_partkey // 8 AS batch_id, p_partkey % 8 AS ordinal, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey % 8) AS place FROM part)
SELECT batch_id, ordinal, CASE ordinal WHEN 0 THEN 'unnamed-proposal' ELSE 'prop-' || p_partkey END AS rule_id, CASE ordinal WHEN 1 THEN 'high' ELSE 'low' END AS severity,
 CASE WHEN place > 5 THEN 'behind the first 5 of its batch' WHEN ordinal = 0 THEN 'the expression is not valid' WHEN ordinal = 1 THEN 'no group captures the value' WHEN ordinal = 2 THEN 'fires on ordinary text' WHEN ordinal = 3 THEN 'misses its own example' WHEN ordinal = 5 THEN 'no expression given' END AS error
FROM p""")
def _(t):
    n = F.col("p_partkey") % 8
    brand = F.concat(F.lit("("), "p_brand", F.lit("-[0-9]{4})"))
    regex = F.when(n == 0, "([a-z").when(n == 1, "fw-[0-9]+").when(n == 2, "(o)").when(n == 5, "").otherwise(brand)
    example = F.when(n == 3, F.lit("nothing here")).otherwise(F.concat("p_brand", F.lit("-1234")))
    rows = t.table("part").select(
        F.floor(F.col("p_partkey") / 8).alias("batch_id"), n.alias("ordinal"), F.when(n == 0, " ").otherwise(F.concat(F.lit("prop-"), "p_partkey")).alias("rule_id"),
        F.when(n == 1, "high").otherwise("urgent").alias("severity"), regex.alias("regex"), example.alias("example"))
    return V.validate_proposals(rows).select("batch_id", "ordinal", "rule_id", "severity", "error")


@query("tri_06_status_change", """WITH patches AS (SELECT id, run_id, CASE WHEN severity = 'low' THEN 'accepted_risk' WHEN severity = 'info' THEN 'closed' ELSE 'confirmed' END AS new_status FROM findings)
SELECT run_id, id, 'finding_status_changed' AS action, status AS old_status, new_status, 'by review' AS note FROM findings JOIN patches USING (run_id, id) WHERE new_status <> 'closed'""", ("findings",))
def _(t):
    found = t.view("findings")
    new = F.when(F.col("severity") == "low", "accepted_risk").when(F.col("severity") == "info", "closed").otherwise("confirmed")
    patches = found.select("run_id", "id", new.alias("new_status"), F.lit("by review").alias("note"))
    return V.status_changes(found, patches)[1]
