"""Queries on the release gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators import gate as G
from outfall.operators import runs as R
from outfall.plans import reports as P
from outfall.queries.history import LINKED, SEV, links
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query
from outfall.sources.policies import Policy, parse_policy, valid_waivers, waiver_validate, with_policies

TODAY = "DATE '2024-02-15'"
DEFAULT = Policy()
STRICT = parse_policy({"name": "strict", "block": {"severity_at_or_above": "critical", "categories": ["cat-3"], "rules": ["rule-4"]},
                       "budgets": {"high": 0, "medium": 1, "info": -1}, "baseline": {"mode": "all"}, "on_degraded": "warn",
                       "trust_llm_dismissals": True, "waivers": {"max_ttl_days": 10}})
OPEN = parse_policy({"name": "open", "block": {"severity_at_or_above": "none"}, "budgets": {"low": 2}, "on_degraded": "pass"})
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"
VIEWS_ = ("runs", "findings", "stages", "waivers", "finding_locations")


def _row(p: Policy) -> str:
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
    texts = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    floor = "NULL" if p.floor is None else rank[p.floor]
    return (f"('{p.name}', {floor}::INT, {texts(p.block_categories)}, {texts(p.block_rules)}, '{p.baseline_mode}', '{p.on_degraded}', {p.trust_llm_dismissals}, "
            f"{p.max_waiver_days}, {', '.join(str(p.budgets.get(s, -1)) for s in SEV)})")


def gate_sql(policies: list[Policy]) -> str:
    """CTEs up to ``violations`` and ``verdicts``."""
    return f"""{LINKED}, pol AS (SELECT * FROM (VALUES {', '.join(map(_row, policies))}) t(policy, floor_rank, cats, rules, mode, on_degraded, trust, max_days, {', '.join('b_' + s for s in SEV)})),
good AS (SELECT * FROM waivers WHERE owner <> '' AND reason <> '' AND expires IS NOT NULL QUALIFY count(*) OVER (PARTITION BY finding_id) = 1),
loc AS (SELECT run_id, finding_id AS id, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS artifact_path FROM finding_locations GROUP BY ALL),
deg AS (SELECT run_id, list_sort(list(DISTINCT analyzer || ' (' || status || ')')) AS stages FROM stages WHERE status IN ('timeout', 'oom', 'failed', 'truncated') GROUP BY run_id),
ex AS (SELECT r.run_id, r.status AS run_status, CASE WHEN r.status = 'failed' THEN ['run failed: unknown error'] ELSE coalesce(d.stages, []::VARCHAR[]) END AS stages FROM runs r LEFT JOIN deg d USING (run_id)),
cases AS (SELECT * FROM ex, pol),
f0 AS (SELECT f.*, o.id IS NULL AS is_new, coalesce(llm_verdict = 'false_positive', false) AS llm_dismissed, coalesce(l.artifact_path, '') AS artifact_path
  FROM findings f JOIN ex ON ex.run_id = f.run_id AND run_status <> 'failed' LEFT JOIN old o ON o.run_id = f.run_id AND o.id = f.id LEFT JOIN loc l ON l.run_id = f.run_id AND l.id = f.id),
f1 AS (SELECT f0.*, pol.*, CASE WHEN list_contains(rules, rule_id) THEN 'blocked_rule' WHEN list_contains(cats, category) THEN 'blocked_category' WHEN {RANK} <= floor_rank THEN 'severity_floor' END AS reason,
  (f0.status NOT IN ('false_positive', 'accepted_risk', 'fixed') OR (llm_dismissed AND NOT trust)) AS actionable FROM f0, pol),
f2 AS (SELECT f1.*, w.owner, w.expires, w.reason AS waiver_reason, CASE WHEN NOT actionable THEN 'ignored' WHEN mode = 'new_only' AND NOT is_new THEN 'inherited' WHEN f1.reason IS NULL THEN 'considered'
  WHEN w.finding_id IS NULL THEN 'violation' WHEN {TODAY} > w.expires THEN 'expired_waiver' ELSE 'waived' END AS outcome FROM f1 LEFT JOIN good w ON w.finding_id = f1.id),
budget AS (SELECT run_id, policy, severity, n, lim FROM (SELECT run_id, policy, severity, count(*) AS n, CASE severity {' '.join(f"WHEN '{s}' THEN any_value(b_{s})" for s in SEV)} END AS lim FROM f2 WHERE outcome = 'considered' GROUP BY run_id, policy, severity) WHERE lim <> -1 AND n > lim),
violations AS (SELECT run_id, policy, CASE outcome WHEN 'expired_waiver' THEN outcome ELSE reason END AS kind,
   CASE WHEN outcome = 'expired_waiver' THEN 'waiver expired ' || expires || ' (owner: ' || owner || ')' WHEN reason = 'severity_floor' THEN severity || ' finding blocks release'
   WHEN reason = 'blocked_rule' THEN 'rule ' || rule_id || ' is blocked by policy' ELSE 'category ' || category || ' is blocked by policy' END AS detail, id AS finding_id, rule_id, severity, title, artifact_path
  FROM f2 WHERE outcome IN ('violation', 'expired_waiver')
  UNION ALL SELECT run_id, policy, 'budget_exceeded', n || ' ' || severity || ' findings exceed the budget of ' || lim, '', '', severity, '', '' FROM budget
  UNION ALL SELECT run_id, policy, 'degraded_scan', 'scan incomplete: ' || array_to_string(stages, ', ') || ' did not finish, so the artifact was not fully examined', '', '', NULL, '', '' FROM cases WHERE len(stages) > 0 AND on_degraded = 'fail'),
vc AS (SELECT run_id, policy, count(*) AS n, bool_and(kind = 'degraded_scan') AS only_degraded FROM violations GROUP BY ALL),
fc AS (SELECT run_id, policy, count(*) AS total_findings, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}, count(*) FILTER (WHERE severity = '{s}' AND is_new) AS new_{s}" for s in SEV)},
  count(*) FILTER (WHERE outcome = 'waived') AS waived, count(*) FILTER (WHERE outcome = 'inherited') AS inherited,
  count(*) FILTER (WHERE outcome = 'waived' AND date_diff('day', {TODAY}, expires) > max_days) AS ttl_warnings FROM f2 GROUP BY ALL),
v0 AS (SELECT c.run_id, c.policy, c.stages, c.on_degraded, coalesce(vc.n, 0) AS violations, CASE WHEN vc.only_degraded THEN 'inconclusive' WHEN vc.n > 0 THEN 'blocked' WHEN len(c.stages) > 0 AND c.on_degraded = 'warn' THEN 'inconclusive' ELSE 'pass' END AS decision,
  {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ['total_findings', *SEV, *['new_' + s for s in SEV], 'waived', 'inherited', 'ttl_warnings'])}
  FROM cases c LEFT JOIN vc USING (run_id, policy) LEFT JOIN fc USING (run_id, policy)),
verdicts AS (SELECT run_id, policy, decision, CASE decision WHEN 'pass' THEN 0 WHEN 'blocked' THEN 1 ELSE 3 END AS exit_code,
  CASE decision WHEN 'pass' THEN 'PASS — ' || total_findings || ' finding(s), none blocking under ''' || policy || '''' WHEN 'inconclusive' THEN 'INCONCLUSIVE — scan incomplete (' || len(stages) || ' degraded stage(s)) under ''' || policy || ''''
   ELSE 'BLOCKED — ' || violations || ' violation(s) under ''' || policy || '''' END AS summary,
  total_findings, {', '.join(SEV)}, {', '.join('new_' + s for s in SEV)}, CAST(violations AS BIGINT) AS violations, waived, inherited, ttl_warnings, array_to_string(stages, '; ') AS degraded_stages FROM v0)"""


def projected(t: Inputs, every=None, found=None):
    """``every``: the findings; ``found``: those to project, made from the same frame so that both share its exchanges."""
    every = t.view("findings") if every is None else every
    return G.gate_findings(every if found is None else found, t.view("finding_locations"), R.baseline_ids(links(t), every, once=False))


def gate(t: Inputs, policies: list[Policy]) -> G.Gate:
    every = t.view("findings")
    return G.evaluate(t.view("runs"), every, R.degraded_stages(t.view("stages")), valid_waivers(t.view("waivers"), DEFAULT),
                      policies, F.expr(TODAY), lambda found: projected(t, every, found))


ONE, THREE = f"WITH {gate_sql([DEFAULT])}", f"WITH {gate_sql([DEFAULT, STRICT, OPEN])}"


@query("src_06_policy_dim", f"WITH {gate_sql([DEFAULT, STRICT, OPEN])} SELECT policy, floor_rank, mode AS baseline_mode, on_degraded, trust AS trust_llm_dismissals, max_days AS max_waiver_days, b_high AS budget_high, CAST(count(*) AS BIGINT) AS findings FROM f1 GROUP BY ALL", VIEWS_)
def _(t):
    rows = with_policies(projected(t).join(t.view("runs").where("status <> 'failed'"), "run_id", "left_semi"), [DEFAULT, STRICT, OPEN])
    return rows.groupBy("policy", "floor_rank", "baseline_mode", "on_degraded", "trust_llm_dismissals", "max_waiver_days", "budget_high").agg(F.count("*").alias("findings"))


@query("src_07_waiver_validate", """SELECT finding_id, reason, owner, expires, CASE WHEN trim(finding_id) = '' THEN 'finding_id is required' WHEN count(*) OVER (PARTITION BY finding_id) > 1 THEN 'duplicate waiver'
 WHEN trim(reason) = '' THEN 'a reason is required' WHEN trim(owner) = '' THEN 'an owner is required' WHEN expires IS NULL THEN 'an expires date is required' END AS error FROM waivers""", ("waivers",))
def _(t):
    return waiver_validate(t.view("waivers"), DEFAULT).orderBy("expires", "finding_id")


@query("gat_01_gate_findings", f"{ONE} SELECT run_id, id, rule_id, category, title, severity, status, is_new, llm_dismissed, artifact_path FROM f0", VIEWS_)
def _(t):
    whole = t.view("runs").where("status <> 'failed'")
    return projected(t).join(whole, "run_id", "left_semi").select("run_id", "id", "rule_id", "category", "title", "severity", "status", "is_new", "llm_dismissed", "artifact_path")


@query("gat_02_actionable", f"{THREE} SELECT run_id, id, policy, actionable FROM f1", VIEWS_)
def _(t):
    return gate(t, [DEFAULT, STRICT, OPEN]).outcomes.select("run_id", "id", "policy", "actionable")


@query("gat_03_inherited", f"{ONE} SELECT run_id, policy, id, rule_id, category, title, severity, status, artifact_path FROM f2 WHERE outcome = 'inherited'", VIEWS_)
def _(t):
    return gate(t, [DEFAULT]).inherited


@query("gat_04_blocking_reason", f"{THREE} SELECT run_id, id, policy, reason FROM f1", VIEWS_)
def _(t):
    return gate(t, [DEFAULT, STRICT, OPEN]).outcomes.select("run_id", "id", "policy", "reason")


@query("gat_05_apply_waivers", f"{THREE} SELECT run_id, policy, id AS finding_id, title, severity, owner, waiver_reason AS reason, expires FROM f2 WHERE outcome = 'waived'", VIEWS_)
def _(t):
    return gate(t, [DEFAULT, STRICT, OPEN]).waived


@query("jon_10_finding_waiver", f"{ONE} SELECT run_id, id, outcome, owner, expires FROM f2", VIEWS_)
def _(t):
    return gate(t, [DEFAULT]).outcomes.select("run_id", "id", "outcome", "owner", "expires")


@query("jon_11_first_location", "SELECT run_id, finding_id AS id, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS artifact_path, arg_min(byte_offset, (path_in_tree, byte_offset)) AS byte_offset, CAST(count(*) AS BIGINT) AS location_count FROM finding_locations GROUP BY run_id, finding_id", ("finding_locations",))
def _(t):
    return G.first_locations(t.view("finding_locations"))


@query("win_10_first_location_path", "SELECT run_id, finding_id AS id, path_in_tree AS artifact_path FROM finding_locations QUALIFY row_number() OVER (PARTITION BY run_id, finding_id ORDER BY path_in_tree, byte_offset) = 1", ("finding_locations",))
def _(t):
    return G.first_locations(t.view("finding_locations")).select("run_id", "id", "artifact_path")


@query("agg_07_budget_check", f"{THREE} SELECT run_id, policy, severity, detail FROM violations WHERE kind = 'budget_exceeded'", VIEWS_)
def _(t):
    return G.budget_violations(gate(t, [DEFAULT, STRICT, OPEN]).counted).select("run_id", "policy", "severity", "detail")


@query("gat_06_gate_verdict", f"{ONE} SELECT * FROM verdicts", VIEWS_)
def _(t):
    return gate(t, [DEFAULT]).verdicts


@query("gat_06_violations", f"{THREE} SELECT * FROM violations", VIEWS_)
def _(t):
    return gate(t, [DEFAULT, STRICT, OPEN]).violations


@query("gat_07_failed_runs", f"{ONE} SELECT v.* FROM verdicts v JOIN runs USING (run_id) WHERE status = 'failed'", VIEWS_)
def _(t):
    failed = t.view("runs").where("status = 'failed'")
    return gate(t, [DEFAULT]).verdicts.join(failed, "run_id", "left_semi")


@query("gat_08_regate", f"{THREE} SELECT * FROM verdicts", VIEWS_)
def _(t):
    return gate(t, [DEFAULT, STRICT, OPEN]).verdicts


@query("snk_04_verdict_export", f"""{THREE} SELECT run_id, policy, to_json({{'decision': decision, 'exit_code': exit_code, 'policy_name': policy, 'total_findings': total_findings, 'violations': violations, 'waived': waived, 'inherited': inherited, 'degraded_stages': degraded_stages}})::VARCHAR AS verdict_json FROM verdicts""", VIEWS_)
def _(t):
    return P.verdict_json(gate(t, [DEFAULT, STRICT, OPEN]).verdicts)


@query("snk_04_verdict_lines", f"""{THREE} SELECT run_id, policy, CASE WHEN severity IS NULL THEN 'SCAN    ' ELSE rpad(upper(severity), 8, ' ') END || ' ' || CASE WHEN title = '' THEN detail ELSE title END || CASE WHEN artifact_path = '' THEN '' ELSE ' [' || artifact_path || ']' END AS line,
 '| ' || coalesce(severity, '—') || ' | ' || CASE WHEN title = '' THEN '—' ELSE title END || ' | `' || CASE WHEN artifact_path = '' THEN '—' ELSE artifact_path END || '` | ' || detail || ' |' AS markdown FROM violations""", VIEWS_)
def _(t):
    return P.violation_lines(gate(t, [DEFAULT, STRICT, OPEN]).violations)


@query("fn_07_severity_rank", f"SELECT run_id, id, {RANK} AS rank FROM (SELECT run_id, id, CASE WHEN status = 'open' THEN severity ELSE status END AS severity FROM findings)", ("findings",))
def _(t):
    word = F.when(F.col("status") == "open", F.col("severity")).otherwise(F.col("status"))
    return t.view("findings").select("run_id", "id", T.severity_rank(word).alias("rank"))


@query("fn_14_waiver_dates", f"SELECT finding_id, expires, {TODAY} > expires AS expired, date_diff('day', {TODAY}, expires) > 30 AS over_ttl FROM waivers", ("waivers",))
def _(t):
    today = F.expr(TODAY)
    return t.view("waivers").select("finding_id", "expires", T.waiver_expired(F.col("expires"), today).alias("expired"),
                                    T.ttl_exceeded(F.col("expires"), today, F.lit(30)).alias("over_ttl"))


@query("fn_15_blocks", f"SELECT run_id, id, {RANK} <= 1 AS high, {RANK} <= 3 AS low, false AS none FROM findings", ("findings",))
def _(t):
    s = F.col("severity")
    return t.view("findings").select("run_id", "id", T.blocks(s, F.lit("high")).alias("high"), T.blocks(s, F.lit("low")).alias("low"),
                                     T.blocks(s, F.lit(None).cast("string")).alias("none"))


@query("snk_05_release_findings", f"""{ONE} SELECT f.run_id, f.id, {RANK} AS severity_rank, severity, f.rule_id, title, coalesce(l.artifact_path, r.name) AS path_in_tree, l.byte_offset, o.id IS NULL AS is_new FROM findings f JOIN runs r USING (run_id)
 LEFT JOIN old o ON o.run_id = f.run_id AND o.id = f.id LEFT JOIN (SELECT run_id, finding_id AS id, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS artifact_path, arg_min(byte_offset, (path_in_tree, byte_offset)) AS byte_offset FROM finding_locations GROUP BY ALL) l ON l.run_id = f.run_id AND l.id = f.id""", VIEWS_)
def _(t):
    found = t.view("findings")
    return P.release_findings(t.view("runs"), found, t.view("finding_locations"), R.baseline_ids(links(t), found, once=False))


@query("snk_05_release_facts", f"""{ONE}, facts AS (SELECT r.run_id, 'cover' AS section, label, value FROM runs r JOIN verdicts v USING (run_id), LATERAL (VALUES ('artifact', r.name), ('sha256', r.root_sha256), ('scanned_at', strftime(r.finished_at, '%Y-%m-%d %H:%M:%S')), ('decision', v.decision), ('degraded_stages', v.degraded_stages)) t(label, value)
 UNION ALL SELECT v.run_id, 'severity', label, CAST(n AS VARCHAR) FROM verdicts v, LATERAL (VALUES {', '.join(f"('{s}', v.{s})" for s in SEV)}) t(label, n) WHERE n > 0
 UNION ALL SELECT r.run_id, 'methodology', label, value FROM runs r, LATERAL (VALUES ('Run', r.run_id), ('Manifest fingerprint', '-'), ('Rule pack', 'built-in')) t(label, value)) SELECT * FROM facts""", VIEWS_)
def _(t):
    return P.release_facts(t.view("runs"), gate(t, [DEFAULT]).verdicts, "built-in")
