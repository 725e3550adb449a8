"""SQL of the scan for the DuckDB side: extraction, all patterns, gates, evidence."""

from __future__ import annotations

from outfall.operators import shape
from outfall.operators.extract import MAX_STRING, MIN_STRING
from outfall.rules.pack import builtin_pack

RUN = r"[\t\x20-\x7e]{" + str(MIN_STRING) + ",}"

# RE2 has no lookahead: these patterns as (lead, denied words, rest), tried at every position
LOOKAHEAD = {
    ("internal-server-hostname", 0): (
        "", "www|api|cdn|crl|ocsp|mail|smtp|imap|pop|ftp|ns|dns|static|img|media|docs|help|shop|blog|download|update|time|ntp|pool",
        r"[a-z][a-z0-9-]{1,28}[0-9]{1,3}\.[a-z0-9-]{2,30}\.[a-z0-9-]{2,30}\.[a-z]{2,12}", True),
    ("developer-profile-path", 0): (
        r"[A-Za-z]:\\Users\\", r"Public\b|Default\b|Default User\b|All Users\b|Administrator\b",
        r"""[A-Za-z][A-Za-z0-9._\- ]{1,32}\\[^\s"<>|*?\r\n]{0,140}""", False),
    ("developer-profile-path", 1): (
        r"/(?:home|Users)/", r"root\b|shared\b|Shared\b",
        r"""[a-z][a-z0-9._\-]{1,32}/(?:AppData|Library|Desktop|Documents|\.config|\.ssh)[^\s"<>|:]{0,140}""", False),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def entropy(v: str) -> str:
    return (
        f"(CASE WHEN length({v}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({v}, '')), "
        f"lambda c: ((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE) "
        f"* log2((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE))) END)"
    )


def mask(v: str) -> str:
    return (
        f"(CASE WHEN length({v}) <= 12 THEN repeat('•', length({v})) ELSE substr({v}, 1, 4) || "
        f"repeat('•', least(length({v}) - 8, 12)) || right({v}, 4) END)"
    )


def strings_ctes(source: str = "texts") -> str:
    """``strings(path_in_tree, value, byte_offset)`` of ``source(path_in_tree, content)``."""
    return f"""
runs_ AS (SELECT path_in_tree, unnest(regexp_extract_all(content, {q(RUN)})) AS run,
    unnest(string_split_regex(content, {q(RUN)})) AS gap, unnest(range(len(string_split_regex(content, {q(RUN)})))) AS i FROM {source}),
starts_ AS (SELECT path_in_tree, run,
    sum(strlen(gap)) OVER w + coalesce(sum(strlen(run)) OVER (PARTITION BY path_in_tree ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM runs_ WINDOW w AS (PARTITION BY path_in_tree ORDER BY i)),
pieces_ AS (SELECT path_in_tree, run, start, unnest(range((length(run) + {MAX_STRING - 1}) // {MAX_STRING})) AS c FROM starts_ WHERE run IS NOT NULL),
strings AS MATERIALIZED (SELECT path_in_tree, substr(run, c * {MAX_STRING} + 1, {MAX_STRING}) AS value, CAST(start + c * {MAX_STRING} AS BIGINT) AS byte_offset
  FROM pieces_ WHERE length(substr(run, c * {MAX_STRING} + 1, {MAX_STRING})) >= {MIN_STRING})"""


def _plain(p: dict) -> str:
    x = q(p["regex"])
    return f"""
SELECT path_in_tree, string, string_offset, rule_id, pattern_no, val, whole,
  CAST(sum(length(gap)) OVER (PARTITION BY path_in_tree, string_offset ORDER BY k)
   + coalesce(sum(length(whole)) OVER (PARTITION BY path_in_tree, string_offset ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS match_start
FROM (SELECT path_in_tree, value AS string, byte_offset AS string_offset, {q(p['rule_id'])} AS rule_id, {p['pattern_no']} AS pattern_no,
  unnest(regexp_extract_all(value, {x}, {p['capture']})) AS val, unnest(regexp_extract_all(value, {x}, 0)) AS whole,
  unnest(string_split_regex(value, {x})) AS gap, unnest(range(len(string_split_regex(value, {x})))) AS k
  FROM strings WHERE regexp_matches(value, {x}))"""


def _positions(p: dict, lead: str, denied: str, rest: str, boundary: bool) -> str:
    body = q(f"^({lead}{rest})" + (r"\b" if boundary else ""))
    edge = r"AND (i = 1 OR NOT regexp_matches(substr(value, i - 1, 1), '\w'))" if boundary else ""
    found = f"""SELECT path_in_tree, value AS string, byte_offset AS string_offset, i - 1 AS match_start,
      regexp_extract(substr(value, i), {body}, 1) AS val
    FROM (SELECT *, unnest(range(1, length(value) + 1)) AS i FROM strings WHERE regexp_matches(value, {q(lead + rest)}))
    WHERE regexp_matches(substr(value, i), {body}) AND NOT regexp_matches(substr(value, i), {q(f'^{lead}(?:{denied})')}) {edge}"""
    return f"""
SELECT path_in_tree, string, string_offset, {q(p['rule_id'])} AS rule_id, {p['pattern_no']} AS pattern_no, val, val AS whole, match_start
FROM (SELECT *, max(match_start + length(val)) OVER (PARTITION BY path_in_tree, string_offset ORDER BY match_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy
  FROM ({found})) WHERE busy IS NULL OR match_start >= busy"""


def raw_cte() -> str:
    parts = []
    for p in builtin_pack().patterns():
        special = LOOKAHEAD.get((p["rule_id"], p["pattern_no"]))
        parts.append(_positions(p, *special) if special else _plain(p))
    return ("raw AS MATERIALIZED (SELECT *, match_start + length(whole) AS match_end, string_offset + match_start AS byte_offset FROM ("
            + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in parts) + ") WHERE val IS NOT NULL AND val <> '')")


def rules_cte() -> str:
    rows = ", ".join(
        f"({q(r['id'])}, {q(r['name'])}, {q(r['category'])}, {q(r['severity'])}, CAST({r['confidence']} AS DOUBLE), CAST({r['min_entropy']} AS DOUBLE), "
        f"{r['min_length']}, {r['max_length']}, {q(r['shape_policy'])}, {q(r['rejects_matching'][0] if r['rejects_matching'] else '')}, "
        f"{q(r['rejects_matching'][1] if r['rejects_matching'] else '')})"
        for r in builtin_pack().enabled()
    )
    return (f"rules AS (SELECT * FROM (VALUES {rows}) t(rule_id, title, category, severity, base_confidence, min_entropy, min_length, "
            "max_length, shape_policy, reject_a, reject_b))")


def benign_cte() -> str:
    return "benign AS (SELECT * FROM (VALUES " + ", ".join(f"({q(v)})" for v in builtin_pack().false_positives) + ") t(fp_value))"


def gates() -> dict[str, str]:
    """Gate conditions over ``raw`` joined with ``rules``."""
    rejects = []
    for r in builtin_pack().enabled():
        rejects += [f"(rule_id = {q(r['id'])} AND regexp_matches(val, {q(x)}))" for x in r["rejects_matching"]]
    left = r"length(regexp_extract(reverse(substr(string, 1, match_start)), '^[A-Za-z0-9+/=\r\n]*', 0))"
    right = r"length(regexp_extract(substr(string, match_end + 1), '^[A-Za-z0-9+/=\r\n]*', 0))"
    around = (f"substr(string, greatest(match_start - {shape.MARKER_WINDOW}, 0) + 1, "
              f"least(match_end + {shape.MARKER_WINDOW}, length(string)) - greatest(match_start - {shape.MARKER_WINDOW}, 0))")
    return {
        "length": "length(val) BETWEEN min_length AND max_length",
        "reject": f"NOT ({' OR '.join(rejects)})",
        "entropy": f"(min_entropy <= 0 OR {entropy('val')} >= min_entropy)",
        "benign": r"trim(val, ' ' || chr(9)) NOT IN (SELECT fp_value FROM benign)",
        "blob": f"(shape_policy = 'off' OR {left} + (match_end - match_start) + {right} < {shape.BLOB_RUN})",
        "structure": "(shape_policy = 'off' OR NOT (" + " OR ".join(f"contains({around}, {q(m)})" for m in shape.STRUCTURE_MARKERS) + "))",
    }


def scan_ctes() -> str:
    """``texts`` must precede.  Ends with ``kept``: matches that pass every gate."""
    where = " AND ".join(gates().values())
    return (f"{strings_ctes()}, {raw_cte()}, {rules_cte()}, {benign_cte()}, "
            f"kept AS MATERIALIZED (SELECT raw.*, title, category, severity, base_confidence, min_entropy FROM raw JOIN rules USING (rule_id) WHERE {where})")
