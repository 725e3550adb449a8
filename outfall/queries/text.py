"""Queries on text rows: sources, extraction, matching, scalar functions on evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators import correlate, extract, match, shape
from outfall.queries import oracle as O
from outfall.queries.inputs import Inputs, spread
from outfall.queries.registry import query
from outfall.rules.pack import builtin_pack
from outfall.session import cut
from outfall.sources import artifacts as A

KEY = ["path_in_tree"]


def _evidence(t: Inputs) -> DataFrame:
    return match.scan(t.artifacts(), builtin_pack(), KEY)


def text_findings(t: Inputs) -> DataFrame:
    """Findings of one run over every text row."""
    # evidence is small next to the content: cut here, so that its readers do not scan again
    evidence = cut(match.scan(t.artifacts(), builtin_pack(), KEY).withColumn("run_id", F.lit("texts")))
    result = correlate.correlate(evidence, builtin_pack().rules_df(t.spark).withColumnRenamed("name", "title"))
    return result.findings.select("id", "rule_id", "category", "title", "severity", "confidence", "value_masked", "value_hash", "evidence_count")


# --- sources -------------------------------------------------------------------
@query("src_02_artifact_text", """
SELECT 'documents/' || doc_id AS path_in_tree, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents""")
def _(t):
    docs = t.table("documents")
    return A.artifact_text(docs, F.concat(F.lit("documents/"), "doc_id"), "text").select(
        "path_in_tree", "size_bytes", F.sha2("content", 256).alias("sha256"))


@query("src_04_rule_pack_usage", f"""WITH {O.scan_ctes()}
SELECT r.rule_id, r.category, r.severity, CAST(count(k.val) AS BIGINT) AS hits FROM rules r LEFT JOIN kept k USING (rule_id) GROUP BY ALL""", ("texts",))
def _(t):
    rules = builtin_pack().rules_df(t.spark).select("rule_id", "category", "severity")
    counts = _evidence(t).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules.join(counts, "rule_id", "left").select("rule_id", "category", "severity", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("src_05_false_positive_dim", f"""WITH {O.scan_ctes()}
SELECT fp_value, CAST(count(val) AS BIGINT) AS dropped FROM benign LEFT JOIN raw ON trim(val, ' ' || chr(9)) = fp_value GROUP BY ALL""", ("texts",))
def _(t):
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    counts = raw.groupBy(F.regexp_replace("value", r"^\s+|\s+$", "").alias("fp_value")).agg(F.count("*").alias("dropped"))
    dim = builtin_pack().false_positives_df(t.spark)
    return dim.join(counts, "fp_value", "left").select("fp_value", F.coalesce("dropped", F.lit(0)).alias("dropped"))


@query("src_08_ingest_register", """
SELECT doc_id AS upload_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes,
  'artifacts/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '/' || regexp_replace(source || ' ' || doc_id, '[^0-9A-Za-z._-]', '_', 'g') AS storage_key,
  doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS deduplicated,
  CASE WHEN trim(lang) = '' THEN 'an attesting identity is required' WHEN length('REF-' || doc_id) < 8 THEN 'an authorization reference is required' END AS error
FROM documents""")
def _(t):
    uploads = t.table("documents").select(
        F.col("doc_id").alias("upload_id"), F.concat("source", F.lit(" "), "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"),
        F.col("lang").alias("attested_by"), F.concat(F.lit("REF-"), "doc_id").alias("attestation_reference"))
    return A.ingest_register(uploads).drop("name")


# --- extraction ------------------------------------------------------------------
STRINGS = f"WITH {O.strings_ctes()}"


@query("ext_01_extract_ascii", f"{STRINGS} SELECT path_in_tree, value, byte_offset FROM strings", ("texts",))
def _(t):
    return extract.extract_ascii(t.artifacts(), KEY).select("path_in_tree", "value", "byte_offset")


@query("ext_02_extract_utf16le", f"""WITH wide AS (SELECT 'documents/' || doc_id AS path_in_tree, text AS content FROM documents),
r AS (SELECT path_in_tree, unnest(regexp_extract_all(content, {O.q(O.RUN)})) AS run, unnest(string_split_regex(content, {O.q(O.RUN)})) AS gap,
  unnest(range(len(string_split_regex(content, {O.q(O.RUN)})))) AS i FROM wide),
s AS (SELECT path_in_tree, run, sum(length(gap)) OVER (PARTITION BY path_in_tree ORDER BY i)
  + coalesce(sum(length(run)) OVER (PARTITION BY path_in_tree ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
p AS (SELECT path_in_tree, run, start, unnest(range((length(run) + 8191) // 8192)) AS c FROM s WHERE run IS NOT NULL)
SELECT path_in_tree, substr(run, c * 8192 + 1, 8192) AS value, CAST(2 * (start + c * 8192) AS BIGINT) AS byte_offset FROM p
WHERE length(substr(run, c * 8192 + 1, 8192)) >= 6""")
def _(t):
    docs = t.table("documents").select(F.concat(F.lit("documents/"), "doc_id").alias("path_in_tree"), F.encode("text", "UTF-16LE").alias("content"))
    return extract.extract_utf16le(spread(docs, "path_in_tree"), KEY).select("path_in_tree", "value", "byte_offset")


@query("ext_03_extract_strings", f"{STRINGS} SELECT path_in_tree, value, byte_offset, 'ascii' AS encoding FROM strings", ("texts",))
def _(t):
    return extract.extract_strings(t.artifacts(), KEY)


@query("set_01_encoding_union", f"""WITH {O.strings_ctes()}
SELECT encoding, CAST(count(*) AS BIGINT) AS strings, CAST(sum(length(value)) AS BIGINT) AS chars FROM
 (SELECT DISTINCT path_in_tree, value, byte_offset, 'ascii' AS encoding FROM strings) GROUP BY encoding""", ("texts",))
def _(t):
    both = extract.extract_ascii(t.artifacts(), KEY).unionByName(extract.extract_utf16le(t.artifacts(), KEY)).distinct()
    return both.groupBy("encoding").agg(F.count("*").alias("strings"), F.sum(F.length("value")).alias("chars"))


@query("win_06_string_offsets", f"{STRINGS} SELECT path_in_tree, byte_offset, CAST(length(value) AS BIGINT) AS length FROM strings", ("texts",))
def _(t):
    from outfall.operators.ordered import string_offsets

    return string_offsets(t.artifacts(), KEY).select("path_in_tree", "byte_offset", F.length("value").cast("bigint").alias("length"))


# --- matching --------------------------------------------------------------------
SCAN = f"WITH {O.scan_ctes()}"
G = O.gates()
RAW = "raw JOIN rules USING (rule_id)"


@query("mat_01_scan", f"{SCAN} SELECT path_in_tree, rule_id, CAST(pattern_no AS INT) AS pattern_no, val AS value, CAST(byte_offset AS BIGINT) AS byte_offset FROM kept", ("texts",))
def _(t):
    pack = builtin_pack()
    kept = match.apply_gates(match.raw_matches(t.artifacts(), pack, KEY), pack)
    return kept.select("path_in_tree", "rule_id", "pattern_no", "value", "byte_offset")


@query("mat_02_match_offset", f"{SCAN} SELECT path_in_tree, rule_id, CAST(pattern_no AS INT) AS pattern_no, val AS value, CAST(match_start AS BIGINT) AS match_start, CAST(match_end AS BIGINT) AS match_end, CAST(byte_offset AS BIGINT) AS byte_offset FROM raw", ("texts",))
def _(t):
    return match.raw_matches(t.artifacts(), builtin_pack(), KEY).select(
        "path_in_tree", "rule_id", "pattern_no", "value", "match_start", "match_end", "byte_offset")


def _gated(name: str, condition: str, spark_condition):
    @query(name, f"{SCAN} SELECT path_in_tree, rule_id, val AS value, CAST(byte_offset AS BIGINT) AS byte_offset FROM {RAW} WHERE {condition}", ("texts",))
    def _(t):
        raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
        return spark_condition(raw).select("path_in_tree", "rule_id", "value", "byte_offset")


_gated("mat_03_length_gate", G["length"], lambda m: m.where(F.length("value").between(F.col("min_length"), F.col("max_length"))))
_gated("mat_04_rejects_matching", G["reject"], lambda m: m.where(~F.exists("rejects", lambda r: F.regexp_like("value", r))))
_gated("mat_05_min_entropy", G["entropy"], lambda m: m.where((F.col("min_entropy") <= 0) | (T.shannon_entropy(F.col("value")) >= F.col("min_entropy"))))
_gated("mat_06_known_false_positive", G["benign"], lambda m: match.drop_known_benign(m, builtin_pack()))
_gated("mat_08_blob_slice", G["blob"], lambda m: m.where(
    (F.col("shape_policy") == "off") | (shape.base64_run(F.col("string"), F.col("match_start"), F.col("match_end")) < shape.BLOB_RUN)))
_gated("mat_09_encoded_structure", G["structure"], lambda m: m.where(
    (F.col("shape_policy") == "off") | ~shape.in_structure(F.col("string"), F.col("match_start"), F.col("match_end"))))
_gated("mat_12_policy_dispatch", f"{G['blob']} AND {G['structure']}", lambda m: match.with_shape(m).where(F.col("shape") == "credential_like"))


@query("mat_07_has_nearby", f"""{SCAN} SELECT path_in_tree, rule_id, CAST(byte_offset AS BIGINT) AS byte_offset FROM raw
WHERE contains(lower(substr(string, greatest(match_start - 40, 0) + 1, least(match_start + 40, length(string)) - greatest(match_start - 40, 0))), 'jenkins')
   OR contains(lower(substr(string, greatest(match_start - 40, 0) + 1, least(match_start + 40, length(string)) - greatest(match_start - 40, 0))), 'key')""", ("texts",))
def _(t):
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    near = shape.has_nearby(F.col("string"), F.col("match_start"), F.array(F.lit("Jenkins"), F.lit("KEY")), F.lit(40))
    return raw.where(near).select("path_in_tree", "rule_id", "byte_offset")


STRICT = r"""CASE WHEN regexp_matches(v, '^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$') THEN 'uuid'
 WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 'hex_digest'
 WHEN regexp_matches(v, '(?i)^[a-z][a-z0-9+.\-]*://') OR regexp_matches(v, '^(?:[A-Za-z]:[\\/]|[\\/]|\.{1,2}[\\/])') THEN 'path_or_url'
 WHEN regexp_matches(v, '^[0-9.,:_\-+eE]+$') THEN 'numeric'
 WHEN len(list_distinct(string_split(v, ''))) <= 4 OR len(list_distinct(string_split(v, ''))) / length(v) < 0.18 THEN 'low_variety'"""


@query("mat_10_strict_shape", f"""{SCAN} SELECT path_in_tree, rule_id, CAST(byte_offset AS BIGINT) AS byte_offset, coalesce({STRICT} END, 'credential_like') AS shape
FROM (SELECT *, trim(val, ' ' || chr(9)) AS v FROM raw)""", ("texts",))
def _(t):
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    return raw.select("path_in_tree", "rule_id", "byte_offset",
                      F.coalesce(shape.strict_shape(F.col("value"), F.lit(False)), F.lit("credential_like")).alias("shape"))


CLASSES = "(CAST(regexp_matches({v}, '[a-z]') AS INT) + CAST(regexp_matches({v}, '[A-Z]') AS INT) + CAST(regexp_matches({v}, '[0-9]') AS INT) + CAST(regexp_matches({v}, '[^A-Za-z0-9]') AS INT))"


@query("mat_11_require_mixed_case", f"""{SCAN} SELECT path_in_tree, rule_id, CAST(byte_offset AS BIGINT) AS byte_offset,
 coalesce({STRICT} WHEN {CLASSES.format(v='v')} < 3 THEN 'low_variety' END, 'credential_like') AS shape FROM (SELECT *, trim(val, ' ' || chr(9)) AS v FROM raw)""", ("texts",))
def _(t):
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    return raw.select("path_in_tree", "rule_id", "byte_offset",
                      F.coalesce(shape.strict_shape(F.col("value"), F.lit(True)), F.lit("credential_like")).alias("shape"))


@query("mat_13_rule_fixture_check", f"""{SCAN} SELECT rule_id, CAST(count(val) AS BIGINT) AS raw_hits, CAST(count(DISTINCT path_in_tree) AS BIGINT) AS artifacts,
 CAST(count(*) FILTER (WHERE val IN (SELECT fp_value FROM benign)) AS BIGINT) AS benign_hits FROM rules LEFT JOIN raw USING (rule_id) GROUP BY rule_id""", ("texts",))
def _(t):
    """Every rule must fire somewhere on the planted texts; the packaged fixtures are a unit test."""
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    benign = builtin_pack().false_positives_df(t.spark).withColumn("benign", F.lit(1))
    marked = raw.join(benign, F.col("value") == F.col("fp_value"), "left")
    counts = marked.groupBy("rule_id").agg(F.count("*").alias("raw_hits"), F.countDistinct("path_in_tree").alias("artifacts"), F.count("benign").alias("benign_hits"))
    return builtin_pack().rules_df(t.spark).select("rule_id").join(counts, "rule_id", "left").na.fill(0)


@query("mat_14_precision_report", f"""{SCAN} SELECT rule_id, CAST(count(*) AS BIGINT) AS hits, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 3) AS share FROM kept GROUP BY rule_id""", ("texts",))
def _(t):
    return match_report(_evidence(t))


def match_report(evidence: DataFrame) -> DataFrame:
    """Hits and share of all hits per rule."""
    per_rule = cut(evidence.groupBy("rule_id").agg(F.count("*").alias("hits")))  # one row per rule, read twice
    total = per_rule.select(F.sum("hits")).scalar()
    return per_rule.select("rule_id", "hits", F.round(100.0 * F.col("hits") / total, 3).alias("share")).orderBy(F.desc("hits"), "rule_id")


@query("mat_15_recall_report", f"""{SCAN}, planted AS (SELECT path_in_tree, 'stripe-secret-key' AS rule_id, substr(content, 5) AS value FROM texts WHERE content LIKE 'pay sk\\_live\\_%' ESCAPE '\\'
 UNION ALL SELECT path_in_tree, 'github-token', substr(content, 4) FROM texts WHERE content LIKE 'gh ghp\\_%' ESCAPE '\\'
 UNION ALL SELECT path_in_tree, 'private-ip-address', substr(content, 9) FROM texts WHERE content LIKE 'gateway %'),
found AS (SELECT DISTINCT path_in_tree, rule_id, val AS value FROM kept)
SELECT rule_id, CAST(count(*) FILTER (WHERE p AND f) AS BIGINT) AS true_positive, CAST(count(*) FILTER (WHERE p AND NOT f) AS BIGINT) AS missed,
 CAST(count(*) FILTER (WHERE NOT p AND f) AS BIGINT) AS unplanned FROM (SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, a.value IS NOT NULL AS p, b.value IS NOT NULL AS f
 FROM planted a FULL JOIN found b ON a.path_in_tree = b.path_in_tree AND a.rule_id = b.rule_id AND a.value = b.value) GROUP BY rule_id""", ("texts",))
def _(t):
    texts = t.view("artifact_texts")
    planted = texts.select(
        "path_in_tree",
        F.when(F.col("content").startswith("pay sk_live_"), "stripe-secret-key").when(F.col("content").startswith("gh ghp_"), "github-token")
        .when(F.col("content").startswith("gateway "), "private-ip-address").alias("rule_id"),
        F.regexp_replace("content", "^(pay|gh|gateway) ", "").alias("value"),
    ).where("rule_id IS NOT NULL")
    pack = builtin_pack()
    found = match.apply_gates(match.raw_matches(t.artifacts(), pack, KEY), pack)
    return recall_report(planted, found.select("path_in_tree", "rule_id", "value"))


def recall_report(planted: DataFrame, found: DataFrame) -> DataFrame:
    keys = ["path_in_tree", "rule_id", "value"]
    both = planted.withColumn("p", F.lit(True)).join(found.distinct().withColumn("f", F.lit(True)), keys, "full")
    p, f = F.coalesce("p", F.lit(False)), F.coalesce("f", F.lit(False))
    return both.groupBy("rule_id").agg(
        F.count(F.when(p & f, 1)).alias("true_positive"), F.count(F.when(p & ~f, 1)).alias("missed"), F.count(F.when(~p & f, 1)).alias("unplanned"))


@query("jon_01_pattern_join", f"{SCAN} SELECT rule_id, CAST(pattern_no AS INT) AS pattern_no, CAST(count(*) AS BIGINT) AS matches, CAST(count(DISTINCT path_in_tree || ':' || string_offset) AS BIGINT) AS strings FROM raw GROUP BY rule_id, pattern_no", ("texts",))
def _(t):
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    return raw.groupBy("rule_id", "pattern_no").agg(
        F.count("*").alias("matches"), F.countDistinct("path_in_tree", "string_offset").alias("strings"))


# --- functions on evidence -------------------------------------------------------
@query("fn_01_shannon_entropy", f"{SCAN} SELECT path_in_tree, rule_id, CAST(byte_offset AS BIGINT) AS byte_offset, round({O.entropy('val')}, 3) AS entropy FROM raw", ("texts",))
def _(t):
    raw = match.raw_matches(t.artifacts(), builtin_pack(), KEY)
    return raw.select("path_in_tree", "rule_id", "byte_offset", F.round(T.shannon_entropy(F.col("value")), 3).alias("entropy"))


@query("fn_02_mask", f"{STRINGS} SELECT path_in_tree, byte_offset, {O.mask('value')} AS masked FROM strings", ("texts",))
def _(t):
    return extract.extract_strings(t.artifacts(), KEY).select("path_in_tree", "byte_offset", T.mask(F.col("value")).alias("masked"))


@query("fn_03_value_hash", f"{STRINGS} SELECT path_in_tree, byte_offset, sha256(value) AS value_hash FROM strings", ("texts",))
def _(t):
    return extract.extract_strings(t.artifacts(), KEY).select("path_in_tree", "byte_offset", T.value_hash(F.col("value")).alias("value_hash"))


BYTES = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '[\x{80}-\x{7FF}]', '��', 'g'), '[\x{800}-\x{FFFC}\x{FFFE}-\x{FFFF}]', '���', 'g'),
 '[\x{10000}-\x{10FFFF}]', '����', 'g'), '[\x00-\x1f\x7f]', '.', 'g')"""


@query("fn_04_context", f"""{SCAN} SELECT path_in_tree, rule_id, CAST(byte_offset AS BIGINT) AS byte_offset, sha256(val) AS value_hash,
 replace(substr(bytes, greatest(byte_offset - 60, 0) + 1, byte_offset + 2 * length(val) + 60 - greatest(byte_offset - 60, 0)), replace(val, chr(9), '.'), {O.mask('val')}) AS context
FROM kept JOIN (SELECT path_in_tree, {BYTES} AS bytes FROM texts) USING (path_in_tree)""", ("texts",))
def _(t):
    return _evidence(t).select("path_in_tree", "rule_id", "byte_offset", "value_hash", "context")


@query("fn_05_finding_id", f"""{SCAN} SELECT path_in_tree, rule_id, CAST(byte_offset AS BIGINT) AS byte_offset,
 substr(sha256(rule_id || chr(31) || sha256(val) || chr(31) || path_in_tree || chr(31) || CAST(byte_offset AS BIGINT)), 1, 32) AS id FROM kept""", ("texts",))
def _(t):
    return _evidence(t).select("path_in_tree", "rule_id", "byte_offset",
                               T.finding_id(F.col("rule_id"), F.col("value_hash"), F.col("path_in_tree"), F.col("byte_offset")).alias("id"))


@query("fn_12_mask_secretish", r"""SELECT path_in_tree, sha256(regexp_replace(content, '([A-Za-z0-9+/=_-]{4})[A-Za-z0-9+/=_-]{12,}([A-Za-z0-9+/=_-]{4})', '\1••••••••••••\2', 'g')) AS masked_hash FROM texts""", ("texts",))
def _(t):
    return t.view("texts").select("path_in_tree", F.sha2(T.mask_secretish(F.col("content")), 256).alias("masked_hash"))


@query("fn_17_char_classes", f"{STRINGS} SELECT path_in_tree, byte_offset, {CLASSES.format(v='value')} AS classes FROM strings", ("texts",))
def _(t):
    return extract.extract_strings(t.artifacts(), KEY).select("path_in_tree", "byte_offset", T.char_classes(F.col("value")).alias("classes"))
