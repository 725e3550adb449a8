"""Queries on the recon inventory, the residue and the bill of materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.functions.register import register_functions
from outfall.operators import composition as M
from outfall.operators import extract, match
from outfall.operators import recon as R
from outfall.plans import exports as X
from outfall.queries import oracle as O
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query
from outfall.rules.pack import builtin_pack

KEY = ["path_in_tree"]


def _re2(name: str, regex: str) -> str:
    if name != "hostname":
        return "(?i)" + regex
    # the first label is not all digits: a letter first, or digits and then a letter or a dash
    labels = ["[a-z][a-z0-9-]{1,40}"] + [f"[0-9]{{{k}}}[a-z-][a-z0-9-]{{0,{40 - k}}}" for k in range(1, 41)]
    return rf"(?i)\b((?:{'|'.join(labels)})(?:\.[a-z0-9][a-z0-9-]{{1,40}}){{2,}}\.?[a-z]{{0,12}})\b"


CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(value, {O.q(_re2(n, x))}) THEN {O.q(n)}" for n, x, _ in R.PROBES) + " END"
FOUND = "CASE category " + " ".join(f"WHEN {O.q(n)} THEN regexp_extract(value, {O.q(_re2(n, x))}, 1)" for n, x, _ in R.PROBES) + " END"
CLAIMS = f"""{O.strings_ctes()}, tagged AS (SELECT *, {CATEGORY} AS category FROM strings),
claims AS MATERIALIZED (SELECT path_in_tree, byte_offset, category, {FOUND} AS found FROM tagged WHERE category IS NOT NULL),
counts AS (SELECT category, found, count(*) AS occurrences, arg_min(path_in_tree, (path_in_tree, byte_offset)) AS path_in_tree, arg_min(byte_offset, (path_in_tree, byte_offset)) AS byte_offset FROM claims GROUP BY ALL)"""


def strings(t: Inputs):
    return extract.extract_strings(t.artifacts(), KEY)


def counts(t: Inputs):
    return R.value_counts(R.claims(strings(t), []), [])


@query("win_02_recon_claim", f"WITH {CLAIMS} SELECT path_in_tree, byte_offset, category, found FROM claims", ("texts",))
def _(t):
    return R.claims(strings(t), []).drop("encoding")


@query("agg_08_recon_counts", f"WITH {CLAIMS} SELECT category, CAST(sum(occurrences) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS distinct_values, (SELECT count(DISTINCT path_in_tree) FROM strings) AS files_scanned FROM counts GROUP BY category", ("texts",))
def _(t):
    scanned = R.files_scanned(strings(t), [])
    return R.recon_summary(counts(t), []).withColumn("files_scanned", scanned.scalar())


@query("win_01_recon_ranking", f"""WITH {CLAIMS} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY occurrences, counts.found) AS INT) AS rank, substr(counts.found, 1, 200) AS found, CAST(occurrences AS BIGINT) AS occurrences, path_in_tree, byte_offset, 'ascii' AS encoding
FROM counts WHERE occurrences <= 40 QUALIFY rank <= 60""", ("texts",))
def _(t):
    return R.recon_samples(counts(t), [])


MATCHED = f"{O.strings_ctes()}, {O.raw_cte()}, {O.rules_cte()}, {O.benign_cte()}, kept AS MATERIALIZED (SELECT raw.* FROM raw JOIN rules USING (rule_id) WHERE {' AND '.join(O.gates().values())})"
TRIMMED = r"trim(value, ' ' || chr(9))"
RESIDUE = f"""{MATCHED}, cand AS (SELECT path_in_tree, byte_offset, {TRIMMED} AS value FROM strings WHERE length({TRIMMED}) BETWEEN 12 AND 300
  AND regexp_matches({TRIMMED}, {O.q(R.INTERESTING)}) AND NOT regexp_matches({TRIMMED}, {O.q(R.BORING)})),
free AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.path_in_tree = c.path_in_tree AND k.byte_offset = c.byte_offset)),
res AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY substr(value, 1, 120) ORDER BY path_in_tree, byte_offset) = 1 ORDER BY path_in_tree, byte_offset LIMIT 400)"""


def _matches(t: Inputs):
    pack = builtin_pack()
    return match.apply_gates(match.raw_matches(t.artifacts(), pack, KEY), pack)


@query("win_03_residue", f"WITH {RESIDUE} SELECT path_in_tree, byte_offset, 'ascii' AS encoding, value FROM res", ("texts",))
def _(t):
    return R.residue(strings(t), _matches(t))


@query("jon_16_unmatched_strings", f"WITH {MATCHED} SELECT path_in_tree, byte_offset, value FROM strings ANTI JOIN (SELECT DISTINCT path_in_tree, byte_offset AS byte_offset FROM kept) k USING (path_in_tree, byte_offset)", ("texts",))
def _(t):
    return R.unmatched(strings(t), _matches(t)).select("path_in_tree", "byte_offset", "value")


@query("jon_16_unmatched_strict", f"WITH {MATCHED} SELECT path_in_tree, byte_offset, value FROM strings ANTI JOIN (SELECT DISTINCT path_in_tree, string_offset AS byte_offset FROM kept) k USING (path_in_tree, byte_offset)", ("texts",))
def _(t):
    return R.unmatched(strings(t), _matches(t), strict=True).select("path_in_tree", "byte_offset", "value")


@query("srt_07_prompt_sample", f"WITH {RESIDUE}, c AS (SELECT substr(value, 1, 220) AS value, path_in_tree, byte_offset FROM res) SELECT value, path_in_tree, byte_offset, 'ascii' AS encoding FROM c QUALIFY row_number() OVER (PARTITION BY value ORDER BY path_in_tree, byte_offset) = 1 ORDER BY path_in_tree, byte_offset LIMIT 120", ("texts",))
def _(t):
    return R.prompt_sample(R.residue(strings(t), _matches(t)))


# --- bill of materials ---------------------------------------------------------------
def _clean(x: str) -> str:
    trimmed = rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"
    return f"(CASE WHEN lower({trimmed}) IN ('unknown', 'none', 'null') THEN '' ELSE {trimmed} END)"


def _spdx(x: str) -> str:
    return rf"(CASE WHEN regexp_matches({_clean(x)}, '(?i)^(see\s|\.{{0,2}}/)|\.(md|txt|html)$') THEN '' ELSE {_clean(x)} END)"


NPM = f"""npm AS (SELECT path_in_tree, 'npm' AS ecosystem, {_clean("content->>'$.name'")} AS name, {_clean("content->>'$.version'")} AS version,
 {_spdx("coalesce(content->>'$.license.type', content->>'$.license[0].type', content->>'$.license[0]', content->>'$.license')")} AS licence, 'package.json' AS evidence FROM manifest_files WHERE filename = 'package.json'
  AND {_clean("content->>'$.name'")} <> '' AND {_clean("content->>'$.version'")} <> '')"""
NUGET = f"""nuget AS (SELECT path_in_tree, 'nuget' AS ecosystem, {_clean(f"regexp_extract(content, {O.q(M.NUSPEC_ID)}, 1)")} AS name, {_clean(f"regexp_extract(content, {O.q(M.NUSPEC_VERSION)}, 1)")} AS version,
 {_spdx(f"regexp_extract(content, {O.q(M.NUSPEC_LICENSE)}, 1)")} AS licence, '.nuspec' AS evidence FROM manifest_files WHERE filename LIKE '%.nuspec')"""
PYPI = f"""pypi AS (SELECT path_in_tree, 'pypi' AS ecosystem, {_clean("regexp_extract(content, '(?m)^Name:[ ]*(.+)$', 1)")} AS name, {_clean("regexp_extract(content, '(?m)^Version:[ ]*(.+)$', 1)")} AS version,
 {_spdx("regexp_extract(content, '(?m)^License:[ ]*(.+)$', 1)")} AS licence, 'dist-info METADATA' AS evidence FROM manifest_files WHERE lower(filename) = 'metadata')"""
# documents stand in for Go binaries: every text carries its build lines
GO = """gobin AS (SELECT 'bin/' || doc_id AS path_in_tree, text || chr(10) || 'Go buildinf:' || chr(10) || 'path' || chr(9) || 'cmd' || chr(10) || 'mod' || chr(9) || 'example.org/app' || chr(9) || 'v1.' || doc_id || chr(9) || chr(10)
 || 'dep' || chr(9) || 'golang.org/x/' || lang || chr(9) || 'v0.' || length(source) || chr(9) || chr(10) || 'dep' || chr(9) || 'local' || chr(9) || 'v1' || chr(10) AS content FROM documents),
golang AS (SELECT DISTINCT path_in_tree, 'golang' AS ecosystem, name, version, '' AS licence, 'Go buildinfo' AS evidence FROM (SELECT path_in_tree, unnest(regexp_extract_all(content, '(?:dep|mod)\\t([\\w./+~-]{3,180})\\t(v[\\w.+~-]{1,60})', 1)) AS name,
  unnest(regexp_extract_all(content, '(?:dep|mod)\\t([\\w./+~-]{3,180})\\t(v[\\w.+~-]{1,60})', 2)) AS version FROM gobin WHERE contains(content, 'Go buildinf:')) WHERE contains(name, '.'))""".replace("\\\\", "\\")
DECLARED = f"{NPM}, {NUGET}, {PYPI}, declared AS (SELECT * FROM npm UNION ALL SELECT * FROM nuget UNION ALL SELECT * FROM pypi)"
INVENTORY = f"""{DECLARED}, inv AS (SELECT ecosystem, name, version, arg_min(licence, path_in_tree) AS licence, arg_min(evidence, path_in_tree) AS evidence, min(path_in_tree) AS path_in_tree FROM declared GROUP BY ALL)"""
NS = "replace(CASE WHEN ecosystem = 'npm' AND name LIKE '@%/%' THEN split_part(name, '/', 1) || '/' WHEN ecosystem = 'golang' AND name LIKE '%/%' THEN regexp_replace(name, '[^/]*$', '') ELSE '' END, '@', '%40')"
LOCAL = "replace(CASE WHEN ecosystem = 'npm' AND name LIKE '@%/%' THEN substr(name, strpos(name, '/') + 1) WHEN ecosystem = 'golang' THEN regexp_extract(name, '[^/]*$', 0) ELSE name END, '@', '%40')"
PURL = f"'pkg:' || ecosystem || '/' || {NS} || {LOCAL} || CASE WHEN version = '' THEN '' ELSE '@' || replace(version, '@', '%40') END"


def manifests(t: Inputs):
    return t.view("manifest_files").withColumn("content", F.encode("content", "UTF-8"))


def declared(t: Inputs):
    return M.detect_components(manifests(t), [])


def inventory(t: Inputs):
    return M.component_inventory(declared(t).withColumn("run_id", F.substring_index("path_in_tree", " → ", 1)), ["run_id"])


def _one(name: str, ecosystem: str):
    @query(name, f"WITH {DECLARED} SELECT * FROM {ecosystem}", ("manifest_files",))
    def _(t):
        return declared(t).where(F.col("ecosystem") == ecosystem)


_one("cmp_01_npm_components", "npm")
_one("cmp_02_nuget_components", "nuget")
_one("cmp_03_pypi_components", "pypi")


@query("cmp_04_go_components", f"WITH {GO} SELECT * FROM golang")
def _(t):
    docs = t.table("documents")
    tab, nl = F.lit("\t"), F.lit("\n")
    text = F.concat("text", nl, F.lit("Go buildinf:"), nl, F.lit("path\tcmd"), nl, F.lit("mod\texample.org/app\tv1."), F.col("doc_id"), tab, nl,
                    F.lit("dep\tgolang.org/x/"), "lang", tab, F.lit("v0."), F.length("source"), tab, nl, F.lit("dep\tlocal\tv1"), nl)
    files = docs.select(F.concat(F.lit("bin/"), "doc_id").alias("path_in_tree"), F.encode(text, "UTF-8").alias("content"))
    return files.select("path_in_tree", F.inline(M.golang(F.col("content"))))


@query("cmp_05_detect_components", f"WITH {DECLARED} SELECT * FROM declared", ("manifest_files",))
def _(t):
    return declared(t)


@query("agg_09_component_inventory", f"WITH {INVENTORY} SELECT *, 'declared' AS confidence, {PURL} AS purl, false AS truncated, 'app.asar' AS run_id FROM inv", ("manifest_files",))
def _(t):
    return inventory(t)


@query("agg_10_components_by_ecosystem", f"WITH {INVENTORY} SELECT ecosystem, CAST(count(*) AS BIGINT) AS components FROM inv GROUP BY ecosystem", ("manifest_files",))
def _(t):
    return M.by_ecosystem(inventory(t), [])


@query("fn_08_purl", f"WITH {DECLARED}, {GO} SELECT path_in_tree, name, version, {PURL} AS purl FROM (SELECT * FROM declared UNION ALL SELECT * FROM golang)", ("manifest_files",))
def _(t):
    from outfall.queries import QUERIES

    both = declared(t).unionByName(QUERIES["cmp_04_go_components"](t.spark, t.folder))
    return both.select("path_in_tree", "name", "version", T.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"))


@query("udf_01_purl", f"WITH {DECLARED} SELECT path_in_tree, name, version, {PURL} AS purl FROM declared", ("manifest_files",))
def _(t):
    register_functions(t.spark)
    declared(t).createOrReplaceTempView("outfall_declared")
    return t.spark.sql("SELECT path_in_tree, name, version, outfall_purl(ecosystem, name, version) AS purl FROM outfall_declared")


@query("fn_09_clean_spdx", f"""WITH w AS (SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'SEE LICENSE IN x' WHEN 2 THEN './' || o_orderpriority WHEN 3 THEN o_orderpriority || '.md' WHEN 4 THEN chr(9) || o_orderpriority || ' ' ELSE 'null' END AS v FROM orders)
SELECT o_orderkey, {_clean('v')} AS cleaned, {_spdx('v')} AS expression FROM w""")
def _(t):
    p, k = F.col("o_orderpriority"), F.col("o_custkey") % 6
    v = (F.when(k == 0, " Unknown ").when(k == 1, "SEE LICENSE IN x").when(k == 2, F.concat(F.lit("./"), p)).when(k == 3, F.concat(p, F.lit(".md")))
         .when(k == 4, F.concat(F.lit("\t"), p, F.lit(" "))).otherwise("null"))
    return t.table("orders").select("o_orderkey", T.clean(v).alias("cleaned"), T.spdx_expression(T.clean(v)).alias("expression"))


@query("snk_03_cyclonedx_components", f"""WITH {INVENTORY} SELECT 'app.asar' AS run_id, {PURL} AS bom_ref, name, version, licence, evidence, path_in_tree, 1.0::DOUBLE AS confidence_score, 'manifest-analysis' AS technique,
 'urn:uuid:' || concat_ws('-', substr(sha256('sbom:app.asar'), 1, 8), substr(sha256('sbom:app.asar'), 9, 4), substr(sha256('sbom:app.asar'), 13, 4), substr(sha256('sbom:app.asar'), 17, 4), substr(sha256('sbom:app.asar'), 21, 12)) AS serial FROM inv""", ("manifest_files",))
def _(t):
    return X.cyclonedx_rows(inventory(t))
