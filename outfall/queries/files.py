"""Queries on bytes: files, archives, identification, decoding, extraction rules."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from outfall.functions import decode as DC
from outfall.functions import text as T
from outfall.functions.ship import by_value
from outfall.operators import extract, match
from outfall.operators import identify as I
from outfall.operators import unpack as U
from outfall.queries import oracle as O
from outfall.queries.inputs import Inputs
from outfall.queries.registry import query
from outfall.rules.pack import builtin_pack
from outfall.sources import artifacts as A
from outfall.sources.archives import archive_expand
from outfall.sources.ranges import artifact_ranges
from outfall.sources.sinks import scratch


@query("src_01_artifact_files")
def _(t):
    """The files of the given folder as artifacts."""
    return A.artifact_files(t.spark, t.folder, digest=True).select("path_in_tree", "size_bytes", "truncated", "sha256")


def _text_files(t: Inputs):
    """Every text of the given tables, line by line in large files, read back in ranges that border inside strings."""
    base = scratch(t.spark, "files")
    t.view("texts").where("content IS NOT NULL").select("content").write.text(base)
    return artifact_ranges(t.spark, base, 256 << 10)


@query("src_01_file_ranges", f"WITH {O.strings_ctes()} SELECT value, CAST(count(*) AS BIGINT) AS places FROM strings GROUP BY value", ("texts",))
def _(t):
    return extract.extract_strings(_text_files(t), ["path_in_tree"]).groupBy("value").agg(F.count("*").alias("places"))


@query("mat_01_range_scan", f"WITH {O.scan_ctes()} SELECT rule_id, val AS value, CAST(count(*) AS BIGINT) AS places FROM kept GROUP BY ALL", ("texts",))
def _(t):
    found = match.scan(_text_files(t), builtin_pack(), ["path_in_tree"], retain_plaintext=True)
    return found.groupBy("rule_id", F.col("value_plaintext").alias("value")).agg(F.count("*").alias("places"))


def _zip_rows(batches):
    """One small archive per text: the text, and a tar.gz that holds its language."""
    for batch in batches:
        rows = []
        for key, text, lang in zip(batch.doc_id, batch.text, batch.lang, strict=True):
            inner, outer = io.BytesIO(), io.BytesIO()
            with tarfile.open(fileobj=inner, mode="w:gz") as tar:
                info = tarfile.TarInfo("config/lang.txt")
                info.size = len(lang.encode())
                tar.addfile(info, io.BytesIO(lang.encode()))
            with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("a/text.txt", text)
                archive.writestr("nested.tar.gz", inner.getvalue())
                archive.writestr("../evil.txt", "x")
            rows.append((f"documents/{key}.zip", outer.getvalue()))
        yield pd.DataFrame(rows, columns=["path_in_tree", "content"])


@query("src_03_archive_expand", """WITH r AS (SELECT 'documents/' || doc_id || '.zip' AS root, text, lang FROM documents)
SELECT root, root AS path_in_tree, NULL AS parent_path_in_tree, 0 AS depth, NULL AS sha256, NULL AS error FROM r
UNION ALL SELECT root, root || ' → a/text.txt', root, 1, sha256(text), NULL FROM r
UNION ALL SELECT root, root || ' → nested.tar.gz', root, 1, NULL, NULL FROM r
UNION ALL SELECT root, root || ' → ../evil.txt', root, 1, NULL, 'refused entry ../evil.txt' FROM r
UNION ALL SELECT root, root || ' → nested.tar.gz → config/lang.txt', root || ' → nested.tar.gz', 2, sha256(lang), NULL FROM r""")
def _(t):
    docs = t.table("documents").select("doc_id", "text", "lang")
    zips = docs.mapInPandas(_zip_rows, "path_in_tree string, content binary")
    out = archive_expand(zips)
    hashed = F.when(F.col("path_in_tree").rlike(r"txt$"), F.sha2("content", 256))
    return out.select("root", "path_in_tree", "parent_path_in_tree", "depth", hashed.alias("sha256"), "error")


# --- identification: bytes built from part rows --------------------------------------
def binary_files(t: Inputs):
    """A header chosen by the part key, then the part name as payload."""
    k = F.col("p_partkey")
    kinds = ["4D5A", "7F454C4602", "7F454C4601", "CAFEBABE", "504B0304", "377ABCAF271C", "1F8B", "68737173", "D0CF11E0A1B11AE1", "2D2D2D2D2D424547494E", "00010203", ""]
    head = F.lit("")
    for i, h in enumerate(kinds):
        head = F.when(k % 12 == i, h).otherwise(head)
    # executable: header at 64 + 8 * (key % 3), machine and DLL flag by key
    at = 64 + (k % 3) * 8
    machine = F.when(k % 5 == 0, "4C01").when(k % 5 == 1, "6486").when(k % 5 == 2, "C001").when(k % 5 == 3, "64AA").otherwise("3412")
    pe = F.concat(F.lit("4D5A"), F.repeat(F.lit("00"), F.lit(58)), F.lpad(F.hex(at), 2, "0"), F.lit("000000"), F.repeat(F.lit("00"), (at - 64).cast("int")),
                  F.lit("50450000"), machine, F.repeat(F.lit("00"), F.lit(16)), F.when(k % 7 == 0, "0020").otherwise("0200"))
    little = k % 4 < 2
    elf_machine = F.when(k % 3 == 0, F.when(little, "3E00").otherwise("003E")).when(k % 3 == 1, F.when(little, "B700").otherwise("00B7")).otherwise("0000")
    elf = F.concat(head, F.when(little, "01").otherwise("02"), F.repeat(F.lit("00"), F.lit(12)), elf_machine)
    chosen = F.when(k % 12 == 0, pe).when((k % 12).isin(1, 2), elf).otherwise(head)
    return t.table("part").select(
        F.concat(F.lit("bin/"), k, F.when(k % 12 == 4, F.when(k % 24 == 4, ".jar").otherwise(".zip")).when(k % 12 == 11, F.when(k % 24 == 11, ".asar").otherwise(".txt")).otherwise(".bin")).alias("path_in_tree"),
        k.alias("p_partkey"), F.concat(F.unhex(chosen), F.encode(F.concat("p_name", F.lit(" payload of the part")), "UTF-8")).alias("content"))


KIND = """CASE p_partkey % 12 WHEN 0 THEN 'pe' WHEN 1 THEN 'elf' WHEN 2 THEN 'elf' WHEN 3 THEN 'macho' WHEN 4 THEN 'archive' WHEN 5 THEN 'archive' WHEN 6 THEN 'archive' WHEN 7 THEN 'filesystem' WHEN 8 THEN 'installer' WHEN 9 THEN 'certificate'
 WHEN 10 THEN CASE WHEN (length(p_name) + 20) / (length(p_name) + 24.0) > 0.95 THEN 'text' ELSE 'unknown' END ELSE 'text' END"""
ARCH = """CASE WHEN p_partkey % 12 = 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'x86' WHEN 1 THEN 'x86_64' WHEN 2 THEN 'arm' WHEN 3 THEN 'arm64' ELSE 'unknown(0x1234)' END
 WHEN p_partkey % 12 IN (1, 2) THEN CASE p_partkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'arm64' ELSE 'unknown(0x00)' END END"""


@query("ext_04_identify", f"SELECT p_partkey, {KIND} AS kind FROM part")
def _(t):
    return I.identify(binary_files(t)).select("p_partkey", "kind")


@query("ext_05_identify_pe", f"SELECT p_partkey, {ARCH} AS architecture, p_partkey % 7 = 0 AS is_dll FROM part WHERE p_partkey % 12 = 0")
def _(t):
    return I.identify(binary_files(t)).where("kind = 'pe'").select("p_partkey", "architecture", "is_dll")


@query("ext_06_identify_elf", f"SELECT p_partkey, {ARCH} AS architecture, CASE WHEN p_partkey % 12 = 1 THEN '64-bit' ELSE '32-bit' END AS elf_class FROM part WHERE p_partkey % 12 IN (1, 2)")
def _(t):
    return I.identify(binary_files(t)).where("kind = 'elf'").select("p_partkey", "architecture", "elf_class")


@query("ext_06_kind_inventory", f"SELECT {KIND} AS kind, {ARCH} AS architecture, CAST(count(*) AS BIGINT) AS files FROM part GROUP BY ALL")
def _(t):
    return I.identify(binary_files(t)).groupBy("kind", "architecture").agg(F.count("*").alias("files"))


ASCII_BYTES = r"length(regexp_replace(content, '[^\t\n\r\x20-\x7e]', '', 'g'))"


@query("ext_07_looks_like_text", rf"""WITH c AS (SELECT path_in_tree, regexp_replace(regexp_replace(regexp_replace(content, '[\x{{80}}-\x{{7FF}}]', '~~'||chr(1)||chr(1), 'g'), '[\x{{800}}-\x{{FFFF}}]', chr(1)||chr(1)||chr(1), 'g'), '[\x{{10000}}-\x{{10FFFF}}]', chr(1)||chr(1)||chr(1)||chr(1), 'g') AS b FROM texts),
h AS (SELECT path_in_tree, substr(replace(b, '~~', ''), 1, 4096) AS content FROM c)
SELECT path_in_tree, {ASCII_BYTES} / length(content)::DOUBLE > 0.95 AS is_text, {ASCII_BYTES} / length(content)::DOUBLE > 0.90 AS probably_text FROM h""", ("texts",))
def _(t):
    return t.artifacts().select("path_in_tree", I.looks_like_text(F.col("content")).alias("is_text"), I.is_probably_text(F.col("content")).alias("probably_text"))


@query("ext_08_detect_container", """SELECT p_partkey, CASE p_partkey % 12 WHEN 4 THEN CASE WHEN p_partkey % 24 = 4 THEN 'jar' ELSE 'zip' END WHEN 5 THEN '7z' WHEN 6 THEN 'gzip' WHEN 7 THEN 'squashfs' WHEN 8 THEN 'msi'
 WHEN 11 THEN CASE WHEN p_partkey % 24 = 11 THEN 'asar' ELSE 'none' END ELSE 'none' END AS container, p_partkey % 12 IN (4, 5, 6, 7, 8) OR p_partkey % 24 = 11 AS should_unpack FROM part""")
def _(t):
    return I.detect_container(binary_files(t)).select("p_partkey", "container", "should_unpack")


MEMBERS = """CASE p_partkey % 8 WHEN 0 THEN 'a/../b/' || p_name WHEN 1 THEN '../' || p_name WHEN 2 THEN 'C:' || chr(92) || 'dir' || chr(92) || p_name WHEN 3 THEN '//abs/./' || p_name WHEN 4 THEN 'a/b/../../../' || p_name WHEN 5 THEN '..' WHEN 6 THEN './' ELSE 'x/' || p_name END"""


@query("ext_09_safe_member", f"""SELECT p_partkey, {MEMBERS} AS member, CASE p_partkey % 8 WHEN 0 THEN 'b/' || p_name WHEN 2 THEN 'dir/' || p_name WHEN 3 THEN 'abs/' || p_name WHEN 7 THEN 'x/' || p_name END AS safe_path FROM part""")
def _(t):
    rows = t.table("part").select("p_partkey", F.expr(MEMBERS).alias("member"))
    return rows.withColumn("safe_path", U.safe_member(F.col("member")))


CAPS = "caps AS (SELECT DISTINCT root, CASE root WHEN 'pkg-1.zip' THEN 1500000 WHEN 'pkg-2.zip' THEN 100000000 ELSE 4000000 END AS max_bytes, CASE root WHEN 'pkg-2.zip' THEN 100 ELSE 20000 END AS max_files FROM unpack_nodes)"
BUDGET = f"""{CAPS}, s AS (SELECT n.*, row_number() OVER w AS files_so_far, sum(size_bytes) OVER w AS bytes_so_far, max_bytes, max_files FROM unpack_nodes n JOIN caps USING (root) WINDOW w AS (PARTITION BY root ORDER BY depth, path_in_tree)),
b AS (SELECT *, files_so_far <= max_files AND bytes_so_far <= max_bytes AS kept FROM s)"""


def budgeted(t: Inputs):
    nodes = t.view("unpack_nodes")
    caps = nodes.select("root").distinct().select(
        "root", F.when(F.col("root") == "pkg-1.zip", 1500000).when(F.col("root") == "pkg-2.zip", 100000000).otherwise(4000000).alias("max_bytes"),
        F.when(F.col("root") == "pkg-2.zip", 100).otherwise(20000).alias("max_files"))
    return U.extraction_budget(nodes, caps)


@query("ext_10_extraction_budget", f"""WITH {BUDGET} SELECT root, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS files, CAST(coalesce(sum(size_bytes) FILTER (WHERE kept), 0) AS BIGINT) AS bytes, NOT bool_and(kept) AS truncated,
 coalesce(string_agg(DISTINCT CASE WHEN files_so_far > max_files THEN 'file count would exceed max_files ' || max_files WHEN bytes_so_far > max_bytes THEN 'writing would exceed max_total_bytes ' || max_bytes END, '; '), '') AS reasons FROM b GROUP BY root""", ("unpack_nodes",))
def _(t):
    return U.budget_summary(budgeted(t))


@query("win_05_running_budget", f"WITH {BUDGET} SELECT root, path_in_tree, CAST(files_so_far AS BIGINT) AS files_so_far, CAST(bytes_so_far AS BIGINT) AS bytes_so_far, kept FROM b", ("unpack_nodes",))
def _(t):
    return budgeted(t).select("root", "path_in_tree", "files_so_far", "bytes_so_far", "kept")


@query("ext_10_budget_caps", """SELECT p_partkey, CAST(least(greatest(s * 20, 67108864), 10737418240) AS BIGINT) AS max_bytes, CAST(greatest(20000, least(greatest(s // 1048576, 1) * 600, 250000)) AS BIGINT) AS max_files FROM (SELECT p_partkey, CAST(p_partkey * 3000000 AS BIGINT) AS s FROM part)""")
def _(t):
    caps = U.budget_for(F.col("p_partkey") * 3000000)
    return t.table("part").select("p_partkey", *[c.cast("bigint").alias(n) for n, c in caps.items()])


TREE_ID = "substr(sha256('r1' || chr(31) || {x}), 1, 32)"


@query("ext_11_artifact_tree", f"""WITH k AS (SELECT DISTINCT path_in_tree AS p FROM unpack_nodes) SELECT {TREE_ID.format(x='path_in_tree')} AS id, {TREE_ID.format(x="CASE WHEN k.p IS NOT NULL THEN parent_path_in_tree ELSE root END")} AS parent_id,
 trim(regexp_extract(path_in_tree, '([^/→]+)$', 1)) AS name, path_in_tree, depth, size_bytes FROM unpack_nodes LEFT JOIN k ON k.p = parent_path_in_tree""", ("unpack_nodes",))
def _(t):
    nodes = t.view("unpack_nodes").withColumn("run_id", F.lit("r1"))
    return U.artifact_tree(nodes).drop("run_id").orderBy("depth", "path_in_tree")


@query("set_02_root_and_tree", "SELECT DISTINCT root AS path_in_tree, 0 AS depth FROM unpack_nodes UNION ALL SELECT path_in_tree, depth FROM unpack_nodes", ("unpack_nodes",))
def _(t):
    nodes = t.view("unpack_nodes")
    roots = nodes.select(F.col("root").alias("path_in_tree"), F.lit(0).alias("depth")).distinct()
    return roots.unionByName(nodes.select("path_in_tree", "depth"))


# --- functions on bytes -----------------------------------------------------------------
@query("fn_06_manifest_fingerprint", """SELECT run_id, sha256('0.1.0' || chr(31) || root_sha256 || chr(31) || '1.0.0' || chr(31) || name || chr(31) || 'static=' || status || chr(31) || 'unpack=' || md5(name) || chr(31) || 'python=' || name) AS fingerprint FROM runs""", ("runs",))
def _(t):
    runs = t.view("runs")
    images = F.create_map(F.lit("unpack"), F.md5("name"), F.lit("static"), F.col("status"))
    tools = F.create_map(F.lit("python"), F.col("name"))
    fields = [F.lit("0.1.0"), F.col("root_sha256"), F.lit("1.0.0"), F.col("name")]
    return runs.select("run_id", T.manifest_fingerprint(fields, [images, tools]).alias("fingerprint"))


ENCODED = "CASE doc_id % 4 WHEN 0 THEN to_base64(encode(text)) WHEN 1 THEN hex(encode(text)) WHEN 2 THEN url_encode(substr(text, 1, 40)) ELSE text END"


@query("fn_10_decode_candidates", """WITH e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN to_base64(encode(text)) WHEN 1 THEN hex(encode(text)) ELSE text END AS v FROM documents),
p AS (SELECT doc_id, v, v || repeat('=', (4 - length(v) % 4) % 4) AS padded FROM e)
SELECT doc_id, 'base64' AS codec, md5(from_base64(padded)) AS digest FROM p WHERE regexp_matches(v, '^[A-Za-z0-9+/]*={0,2}$') AND length(regexp_replace(v, '=+$', '')) % 4 <> 1
UNION ALL SELECT doc_id, 'hex', md5(unhex(v)) FROM p WHERE regexp_matches(v, '^([0-9A-Fa-f]{2})*$')""")
def _(t):
    n, raw = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    # base64 in Spark is one line; hex is upper case in both engines
    value = F.when(n == 0, F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))).when(n == 1, F.hex(raw)).otherwise(F.col("text"))
    rows = t.table("documents").select("doc_id", value.alias("v"))
    return DC.decode_candidates(rows, "v", ["doc_id"], ("base64", "hex")).select("doc_id", "codec", F.md5("decoded").alias("digest"))


@query("fn_10_decode_all_codecs")
def _(t):
    rows = t.table("documents").select("doc_id", F.col("text").alias("v"))
    found = DC.decode_candidates(rows, "v", ["doc_id"])
    return found.select("doc_id", "codec", F.octet_length("decoded").alias("bytes"), F.md5("decoded").alias("digest"))


@query("fn_11_as_printable", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR length(text) = 0 THEN NULL ELSE md5(text) END AS digest FROM documents""")
def _(t):
    """Every third text is turned into control bytes and must not read as text."""
    raw = F.encode("text", "UTF-8")
    noise = F.unhex(F.repeat(F.lit("0102030400FF"), F.octet_length("text")))
    bytes_ = F.when(F.col("doc_id") % 3 == 0, noise).otherwise(raw)
    return t.table("documents").select("doc_id", F.md5(DC.as_printable(bytes_)).alias("digest"))


@query("fn_13_byte_window", """WITH b AS (SELECT p_partkey, encode(p_name || ' ' || p_type) AS w FROM part), l AS (SELECT p_partkey, w, unnest(range((octet_length(w) + 15) // 16)) AS i FROM b),
h AS (SELECT p_partkey, i, lower(hex(w[i * 16 + 1 : i * 16 + 16])) AS x, decode(w[i * 16 + 1 : i * 16 + 16]) AS a FROM l)
SELECT p_partkey, string_agg(printf('%08x', i * 16) || '  ' || rpad(trim(regexp_replace(x, '(..)', '\\1 ', 'g')), 47, ' ') || '  |' || regexp_replace(a, '[^\\x20-\\x7e]', '.', 'g') || '|', chr(10) ORDER BY i) AS lines FROM h GROUP BY p_partkey""".replace("\\\\", "\\"))
def _(t):
    content = F.encode(F.concat("p_name", F.lit(" "), "p_type"), "UTF-8")
    return t.table("part").select("p_partkey", DC.byte_window(content, 0, 512).alias("lines"))


by_value(__name__)
