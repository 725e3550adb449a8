"""Interchange exports: SARIF 2.1.0 and CycloneDX 1.5.

Rows carry one JSON object each; a document is the ordered concatenation of a
head, the object rows and a tail, so no document is ever built in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators.runs import packed, unpacked

# Fixed values
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECURITY_SEVERITY = {"critical": "9.5", "high": "7.5", "medium": "5.0", "low": "3.0", "info": "1.0"}
CONFIDENCE_SCORES = {"declared": 1.0, "embedded": 0.8, "inferred": 0.5}
CONFIDENCE_METHODS = {"declared": "manifest-analysis", "embedded": "binary-analysis", "inferred": "binary-analysis"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
DEFAULT_HELP = "Remove the value from the shipped artifact and rotate it if it is live."
TOOL = "outfall"


def _lookup(column: Column, table: dict) -> Column:
    out = F.lit(None)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


# --- SARIF ---------------------------------------------------------------------------
def rule_index(findings: DataFrame) -> DataFrame:
    """(run_id, rule_id, rule_index, worst): position of each rule in the sorted rule ids of its run.

    Rules per run are bounded by the pack, so this window is over a small table.
    """
    from pyspark.sql import Window as W

    worst = F.min(F.struct(T.severity_rank(F.col("severity")), "severity"))["severity"]
    sample = F.min(F.struct(T.severity_rank(F.col("severity")).alias("rank"), "id", "title", "category"))
    rules = findings.groupBy("run_id", "rule_id").agg(worst.alias("worst"), sample.alias("sample"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("rule_id")) - 1
    return rules.withColumn("rule_index", place)


def with_rule_index(findings: DataFrame) -> DataFrame:
    """Findings of a rule with its ``rule_index``, looked up in the list of their run's rules, which the pack bounds."""
    rule = F.col("rule_id")
    rules = findings.groupBy("run_id").agg(F.array_sort(F.collect_set(rule)).alias("_rules"), F.max(rule.isNull().cast("int")).alias("_blank"))
    joined = unpacked(packed(findings).join(rules, "run_id"), findings)
    indexed = joined.withColumn("rule_index", (F.array_position("_rules", rule) - 1).cast("int") + F.col("_blank")).drop("_rules", "_blank")
    return indexed.where("rule_index IS NOT NULL")  # not those without a rule; said so, the filter stays above the shared exchange


def sarif_rows(findings: DataFrame) -> DataFrame:
    """Flat result rows.  ``findings``: gate columns plus value_masked, artifact_path, byte_offset, is_new, and rule_index if it is known."""
    indexed = findings if "rule_index" in findings.columns else with_rule_index(findings)
    message = F.concat("title", F.lit(": "), "value_masked", F.when(F.col("is_new"), F.lit(" (introduced by this build)")).otherwise(F.lit("")))
    return indexed.select(
        "run_id", "rule_id", "rule_index", _lookup(F.col("severity"), LEVELS).alias("level"), message.alias("message"),
        F.when(F.coalesce("artifact_path", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("artifact_path")).alias("uri"),
        "byte_offset", F.when(F.col("byte_offset").isNotNull(), F.greatest(F.length("value_masked"), F.lit(1))).alias("byte_length"),
        F.col("id").alias("fingerprint"), "severity", "category", "status", "is_new")


def sarif_rule_rows(findings: DataFrame) -> DataFrame:
    """Rule descriptors: worst severity decides level and score."""
    rules = rule_index(findings)
    return rules.select("run_id", "rule_id", "rule_index", F.col("sample.title").alias("title"), F.col("sample.category").alias("category"),
                        "worst", _lookup(F.col("worst"), LEVELS).alias("level"), _lookup(F.col("worst"), SECURITY_SEVERITY).alias("security_severity"))


def sarif_result_json(rows: DataFrame) -> DataFrame:
    region = F.when(F.col("byte_offset").isNotNull(), F.struct(F.col("byte_offset").alias("byteOffset"), F.col("byte_length").alias("byteLength")))
    location = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(location).alias("locations"), F.struct(F.col("fingerprint").alias("findingId")).alias("partialFingerprints"),
        F.struct("severity", "category", "status", F.col("is_new").alias("isNew")).alias("properties"))
    return rows.select("run_id", "severity", "rule_id", "fingerprint", F.to_json(result).alias("json"))


def sarif_rule_json(rows: DataFrame) -> DataFrame:
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.lit(DEFAULT_HELP).alias("text"), F.lit(DEFAULT_HELP).alias("markdown")).alias("help"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct(F.array(F.lit("security"), F.col("category")).alias("tags"), F.col("security_severity").alias("security-severity"),
                 F.col("worst").alias("severity")).alias("properties"))
    return rows.select("run_id", "rule_index", F.to_json(rule).alias("json"))


def _document(parts: list[tuple[int, DataFrame, list]], head: dict[int, Column], runs: DataFrame | None = None) -> DataFrame:
    """Order the JSON lines of each run: section, then the section's own keys.  ``runs`` (run_id) get a document also without lines."""
    lines = None
    for section, rows, keys in parts:
        key = F.concat_ws("\x1f", *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys])
        piece = rows.select("run_id", F.lit(section).alias("section"), key.alias("key"), F.col("json").alias("line"))
        lines = piece if lines is None else lines.unionByName(piece)
    lines = lines.distinct()
    first = lines.groupBy("run_id", "section").agg(F.min(F.struct("key", "line")).alias("first"))
    marked = lines.join(first, ["run_id", "section"])
    comma = F.when(F.struct("key", "line") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    body = marked.select("run_id", "section", "key", F.concat(comma, "line").alias("line"))
    runs = lines.select("run_id").distinct() if runs is None else lines.select("run_id").union(runs.select("run_id")).distinct()
    fixed = F.array(*[F.struct(F.lit(s).alias("section"), F.lit("").alias("key"), text.alias("line")) for s, text in head.items()])
    return body.unionByName(runs.select("run_id", F.inline(fixed)))


def sarif_lines(findings: DataFrame, version: str = "0.1.0", runs: DataFrame | None = None) -> DataFrame:
    """Lines of one SARIF log per run; in (section, key) order they are the document.  ``runs``: also for clean ones."""
    rows = sarif_rows(findings)
    start = F.lit('{"$schema":"%s","version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s","version":"%s","rules":[' % (SARIF_SCHEMA, TOOL, version))
    end = F.concat(F.lit('],"properties":'), F.to_json(F.struct(F.col("run_id").alias("runId"))), F.lit("}]}"))
    rank = F.lpad(T.severity_rank(F.col("severity")).cast("string"), 2, "0")
    parts = [(1, sarif_rule_json(sarif_rule_rows(findings)), [F.lpad(F.col("rule_index").cast("string"), 6, "0")]),
             (3, sarif_result_json(rows), [rank, "rule_id", "fingerprint"])]
    return _document(parts, {0: start, 2: F.lit(']}},"results":['), 4: end}, runs)


def write_documents(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write documents as text, one folder per run; part files in name order form the document."""
    n = partitions or lines.sparkSession.sparkContext.defaultParallelism
    ordered = lines.repartitionByRange(n, "run_id", "section", "key").sortWithinPartitions("run_id", "section", "key")
    ordered.select("run_id", "line").write.partitionBy("run_id").mode("overwrite").text(path)


# --- CycloneDX ---------------------------------------------------------------------------
def serial(run_id: Column, namespace: str = "sbom") -> Column:
    digest = F.sha2(F.concat(F.lit(namespace + ":"), run_id), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]))


def cyclonedx_rows(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        "run_id", F.col("purl").alias("bom_ref"), "name", "version", "licence", "evidence", "path_in_tree",
        _lookup(F.col("confidence"), CONFIDENCE_SCORES).alias("confidence_score"),
        _lookup(F.col("confidence"), CONFIDENCE_METHODS).alias("technique"), serial(F.col("run_id")).alias("serial"))


def cyclonedx_lines(inventory: DataFrame, artifacts: DataFrame, version: str = "0.1.0") -> DataFrame:
    """Lines of one CycloneDX document per run.

    ``artifacts``: run_id, name, sha256, size_bytes, files_examined, truncated.
    """
    rows = cyclonedx_rows(inventory)
    identity = F.struct(
        F.lit("purl").alias("field"), F.col("confidence_score").alias("confidence"),
        F.array(F.struct("technique", F.col("confidence_score").alias("confidence"),
                         F.when(F.col("evidence") == "", F.col("path_in_tree")).otherwise(F.col("evidence")).alias("value"))).alias("methods"))
    licences = F.when(F.col("licence") != "", F.array(F.struct(F.col("licence").alias("expression"))))
    component = F.struct(
        F.lit("library").alias("type"), F.col("bom_ref").alias("bom-ref"), "name", "version", F.col("bom_ref").alias("purl"),
        F.struct(identity.alias("identity")).alias("evidence"), licences.alias("licenses"),
        F.array(F.struct(F.lit(f"{TOOL}:path").alias("name"), F.col("path_in_tree").alias("value"))).alias("properties"))
    lines = rows.select("run_id", "bom_ref", "path_in_tree", F.to_json(component).alias("json"))

    def prop(name: str, value: Column) -> Column:
        return F.struct(F.lit(f"{TOOL}:{name}").alias("name"), value.cast("string").alias("value"))

    subject = F.struct(
        F.lit("application").alias("type"), F.concat(F.lit("artifact:"), F.substring("sha256", 1, 32)).alias("bom-ref"), "name",
        F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content"))).alias("hashes"),
        F.array(prop("run", F.col("run_id")), prop("size_bytes", F.col("size_bytes")), prop("files_examined", F.col("files_examined")),
                prop("inventory_complete", ~F.col("truncated"))).alias("properties"))
    tools = F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(TOOL).alias("name"), F.lit(version).alias("version"))).alias("components"))
    metadata = F.to_json(F.struct(tools.alias("tools"), subject.alias("component")))
    start = F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"'), serial(F.col("run_id")),
                     F.lit('","version":1,"metadata":'), metadata, F.lit(',"components":['))
    heads = artifacts.select("run_id", F.lit(0).alias("section"), F.lit("").alias("key"), start.alias("line"))
    tails = artifacts.select("run_id", F.lit(2).alias("section"), F.lit("").alias("key"), F.lit("]}").alias("line"))
    first = lines.groupBy("run_id").agg(F.min(F.struct("bom_ref", "path_in_tree")).alias("first"))
    comma = F.when(F.struct("bom_ref", "path_in_tree") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    middle = lines.join(first, "run_id").select("run_id", F.lit(1).alias("section"), F.concat_ws("\x1f", "bom_ref", "path_in_tree").alias("key"),
                                              F.concat(comma, "json").alias("line"))
    return heads.unionByName(middle).unionByName(tails)
