"""Components an artifact declares about itself: manifests and Go build information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.functions import text as T
from outfall.operators.ordered import top_k

# Fixed values
MIN_GO_BINARY = 1_000_000
GO_MARKER = "Go buildinf:"
GO_LINE = r"(?:dep|mod)\t([\w./+~-]{3,180})\t(v[\w.+~-]{1,60})"
NUSPEC_ID = r"(?i)<id>\s*([^<]{1,200})</id>"
NUSPEC_VERSION = r"(?i)<version>\s*([^<]{1,80})</version>"
NUSPEC_LICENSE = r"(?i)<license[^>]*>\s*([^<]{1,120})</license>"
COMPONENT = "struct<ecosystem:string,name:string,version:string,licence:string,evidence:string>"


def _component(ecosystem: str, name: Column, version: Column, licence: Column, evidence: str) -> Column:
    return F.struct(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), licence.alias("licence"),
                    F.lit(evidence).alias("evidence"))


def _licence(raw: Column) -> Column:
    return T.spdx_expression(T.clean(raw))


def _json_licence(text: Column, key: str) -> Column:
    """The key as a string, an object with a type, or the first element of a list; null when absent or empty."""
    bare = F.get_json_object(text, f"$.{key}")
    first = F.get_json_object(text, f"$.{key}[0]")
    plain = F.when(bare.startswith("{") | bare.startswith("["), F.lit("")).otherwise(bare)
    plain_first = F.when(first.startswith("{") | first.startswith("["), F.lit("")).otherwise(first)
    value = F.coalesce(F.get_json_object(text, f"$.{key}.type"), F.get_json_object(text, f"$.{key}[0].type"),
                       F.when(bare.startswith("["), plain_first), plain)
    return F.when(bare.isNull() | bare.isin("", "{}", "[]"), F.lit(None).cast("string")).otherwise(value)


def npm(text: Column) -> Column:
    name, version = T.clean(F.get_json_object(text, "$.name")), T.clean(F.get_json_object(text, "$.version"))
    licence = _licence(F.coalesce(_json_licence(text, "license"), _json_licence(text, "licence")))
    return F.when((name != "") & (version != ""), _component("npm", name, version, licence, "package.json"))


def nuget(text: Column) -> Column:
    found = text.rlike(NUSPEC_ID) & text.rlike(NUSPEC_VERSION)
    return F.when(found, _component("nuget", T.clean(F.regexp_extract(text, NUSPEC_ID, 1)), T.clean(F.regexp_extract(text, NUSPEC_VERSION, 1)),
                                    _licence(F.regexp_extract(text, NUSPEC_LICENSE, 1)), ".nuspec"))


def pypi(text: Column) -> Column:
    def header(name: str) -> str:
        return rf"(?md)^{name}:\s*(.+)$"

    found = text.rlike(header("Name")) & text.rlike(header("Version"))
    return F.when(found, _component("pypi", T.clean(F.regexp_extract(text, header("Name"), 1)), T.clean(F.regexp_extract(text, header("Version"), 1)),
                                    _licence(F.regexp_extract(text, header("License"), 1)), "dist-info METADATA"))


def golang(content: Column) -> Column:
    """Distinct (module, version) pairs stamped into the binary."""
    text = F.decode(content, "ISO-8859-1")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(GO_LINE), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(GO_LINE), F.lit(2)).alias("version"))
    modules = F.array_distinct(F.filter(pairs, lambda p: F.contains(p["name"], F.lit("."))))
    rows = F.transform(modules, lambda p: _component("golang", p["name"], p["version"], F.lit(""), "Go buildinfo"))
    return F.when(F.contains(text, F.lit(GO_MARKER)), rows)


def detect_components(files: DataFrame, by: list[str]) -> DataFrame:
    """Every component each file declares, in one pass over the files.

    ``files``: by, path_in_tree, filename, content (binary).
    """
    name, path, content = F.lower("filename"), F.lower("path_in_tree"), F.col("content")
    size = F.octet_length(content)
    text = content.cast("string")
    magic = F.hex(F.substring(content, 1, 4))
    declared = (
        F.when(name == "package.json", npm(text))
        .when((name == "metadata") & F.contains(path, F.lit(".dist-info")), pypi(text))
        .when(name.endswith(".nuspec"), nuget(text))
    )
    binary = ~name.isin("package.json", "metadata") & ~name.endswith(".nuspec") & (size > MIN_GO_BINARY)
    go = F.when(binary & ((magic == "7F454C46") | magic.startswith("4D5A")), golang(content))
    found = F.concat(F.array_compact(F.array(declared.cast(COMPONENT))), F.coalesce(go.cast(f"array<{COMPONENT}>"), F.array().cast(f"array<{COMPONENT}>")))
    return files.select(*by, "path_in_tree", F.inline(found))


def component_inventory(components: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """Distinct components with their first place, all of them; with a ``cap`` at most so many per artifact, in inventory order, and flagged."""
    key = [*by, "ecosystem", "name", "version"]
    first = F.min(F.struct("path_in_tree", "licence", "evidence"))
    distinct = components.groupBy(*key).agg(first.alias("f")).select(*key, "f.*")
    if cap is None:
        flagged = distinct.withColumn("truncated", F.lit(False))
    else:
        sizes = distinct.groupBy(*by).agg((F.count("*") > cap).alias("truncated"))
        kept = top_k(distinct, by, ["ecosystem", F.lower("name"), "version", "name"], cap)
        flagged = kept.join(sizes, by) if by else kept
    return flagged.withColumns({"confidence": F.lit("declared"), "purl": T.purl(F.col("ecosystem"), F.col("name"), F.col("version"))})


def by_ecosystem(inventory: DataFrame, by: list[str]) -> DataFrame:
    return inventory.groupBy(*by, "ecosystem").agg(F.count("*").alias("components"))
