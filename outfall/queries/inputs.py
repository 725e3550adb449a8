"""Inputs of the registered queries: the given tables and views derived from them.

``VIEWS`` is SQL that Spark and DuckDB read alike, so both sides of a check
start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "artifact_texts": """
SELECT 'rel-' || (p_partkey % 4) || '.zip → app/' || p_partkey || '.conf' AS path_in_tree,
  CASE p_partkey % 22
    WHEN 0 THEN 'url=jdbc:postgresql://db-' || (p_partkey % 90) || '.internal:5432/orders'
    WHEN 1 THEN 'api_key = "' || md5('k' || (p_partkey % 300)) || '"'
    WHEN 2 THEN 'src /home/jenkins/workspace/fw' || (p_partkey % 40) || '/src/main.c'
    WHEN 3 THEN 'C:' || chr(92) || 'agent' || chr(92) || '_work' || chr(92) || (p_partkey % 60) || chr(92) || 's' || chr(92) || 'updater.pdb'
    WHEN 4 THEN 'gateway 10.' || (p_partkey % 200) || '.3.' || (p_partkey % 250)
    WHEN 5 THEN 'gateway 192.168.1.1'
    WHEN 6 THEN 'rev svn+ssh://build0' || (p_partkey % 9) || '.de.example.net/data/svn/fw'
    WHEN 7 THEN 'pay sk_live_' || md5('s' || p_partkey)
    WHEN 8 THEN 'gh ghp_' || md5('g' || (p_partkey % 50)) || 'abcd'
    WHEN 9 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 10 THEN 'repo https://git.corp.example.net/scm/platform/s' || p_partkey || '.git'
    WHEN 11 THEN 'token = "' || repeat('QUJD', 40) || md5('b') || '"'
    WHEN 12 THEN 'api_key = "changeme"'
    WHEN 13 THEN 'keystore.password=store' || (p_partkey % 30) || 'pw'
    WHEN 14 THEN 'hook xoxb-' || md5('x' || (p_partkey % 20))
    WHEN 15 THEN 'see https://jenkins.corp.example.com/job/fw/' || p_partkey || '/'
    WHEN 16 THEN 'assert c:' || chr(92) || 'src' || chr(92) || 'mod' || (p_partkey % 25) || chr(92) || 'main.cpp'
    WHEN 17 THEN 'IconFile=C:' || chr(92) || 'Users' || chr(92) || 'dev' || (p_partkey % 12) || chr(92) || 'AppData' || chr(92) || 'x.ico'
    WHEN 18 THEN '<xmp:Author>Author ' || (p_partkey % 15) || '</xmp:Author>'
    WHEN 19 THEN 'tag B' || (10000 + p_partkey % 90) || '-DV002-B-211b_11827'
    WHEN 20 THEN 'git://github.com/example/p' || p_partkey
    ELSE p_name || ' is a plain product name' END AS content
FROM part""",
    "runs": """
SELECT 'r' || o_orderkey AS run_id, 'pkg-' || (o_custkey % 50) AS name,
  md5('bytes' || (o_custkey % 50) || '-' || (o_orderkey % 3)) AS root_sha256,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'degraded' ELSE 'failed' END AS status,
  o_orderdate AS created_at, o_orderdate AS started_at,
  o_orderdate + INTERVAL 90 SECOND AS finished_at
FROM orders""",
    "findings": """
SELECT md5('f' || (l_partkey % 400)) AS id, 'r' || l_orderkey AS run_id,
  'rule-' || (l_partkey % 20) AS rule_id, 'cat-' || (l_partkey % 5) AS category,
  'Title ' || (l_partkey % 20) AS title,
  CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN min(l_returnflag) = 'A' THEN 'false_positive' WHEN min(l_returnflag) = 'R' THEN 'accepted_risk' ELSE 'open' END AS status,
  CASE WHEN min(l_linestatus) = 'F' THEN 'false_positive' ELSE NULL END AS llm_verdict,
  round(max(l_discount) * 5 + 0.4, 3) AS confidence
FROM lineitem GROUP BY l_orderkey, l_partkey % 400, l_partkey % 20, l_partkey % 5""",
    "evidence": """
SELECT 'b' || (l_suppkey % 10) AS run_id, 'rel.zip → f' || (l_suppkey % 100) AS path_in_tree,
  CASE WHEN l_partkey % 100 = 0 THEN 'rare-' || (l_partkey % 7)
       WHEN l_partkey % 50 = 1 THEN 'gone-rule' ELSE 'rule-' || (l_partkey % 20) END AS rule_id,
  md5('v' || l_partkey) AS value_hash, 'v***' || (l_partkey % 100) AS value_masked,
  l_orderkey * 8 + l_linenumber AS byte_offset,
  CASE WHEN l_orderkey % 3 = 0 THEN 'utf-16le' ELSE 'ascii' END AS encoding,
  CAST((l_partkey % 60) / 10.0 AS DOUBLE) AS entropy
FROM lineitem""",
    "run_updates": """
SELECT event_id, 'u' || user_id AS run_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'unpack' ELSE 'static' END AS analyzer,
  CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'timeout' WHEN 3 THEN 'truncated' ELSE 'completed' END AS stage_status
FROM events""",
    "waivers": """
SELECT md5('f' || (s_suppkey % 400)) AS finding_id, 'reason ' || s_suppkey AS reason,
  CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS owner,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + INTERVAL 1 DAY * CAST(s_suppkey AS INT) AS DATE) END AS expires
FROM supplier""",
    "suppressions": """
SELECT md5('v' || s_suppkey) AS value_hash, 'rule-' || (s_suppkey % 20) AS rule_id,
  CASE s_suppkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'rel.zip*' ELSE '*f1?' END AS path_pattern
FROM supplier""",
    "manifest_files": """
SELECT 'app.asar → node_modules/m' || p_partkey || '/' || CASE p_partkey % 4 WHEN 2 THEN 'x.nuspec' WHEN 3 THEN 'x.dist-info/METADATA' ELSE 'package.json' END AS path_in_tree,
  CASE p_partkey % 4 WHEN 2 THEN 'x.nuspec' WHEN 3 THEN 'METADATA' ELSE 'package.json' END AS filename,
  CASE p_partkey % 4
    WHEN 0 THEN '{"name":"@scope/p' || (p_partkey % 60) || '","version":"1.' || (p_partkey % 7) || '.0","license":"' || CASE p_partkey % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'SEE LICENSE IN ./L.md' ELSE 'MIT OR Apache-2.0' END || '"}'
    WHEN 1 THEN '{"name":"q' || (p_partkey % 60) || '","license":{"type":"ISC"}' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',"version":"2.0.' || (p_partkey % 9) || '"' END || '}'
    WHEN 2 THEN '<metadata><id> Pkg.' || (p_partkey % 30) || '</id><version>3.1</version><license type="expression">MIT</license></metadata>'
    ELSE 'Metadata-Version: 2.1' || chr(10) || 'Name: lib' || (p_partkey % 25) || chr(10) || 'Version: 0.' || (p_partkey % 4) || chr(10) || 'License: BSD' END AS content
FROM part""",
    "unpack_nodes": """
SELECT 'pkg-' || (p_partkey % 5) || '.zip' AS root,
  'pkg-' || (p_partkey % 5) || '.zip → d' || (p_partkey % 20) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' → f' || p_partkey END || CASE WHEN p_partkey % 3 = 0 THEN '/n' || p_partkey ELSE '' END AS path_in_tree,
  CASE WHEN p_partkey % 3 = 0 THEN 'pkg-' || (p_partkey % 5) || '.zip' ELSE 'pkg-' || (p_partkey % 5) || '.zip → d' || (p_partkey % 20) END AS parent_path_in_tree,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS depth, CAST(p_size * 1000 AS BIGINT) AS size_bytes
FROM part
UNION ALL
SELECT DISTINCT 'pkg-' || (p_partkey % 5) || '.zip', 'pkg-' || (p_partkey % 5) || '.zip → d' || (p_partkey % 20),
  'pkg-' || (p_partkey % 5) || '.zip', 1, CAST(9000 AS BIGINT) FROM part WHERE p_partkey % 20 < 10""",
}
# rule dimension of ``findings`` and ``evidence``
VIEWS["rule_dim"] = """
SELECT DISTINCT 'rule-' || (p_partkey % 20) AS rule_id, 'cat-' || (p_partkey % 20 % 5) AS category,
  'Title ' || (p_partkey % 20) AS title,
  CASE p_partkey % 20 % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  CAST(0.5 AS DOUBLE) AS base_confidence, CASE WHEN p_partkey % 20 % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(3.6 AS DOUBLE) END AS min_entropy
FROM part
UNION ALL
SELECT DISTINCT 'rare-' || (p_partkey % 7), 'cat-' || (p_partkey % 7 % 5), 'Rare ' || (p_partkey % 7),
  CASE p_partkey % 7 % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END,
  CAST(0.5 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM part"""
# one row per place a finding is seen
VIEWS["finding_locations"] = """
SELECT DISTINCT md5('f' || (l_partkey % 400)) AS finding_id, 'r' || l_orderkey AS run_id,
  'rel.zip → f' || (l_suppkey % 100) AS path_in_tree, l_suppkey * 16 + l_linenumber AS byte_offset
FROM lineitem"""
# stage rows of the runs
VIEWS["stages"] = """
SELECT 'r' || o_orderkey AS run_id, CASE o_orderkey % 2 WHEN 0 THEN 'unpack' ELSE 'static' END AS analyzer,
  CASE o_orderkey % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'truncated' WHEN 2 THEN 'oom' ELSE 'completed' END AS status FROM orders
UNION ALL
SELECT 'r' || o_orderkey, 'recon', CASE o_orderkey % 11 WHEN 0 THEN 'failed' ELSE 'completed' END FROM orders"""
# text rows as artifacts: documents, pages and the planted strings
VIEWS["texts"] = f"""
SELECT path_in_tree, content FROM ({VIEWS['artifact_texts']}) a
UNION ALL SELECT 'documents/' || doc_id, text FROM documents
UNION ALL SELECT 'pages/' || page_id, html FROM pages"""
# artifacts of one root per run name
VIEWS["artifacts"] = f"""
SELECT root AS run_id, path_in_tree, parent_path_in_tree, depth, size_bytes, md5(path_in_tree) AS id
FROM ({VIEWS['unpack_nodes']}) n"""


#: Parts for each split of an input that is spread: a split holds up to 128 MB of a file, and some times that in memory.
PARTS = 4


class Inputs:
    """The tables of one folder plus the derived views, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(text)

    def evidence(self) -> DataFrame:
        """``evidence`` spread by place, a key that no hot value or rule can skew."""
        return spread(self.view("evidence"), "path_in_tree", "byte_offset")

    def artifacts(self) -> DataFrame:
        """``texts`` as bytes, spread over the cores when there are only a few splits."""
        texts = self.view("texts").withColumn("content", F.encode("content", "UTF-8"))
        return spread(texts, "path_in_tree")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows by key when Spark reads the input in fewer splits than there are cores, into several parts for each split."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, PARTS * splits), *keys) if splits < cores else df
