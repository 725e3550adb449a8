"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from outfall.llm.centroids import cluster_sql, cluster_vectors
from outfall.llm.chat import chat_digest
from outfall.llm.common import table
from outfall.llm.ensemble import rule_quality
from outfall.llm.jaccard import similar_components
from outfall.llm.lattice import link_vectors
from outfall.llm.lines import line_digest
from outfall.llm.mixing import mix_schedule
from outfall.llm.pages import extract
from outfall.llm.pieces import token_digest
from outfall.llm.quality import quality
from outfall.llm.search import SEARCH_SQL, search
from outfall.llm.sharding import shard_documents
from outfall.llm.toxicity import toxicity

QUERIES = {
    "op1_deletion_line_dedup": lambda spark, sf_dir: line_digest(table(spark, sf_dir, "documents")),
    "op2_lattice_near_dup": lambda spark, sf_dir: link_vectors(table(spark, sf_dir, "embeddings")),
    "op3_temperature_mix": lambda spark, sf_dir: mix_schedule(table(spark, sf_dir, "documents")),
    "op4_line_crf_quality": lambda spark, sf_dir: quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]),
    "op5_sentencepiece_scan": lambda spark, sf_dir: token_digest(table(spark, sf_dir, "documents")),
    "op6_token_group_join": lambda spark, sf_dir: similar_components(table(spark, sf_dir, "documents")).drop("rk", "comp"),
    "op7_html_extract": lambda spark, sf_dir: extract(table(spark, sf_dir, "pages")),
    "op8_kneser_ney_toxicity": lambda spark, sf_dir: toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_chat_format": lambda spark, sf_dir: chat_digest(table(spark, sf_dir, "conversations")),
    "op10_histogram_shards": lambda spark, sf_dir: shard_documents(table(spark, sf_dir, "documents")),
    "op11_rule_ensemble": lambda spark, sf_dir: rule_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_centroid_clusters": lambda spark, sf_dir: cluster_vectors(table(spark, sf_dir, "embeddings")),
    "op13_mask_search": lambda spark, sf_dir: search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}
ORACLES: dict[str, str] = {"op12_centroid_clusters": cluster_sql(), "op13_mask_search": SEARCH_SQL}
