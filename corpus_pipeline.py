"""The corpus pipeline: from documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame that is written and read again. All but the
last return the columns of ``documents``; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfall.llm.common import stored, table
from outfall.llm.jaccard import keep_one
from outfall.llm.lines import dedup_lines
from outfall.llm.mixing import mixed
from outfall.llm.pieces import encode_merges
from outfall.llm.quality import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate lines go; a null text fails."""
    judged = quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no word is left; n_chars follows the text."""
    left = dedup_lines(docs.select(*COLUMNS), COLUMNS)
    return left.where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the smallest doc_id; a document without words is no group."""
    return keep_one(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources that weigh too little are repeated; every document stays at least once."""
    return mixed(docs, COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    ids = encode_merges(docs, ["doc_id", "lang", "source", "n_chars"])
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing), ("SentencePiece encoding", sentencepiece),
]
#: No SQL: the random field and the merges are not expressible.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
