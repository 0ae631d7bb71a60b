"""From documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of documents; the last returns the pieces of every document that is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideweave.llm import exact_dedup, jaccard, mixing, pieces, quality
from tideweave.llm.queries import documents, piece_model
from tideweave.llm.shared import kept


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, round_trip of every document taken."""
    return pieces.encode_decode(docs, piece_model(), with_text=False)


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentence_pieces),
]

#: The classifier and the tokenizer have no equivalent in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is kept in the shared folder for the next."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, f"stage{i}")
    return docs
