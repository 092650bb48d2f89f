"""The corpus pipeline: quality classifier, near duplicates, substring deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. A stage works
on all that the one before has kept. Packing and a trained model have no SQL, so the stages' tests hold each against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import ngram_join, packing, quality_lm, substring_dedup
from loomgraph.llm.common import table, written

#: Documents (or parts of such) in a sequence, at most.
MAX_PIECES = 64


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts stay."""
    return quality_lm.filter_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest doc_id; null ids and empty sets stay."""
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 and more words that a document with a smaller doc_id has; documents that lose every word go."""
    return substring_dedup.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, of which none has more than MAX_PIECES."""
    return packing.pack_documents(docs, max_pieces=MAX_PIECES)


STAGES = [("quality_classifier", keep_good), ("ngram_jaccard_join", keep_one_of_each), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
