"""The corpus pipeline: toxic documents go, documents of no known language go, one document of each group of near copies stays,
and what is left is packed into windows.

What stages do with odd rows: a null or empty text isn't toxic, but of no language, so it goes in the second stage. Null doc_ids
are kept by the first three stages and come first in the windows, each row for itself (they are copies of nothing). Rows that
repeat both doc_id and text become one. Ties: of near copies the least doc_id stays; a weight or a confidence at exactly its
threshold counts as reached. Texts of any length are read whole. Extra columns, whatever their names, go through all stages but the last.
No documents give no windows; no labels leave the lexicon as it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import stored, table
from lodestone.llm.jaccard import drop_near_copies
from lodestone.llm.langid import keep_identified
from lodestone.llm.packing import pack
from lodestone.llm.toxicity import drop_toxic, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones, by the lexicon and what labels teach."""
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose language is rejected, by a model of their own lang."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the least doc_id of each class of near copies."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of the tokens of docs."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("language ID", language), ("n-gram Jaccard join", near_copies), ("packing", packing)]

#: The lexicon and the model that are learned from labels, and BPE, can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over the documents; all but the last are written and read again, as the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
