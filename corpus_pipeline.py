"""The corpus pipeline: toxicity, quality rules, exact dedup, n-gram Jaccard join, best-fit packing.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the
columns of documents.

Cases, as the operators define them: null and empty texts leave at the quality rules (too few words); very long texts are read whole, and cut only
into packed pieces; of equal texts the one with the most code points, then the smallest id stays, of a linked group the smallest id; rows are told by id and text
by the quality rules and the n-gram join; an empty table gives an empty result; further columns are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, ngram_jaccard, packing, quality_rules, toxicity
from tessella.llm.common import cut, documents, fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; the grammar learns from labels outside the held-out fold and the documents themselves."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text"), labels.filter(fold(labels["doc_id"], 4) != 2)))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their crowded lines; n_chars is that of the text that stays."""
    kept = quality_rules.keep_good(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_definition())


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_bad), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("best_fit_packing", pack)]

#: SQL can express neither the toxicity grammar nor packing; tests/llm holds the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
