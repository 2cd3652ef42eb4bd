"""Fusion of graph and document sources (query_id, source_type, source_id, score, content) into ranked contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

GRAPH, DOCUMENT = "graph", "document"


def _ranked(sources: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source_type", "source_id")
    return sources.withColumn("rank", F.row_number().over(w))


def weighted(sources: DataFrame, graph_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    weight = F.when(F.col("source_type") == GRAPH, graph_weight).otherwise(vector_weight)
    return _ranked(sources.withColumn("score", F.round(F.col("score") * weight, 6)))


def reciprocal_rank(sources: DataFrame, k: int = 60) -> DataFrame:
    """The score is 1 / (k + rank within the source type)."""
    w = Window.partitionBy("query_id", "source_type").orderBy(F.col("score").desc(), "source_id")
    return _ranked(sources.withColumn("score", F.round(1.0 / (k + F.row_number().over(w)), 9)))


def rrf_lists(lists: list[DataFrame], k: int = 60, top: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): ranked lists (query_id, chunk_id, rank) merged by reciprocal rank."""
    whole = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        whole = whole.unionByName(other.select("query_id", "chunk_id", "rank"))
    summed = whole.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return summed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rerank(sources: DataFrame) -> DataFrame:
    return _ranked(sources)


def concatenate(sources: DataFrame) -> DataFrame:
    """Graph sources first, then documents, in the order of their ids."""
    w = Window.partitionBy("query_id").orderBy(F.col("source_type").desc(), "source_id")
    return sources.withColumn("rank", F.row_number().over(w))


STRATEGIES = {"concatenation": concatenate, "weighted": weighted, "reciprocal_rank": reciprocal_rank, "rerank": rerank}


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("source_type") == GRAPH).alias("n_graph"), F.count_if(F.col("source_type") == DOCUMENT).alias("n_documents"))


NOTHING = "【背景知识】暂无相关知识。"


def contexts(ranked: DataFrame, most: int = 4000, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context): graph contents, then numbered documents with their scores, cut at most characters. queries (query_id): also
    those without a source get a row, which says so."""
    w = Window.partitionBy("query_id", "source_type").orderBy("rank")
    numbered = ranked.withColumn("no", F.row_number().over(w))
    line = F.when(F.col("source_type") == GRAPH, F.col("content")).otherwise(F.concat(F.format_string("\n[%d] (相似度: %s)\n", F.col("no"), C.three_digits(F.col("score"))), F.col("content")))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("source_type") == kind, F.struct("no", "line"))))
    g = numbered.withColumn("line", line).groupBy("query_id").agg(of(GRAPH).alias("g"), of(DOCUMENT).alias("d"))
    block = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, lambda x: x["line"]), "\n"))).otherwise(F.lit(""))
    text = F.concat(F.lit("【背景知识】"), block("g", "\n\n【知识图谱】\n"), block("d", "\n\n【文档资料】\n"))
    told = g.select("query_id", C.truncated(text, most).alias("context"))
    return told if queries is None else queries.select("query_id").join(told, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NOTHING)))


def prompt(context, marks=None):
    """A language model's prompt column around a context column; marks may list the sources."""
    head = F.lit("【背景知识】\n以下是相关的医疗知识，请基于这些知识回答问题：\n\n")
    return F.concat(head, context) if marks is None else F.concat(head, context, F.lit("\n\n【知识来源】\n"), marks)
