"""Vector, keyword and hybrid search over chunk tables (chunk_id, tokens, embedding, and columns to filter by).

Queries are a table too: a batch is scored in one plan. The query side is the small one and is broadcast only behind a
check of its rows; beyond it, the equi-joined paths (keyword) shuffle, and the vector path runs in blocks of queries. These make every pair; `search` ranks and
makes only the pairs that can be among the best (see `nearest`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .nearest import candidates

#: Weights of the vector and the keyword score in a hybrid one.
HYBRID = (0.7, 0.3)
#: Queries that are compared with a table at once.
QUERY_BLOCK = 10_000
#: Rows (query, token) that are broadcast at most, some tens of bytes each.
BROADCAST_TOKENS = 1_000_000
#: Chunks of a token in one row of the inverted index, about, at most.
POSTINGS = 100_000


def filtered(chunks: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose columns are in the lists given; an empty list filters nothing."""
    for name, values in allowed.items():
        if values:
            chunks = chunks.filter(F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if dict(chunks.dtypes)[name].startswith("array") else F.col(name).isin(values))
    return chunks


def vector_scores(queries: DataFrame, chunks: DataFrame, least: float = 0.0, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk_id, score) of queries (query_id, vector) against all chunks (chunk_id, embedding): dot products.

    A stated set of queries against all rows: the queries, in blocks of bounded size, are broadcast to the chunks.
    """
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for k in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        both = chunks.select("chunk_id", "embedding").join(F.broadcast(some.select("query_id", "vector")))
        parts.append(both.select("query_id", "chunk_id", F.round(C.dot(F.col("vector"), F.col("embedding")), 6).alias("score")))
    return reduce(DataFrame.unionByName, parts).filter(F.col("score") >= least)


def top_k(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each query with a 1-based rank; ties by chunk."""
    w = Window.partitionBy(*(by or ("query_id",))).orderBy(F.col("score").desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) by token overlap, from an inverted-list join on distinct tokens.

    queries: (query_id, tokens), chunks: (chunk_id, tokens). Only pairs with a token in common are made. Up to BROADCAST_TOKENS rows the query side is
    broadcast: no token of a chunk is shuffled, and a chunk's hits are summed where it lies. Beyond it the sides meet by token, hot ones split at run time.
    """
    asked = queries.select("query_id", F.size("tokens").alias("n_query"), F.explode("tokens").alias("token")).groupBy("query_id", "n_query", "token").agg(F.count(F.lit(1)).alias("times"))
    if asked.count() <= BROADCAST_TOKENS:
        asked = F.broadcast(asked)
    held = chunks.select("chunk_id", F.array_distinct("tokens").alias("t")).select("chunk_id", F.size("t").alias("n_doc"), F.explode("t").alias("token"))
    hits = held.join(asked, "token").groupBy("query_id", "chunk_id", "n_query", "n_doc").agg(F.sum("times").alias("hits"))
    return hits.select("query_id", "chunk_id", F.round(F.col("hits") / F.greatest("n_query", "n_doc"), 6).alias("score"))


def inverted_index(chunks: DataFrame, block: int = POSTINGS) -> DataFrame:
    """(token, block, postings): for each token the chunks that hold it, dealt by a hash into blocks of about `block` at most and sorted in each, so no row grows with a hot token."""
    blocks = max(1, -(-chunks.count() // block))
    held = chunks.select("chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("block"), F.explode(F.array_distinct("tokens")).alias("token"))
    return held.groupBy("token", "block").agg(F.array_sort(F.collect_list("chunk_id")).alias("postings"))


def keyword_prefilter(pairs: DataFrame, flag: Column) -> DataFrame:
    """Of each query's candidates those with the flag, or all of them if none has it. Only the queries with a hit are grouped; candidates stay where they are."""
    told = pairs.withColumn("__hit", F.coalesce(flag, F.lit(False)))
    answered = told.filter("__hit").select("query_id").distinct().withColumn("__any", F.lit(True))
    return told.join(answered, "query_id", "left").filter("__hit or __any is null").drop("__hit", "__any")


def hybrid_score(vector: Column, keyword: Column, vector_weight: float = HYBRID[0], keyword_weight: float = HYBRID[1]) -> Column:
    """The weighted sum of both scores; a missing one is 0."""
    return F.round(vector_weight * F.coalesce(vector, F.lit(0.0)) + keyword_weight * F.coalesce(keyword, F.lit(0.0)), 9)


def hybrid_scores(vector: DataFrame, keyword: DataFrame, vector_weight: float = HYBRID[0], keyword_weight: float = HYBRID[1]) -> DataFrame:
    """The full outer join of both scores; a missing one is 0."""
    v, k = vector.withColumnRenamed("score", "v"), keyword.withColumnRenamed("score", "k")
    return v.join(k, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", hybrid_score(F.col("v"), F.col("k"), vector_weight, keyword_weight).alias("score"))


def search(queries: DataFrame, chunks: DataFrame, mode: str = "vector_only", k: int = 10, least: float = 0.0, **allowed: list | None) -> DataFrame:
    """(query_id, chunk_id, score, rank) in mode vector_only, keyword_only or hybrid. Keyword search needs no vectors."""
    pool = filtered(chunks, **allowed)
    if mode == "vector_only":
        pairs = candidates(queries, pool, k, True, False, least)
        return top_k(pairs.select("query_id", "chunk_id", F.round("dot", 6).alias("score")).filter(F.col("score") >= least), k)
    share = F.round(F.col("hits") / F.greatest("n_query", "n_doc"), 6)
    if mode == "keyword_only":
        return top_k(candidates(queries, pool, k, False, True).select("query_id", "chunk_id", share.alias("score")), k)
    pairs = candidates(queries, pool, k, True, True, least, HYBRID)
    vector = F.when(F.round("dot", 6) >= least, F.round("dot", 6))
    told = pairs.select("query_id", "chunk_id", vector.alias("v"), F.when(F.col("hits") > 0, share).alias("k"))
    # The keyword prefilter holds for the vector side too, with its fallback.
    answered = F.max(F.col("v").isNotNull() & F.col("k").isNotNull()).over(Window.partitionBy("query_id"))
    left = told.withColumn("__any", answered).filter(F.col("k").isNotNull() | (F.col("v").isNotNull() & ~F.col("__any")))
    return top_k(left.select("query_id", "chunk_id", hybrid_score(F.col("v"), F.col("k")).alias("score")), k)


def rank_then_threshold(scores: DataFrame, k: int, least: float) -> DataFrame:
    """Ranks before the threshold, so ranks may have gaps."""
    return top_k(scores, k).filter(F.col("score") >= least)


def context_budget(results: DataFrame, most: int = 4000, head: str = "【文档知识增强】") -> DataFrame:
    """Ranked results (query_id, rank, score, text) that fit the budget, the first that does not cut short if over 50 characters are left.

    Adds used (characters before the row), kept text and truncated. A cost is the text, its score label and 20.
    """
    label = F.length(F.format_string(" (相似度: %s)", C.three_digits(F.col("score"))))
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = results.withColumn("text", C.strip(F.col("text"))).withColumn("cost", F.length("text") + label + 20)
    sized = sized.withColumn("used", F.lit(len(head)) + F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.col("used") + F.col("cost") <= most
    left = F.lit(most) - F.col("used") - label - 30
    first_over = ~fits & (F.sum((~fits).cast("int")).over(w) == 1) & (left > 50)
    kept = F.when(fits, F.col("text")).when(first_over, F.concat(F.substring("text", F.lit(1), left.cast("int")), F.lit("...")))
    return sized.withColumn("kept_text", kept).withColumn("truncated", first_over).filter(F.col("kept_text").isNotNull()).drop("cost")


def validate_chunks(chunks: DataFrame, dim: int) -> DataFrame:
    """chunks with a reason column: null where the row can be loaded, else why not."""
    reason = F.when(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) == "", "no_id").when(F.col("embedding").isNull(), "no_embedding").when(F.size("embedding") != dim, "bad_dim")
    return chunks.withColumn("reason", reason)


def upsert_latest(rows: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """One row for each key: the latest version wins."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def add_chunks(chunks: DataFrame, embed) -> DataFrame:
    """Embeds only rows without an embedding: embed is a pandas UDF from text to array<float>."""
    have = chunks.filter(F.col("embedding").isNotNull())
    lack = chunks.filter(F.col("embedding").isNull()).withColumn("embedding", embed(F.col("text")))
    return have.unionByName(lack)
