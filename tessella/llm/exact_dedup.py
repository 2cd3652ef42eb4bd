"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when identical after white space is deleted. A SHA-256 digest stands for the normalised text.

1. One scan turns texts into a narrow table (id, digest, length), written to the shared folder.
2. A Misra-Gries summary (Spark's frequent-items sketch, the mergeable form of that algorithm) is built for
   each of TREE groups of partitions and then merged; it names every digest that holds at least one row in
   HEAVY_SHARE. At most HEAVY_MOST digests can be named, whatever the input.
3. The candidates' exact counts and winners come from a map-side filter and a partially aggregated group-by
   (verification). The verified ones, at most HEAVY_MOST narrow rows, are broadcast: their rows are decided
   on the map side and never shuffled.
4. The remaining digests hold less than one row in HEAVY_SHARE each and take an ordinary shuffle.

Cases: null or empty text is the empty normalised text and forms one group; a null id loses ties against any
id; repeated rows count as rows, and exactly one row of a group is kept; an empty table gives an empty result.
Only the id and text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, checked, cut, documents, text_of, without_ids

#: A digest with at least 1 / HEAVY_SHARE of all rows is a heavy hitter; the summary's error is far smaller.
HEAVY_SHARE = 1024
#: Most heavy hitters that the summary can name, and the counters that it holds.
HEAVY_MOST, TRACKED = 2048, 16384
#: Groups of partitions whose summaries are merged before the last merge.
TREE = 64


def normalised(text: str = "text"):
    return F.regexp_replace(text_of(text), f"[{SPACE}]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.encode(normalised(text_col), "UTF-8"), 256).alias("text_sha256"),
        F.length(text_of(text_col)).cast("long").alias("n_points"),
    )


def heavy_hitters(table: DataFrame, key: str) -> DataFrame:
    """Candidate keys (item) by a Misra-Gries summary; complete for keys with 1 / HEAVY_SHARE of the rows or more."""
    leaves = table.select(F.xxhash64(key).alias("h")).groupBy((F.spark_partition_id() % TREE).alias("leaf")).agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("part"))
    # One group with a key: a global aggregate would also combine the empty buffers of empty partitions, which the sketch refuses.
    named = leaves.groupBy((F.col("leaf") < 0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(part, {TRACKED}), {HEAVY_MOST})").alias("top"))
    return named.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))


def group_stats(rows: DataFrame) -> DataFrame:
    """Size and winner of each digest: most code points, then smallest id."""
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    return rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_points"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    table = cut(digests(docs, id_col, text_col), "digests")
    total = table.count()
    if total == 0:
        return table.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    least = max(2, total // HEAVY_SHARE)
    suspects = heavy_hitters(table, "text_sha256")
    chosen = table.join(F.broadcast(suspects), F.xxhash64("text_sha256") == F.col("h"), "left_semi")
    winners = cut(group_stats(chosen).filter(F.col("group_size") >= least), "winners")

    first = Window.partitionBy("text_sha256").orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last())
    whole = Window.partitionBy("text_sha256")
    hot = table.join(F.broadcast(winners), "text_sha256")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    crowned = hot.filter(wins).withColumn("kept", F.row_number().over(first) == 1).select(columns)
    removed = hot.filter(~wins).withColumn("kept", F.lit(False)).select(columns)
    rest = (
        table.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("keep_id", F.first("doc_id").over(first))
        .withColumn("group_size", F.count(F.lit(1)).over(whole))
        .withColumn("kept", F.row_number().over(first) == 1)
        .select(columns)
    )
    return crowned.unionByName(removed).unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns only: one row of each group of equal texts.

    Rows that are alone or win are told by id; of rows that repeat an id and text, one stays.
    """
    decided = cut(exact_dedup(docs, id_col, text_col), "decided")
    dropped = decided.groupBy("doc_id").agg(F.max("kept").alias("any_kept")).filter(~F.col("any_kept")).select(F.col("doc_id").alias("__gone"))
    left = without_ids(docs, id_col, dropped)
    rows = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay"))
    repeated, n = checked(rows.filter("stay > 0 and rows > stay").select(F.col("doc_id").alias("__again")), "again")
    if not n:
        return left
    same = F.col(id_col).eqNullSafe(F.col("__again"))
    once = left.join(repeated, same, "left_semi").withColumn("__norm", F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)).dropDuplicates([id_col, "__norm"]).drop("__norm")
    return left.join(repeated, same, "left_anti").unionByName(once)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256, length(coalesce(text, '')) as n
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id asc nulls last)
"""
