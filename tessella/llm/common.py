"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Rows in an Arrow batch: texts can be long, so batches are kept small.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs in one process (tests), a new one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and lost executors cost nothing written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.written = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` gave and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a Python worker never holds thousands of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def drawn(rows: DataFrame, group: str, most: int, *key: str) -> DataFrame:
    """The rows (group and key columns) with the lowest hashes of the key, at most `most` of each group: the same ones whatever the partitions.

    Two scans: group sizes, then rows below a hash bound that lets about a quarter more than `most` through, ranked among themselves.
    Groups are the labels of a classifier, so there are few of them."""
    sizes = F.broadcast(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")))
    span = 1 << 30
    near = rows.join(sizes, group).withColumn("__h", F.pmod(F.xxhash64(*key), F.lit(span)))
    near = near.filter(F.col("__h") <= F.lit(span * (1.25 * most + 40)) / F.col("__n")).dropDuplicates([group, *key])
    order = Window.partitionBy(group).orderBy("__h", *key)
    return near.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most).select(group, *(k for k in key if k != group))


#: Ids are broadcast up to this many rows (about 16 bytes each); beyond, joins shuffle.
BROADCAST_IDS = 1_000_000


def checked(ids: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(ids, rows): written to the shared folder, counted, and marked for broadcast only if at most BROADCAST_IDS rows."""
    held = cut(ids, label)
    n = held.count()
    return (F.broadcast(held) if n <= BROADCAST_IDS else held), n


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not among gone (one column __gone). Texts are only shuffled if there are too many ids to broadcast."""
    held, n = checked(gone, "gone")
    return docs.join(held, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti") if n else docs
