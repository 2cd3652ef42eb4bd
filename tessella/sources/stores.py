"""Chunk stores: a table in a folder, created, loaded, upserted, searched and dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from .files import CHUNK


class ChunkStore:
    """Chunks under one folder, partitioned by section_type so that filters on it prune. Each load writes a hidden folder and
    then renames it to the next version; readers take the highest one, so they never see half a load. The version before
    stays for readers that began on it, older ones are deleted. One load at a time."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 1024):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self) -> list[str]:
        """The published versions, oldest first."""
        fs, jvm = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("v-"))

    def exists(self) -> bool:
        return bool(self.versions())

    def drop(self) -> None:
        fs, jvm = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.path), True)

    def create(self, recreate: bool = False) -> None:
        if recreate and self.exists():
            self.drop()
        if not self.exists():
            self._publish(self.spark.createDataFrame([], CHUNK))

    def _publish(self, rows: DataFrame) -> None:
        fs, jvm = self._fs()
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        known = self.versions()
        fresh, version = f".load-{uuid.uuid4().hex}", f"v-{int(known[-1][2:]) + 1 if known else 0:012d}"
        rows.write.partitionBy("section_type").parquet(f"{self.path}/{fresh}")
        if fs.exists(at(version)) or not fs.rename(at(fresh), at(version)):
            raise RuntimeError(f"another load has published {version}")
        for old in known[:-1]:
            fs.delete(at(old), True)

    def read(self) -> DataFrame:
        return self.spark.read.schema(CHUNK).parquet(f"{self.path}/{self.versions()[-1]}")

    def load(self, chunks: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """Valid chunks go in, the last of a chunk_id wins over the store; returns the rejected rows with reasons, and counts."""
        checked = S.validate_chunks(chunks, self.dim)
        good, bad = checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")
        new = S.upsert_latest(good.withColumn("__seq", F.monotonically_increasing_id()), "chunk_id", "__seq").drop("__seq").select(CHUNK.names)
        whole = new if not self.exists() else self.read().join(new.select("chunk_id"), "chunk_id", "left_anti").select(CHUNK.names).unionByName(new)
        self._publish(whole)
        n = checked.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("reason").isNull()).alias("inserted"), F.count_if(F.col("reason").isNotNull()).alias("skipped")).first()
        return bad, n.asDict()

    def search(self, queries: DataFrame, mode: str = "vector_only", k: int = 10, least: float = 0.0, **allowed: list | None) -> DataFrame:
        from ..functions import columns as C

        rows = self.read().withColumn("tokens", C.tokens(F.col("text")))
        return S.search(queries, rows, mode, k, least, **allowed)


def create_store(spark: SparkSession, path: str, kind: str = "parquet", **options) -> ChunkStore:
    """A store by name. All kinds are one Spark table here; the name only says where it would be served from."""
    if kind not in ("parquet", "numpy", "milvus", "qdrant"):
        raise ValueError(f"unknown store: {kind}")
    return ChunkStore(spark, path, **options)
