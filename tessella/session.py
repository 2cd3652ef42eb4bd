"""The session that queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, and the last value of a repeated map key."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.ui.enabled": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
