"""Readers: tables, session logs and git history."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats session_log and gitlog known to a session."""
    from loomwork.sources.gitlog import GitLogSource
    from loomwork.sources.session_log import SessionLogSource
    from loomwork.sources.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionLogSource)
    spark.dataSource.register(GitLogSource)
