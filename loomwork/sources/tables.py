"""Table access shared by all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; the session's time zone is set to UTC, as all stamps are UTC, and the package is sent to the executors."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
