"""Result tables: partitioned, re-runnable, with failures beside them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, partition: list[str], good: str = "failure IS NULL") -> None:
    """Good rows to partitions that replace only themselves, failed keys to a side table.

    Spark commits a partition when its tasks are done, so a rerun after a lost
    executor or a stop leaves whole partitions only.
    """
    spark = df.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.where(good).write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/results")
        df.where(f"NOT ({good})").write.mode("overwrite").parquet(f"{path}/failures")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def archive(records: DataFrame, path: str, group: str) -> None:
    """Audio-free study archive: payload and hash per record, by group."""
    payload = F.to_json(F.struct("*"))
    records.select(group, payload.alias("payload"), F.sha2(payload, 256).alias("sha256")).write.mode("overwrite").partitionBy(group).parquet(path)
