"""Written tables between stages.

A stage that feeds several others is written once and read back: the lineage is cut, a
lost executor costs one stage and not the whole chain, and later plans stay small.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, override: str | None = None) -> str:
    """New folder for written stages below the cluster's shared checkpoint folder.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = override or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="loomtrace-")
    return f"{base.rstrip('/')}/loomtrace-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
