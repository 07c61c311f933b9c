"""History index: which sessions a month had, independent of surviving transcripts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtrace import dims
from loomtrace.sources import files as R


def read(spark: SparkSession, paths, tenant: str = "local") -> DataFrame:
    """(tenant_id, session_id, month), automated probe projects left out."""
    v = F.col("v")
    rows = R.lines(spark, paths).withColumn("v", F.try_parse_json("value")).filter(R.kind(v).startswith("OBJECT"))
    project = F.lower(F.coalesce(R.get(v, "$.project"), F.lit("")))
    probe = reduce(lambda a, b: a | b, [project.contains(n) for n in dims.PROBE_PROJECT_NEEDLES])
    raw = R.get(v, "$.timestamp").try_cast("double")
    ms = F.when(raw > 1e12, raw).otherwise(raw * 1000)
    return rows.filter(~probe).select(
        F.lit(tenant).alias("tenant_id"), R.non_empty(R.get(v, "$.sessionId")).alias("session_id"),
        F.date_format(F.timestamp_micros((ms * 1000).cast("bigint")), "yyyy-MM").alias("month")).filter(
        "session_id is not null and month is not null").distinct()
