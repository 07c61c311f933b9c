"""All readers behind one call."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from loomtrace.plans.tables import materialize, work_dir
from loomtrace.sources import antigravity, canonical, codex, cursor, gemini, opencode, pi


def union_events(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_all(spark: SparkSession, roots: dict[str, str], tenant: str = "local", since: str | None = None,
             work: str | None = None) -> DataFrame:
    """roots: format -> path, formats claude, codex, gemini, pi, opencode, cursor, cursor_kv
    (table), antigravity (table of decoded steps), antigravity-ide.  Stages that are read more
    than once are written below `work` (default: the cluster's checkpoint folder)."""
    work = work or work_dir(spark)
    parts = []
    if "claude" in roots:
        parts.append(canonical.read_jsonl(spark, roots["claude"], tenant, since=since))
    if "codex" in roots:
        parts.append(codex.read(spark, roots["codex"], tenant, since, work))
    if "gemini" in roots:
        parts.append(gemini.read(spark, roots["gemini"], tenant, since))
    if "pi" in roots:
        parts.append(pi.read(spark, roots["pi"], tenant, since))
    if "opencode" in roots:
        parts.append(opencode.read_json(spark, roots["opencode"], tenant, since))
    jsonl = kv = None
    if "cursor" in roots:
        jsonl = materialize(cursor.read_jsonl(spark, roots["cursor"], tenant, since), f"{work}/cursor_jsonl")
    if "cursor_kv" in roots:
        kv = materialize(cursor.normalize_kv(spark.read.parquet(roots["cursor_kv"])), f"{work}/cursor_kv")
    if jsonl is not None and kv is not None:
        parts.append(cursor.prefer_store(jsonl, kv))
    elif jsonl is not None or kv is not None:
        parts.append(jsonl if jsonl is not None else kv)
    if "antigravity" in roots:
        parts.append(antigravity.normalize_steps(spark.read.parquet(roots["antigravity"])))
    if "antigravity-ide" in roots:
        parts.append(antigravity.read_export(spark, roots["antigravity-ide"], tenant, since))
    return union_events(*parts)
