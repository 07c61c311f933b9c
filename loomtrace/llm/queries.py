"""One query per corpus operator: the operator on its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import base, best_fit_packing, bpe, learned_partitions, line_dedup, minhash, pii_spans, prefix_trie, quality_rules, sharding, substring_dedup, token_files, turn_repair, url_filter


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(base.documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(base.table(spark, sf_dir, "pages"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(base.table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(base.documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(base.documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(base.documents(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.label(base.documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(base.documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(base.documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(base.documents(spark, sf_dir))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(base.table(spark, sf_dir, "conversations"))


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.digest(base.documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(base.table(spark, sf_dir, "conversations"))


_ALL = (op1_substring_dedup, op2_url_filter, op3_learned_partitions, op4_line_dedup, op5_quality_rules, op6_token_files, op7_minhash, op8_best_fit_packing, op9_sharding, op10_bpe, op11_turn_repair, op12_pii_spans, op13_prefix_trie)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op1_substring_dedup": substring_dedup.SQL, "op2_url_filter": url_filter.SQL, "op5_quality_rules": quality_rules.SQL, "op7_minhash": minhash.SQL, "op9_sharding": sharding.SQL, "op11_turn_repair": turn_repair.SQL, "op13_prefix_trie": prefix_trie.SQL}
