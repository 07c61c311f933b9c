"""File access shared by the readers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def modified_since(df: DataFrame, since: str | None, mtime: str = "mtime") -> DataFrame:
    """Drop files last written before the window: they cannot hold events inside it."""
    return df if since is None else df.filter(F.col(mtime) >= F.lit(since).cast("timestamp"))


def lines(spark: SparkSession, paths: str | list[str], since: str | None = None) -> DataFrame:
    """Non-blank lines with file_path, mtime and an ordinal that follows the file's order.

    Files stay splittable and nothing is shuffled: the ordinal is the offset of the split plus the
    running row of the partition. A line takes a byte at least, so the rows of a split end before the
    offset of the next one; a full split is always alone in its partition, and only the last,
    shorter one of a file shares it. So ordinals rise strictly, whatever the size of a file.
    That needs Spark's usual packing: spark.sql.files.maxPartitionNum, which puts full splits together, must be unset.
    """
    if spark.conf.get("spark.sql.files.maxPartitionNum", None):
        raise ValueError("unset spark.sql.files.maxPartitionNum: line order needs one full split per partition")
    raw = spark.read.text(paths if isinstance(paths, list) else [paths]).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_block_start").alias("__start"))
    raw = modified_since(raw, since)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordinal = F.col("__start") + row + F.when(F.col("__start") > 0, 1).otherwise(0)
    return (raw.withColumn("ordinal", ordinal).filter(F.trim("value") != "")
            .select("file_path", "mtime", "ordinal", "value"))


def documents(spark: SparkSession, paths: str | list[str], since: str | None = None) -> DataFrame:
    """One row per file for formats that are a single JSON document."""
    raw = spark.read.text(paths if isinstance(paths, list) else [paths], wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("mtime"))
    return modified_since(raw, since)


def files_by_month(df: DataFrame) -> DataFrame:
    """Cheap month estimate: transcripts per month of their last write."""
    f = df.select("file_path", "mtime").distinct()
    return f.groupBy(F.date_format("mtime", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("transcripts"))


def base_id(path: Column) -> Column:
    """File name up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def chunk(ordinal: str = "ordinal") -> Column:
    """At most 65 536 lines of one file."""
    return F.shiftright(F.col(ordinal), 16)

# ---- JSON access -------------------------------------------------------------------
def get(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def kind(v: Column, path: str = "$") -> Column:
    """Type name of a JSON value: STRING, BOOLEAN, OBJECT<…>, ARRAY<…>, VOID or NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def object_of(value: Column) -> Column:
    """The JSON object a text holds, as an array of one; no element for any other text.

    Meant for `explode`: a filter on the parsed value would be pushed below it and parse the text once more.
    """
    return F.filter(F.array(F.try_parse_json(value)), lambda v: is_object(v, "$"))


def truthy(v: Column, path: str) -> Column:
    s = get(v, path)
    return F.coalesce(~s.isin("", "false", "0", "0.0", "{}", "[]"), F.lit(False))


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_of(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[non_empty(c) for c in cols])


def count_int(c: Column) -> Column:
    """Counter held as JSON text; anything unreadable counts 0."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def is_object(v: Column, path: str) -> Column:
    # only an object casts to a map; its schema is not needed
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def object_json(v: Column, path: str) -> Column:
    """JSON text of an object, '{}' for anything else."""
    return F.when(is_object(v, path), get(v, path)).otherwise(F.lit("{}"))


def joined_texts(v: Column, path: str) -> Column:
    """Text of a string or of a list of text parts, parts on separate lines."""
    parts = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda b: F.when(
        kind(b) == "STRING", F.try_variant_get(b, "$", "string")).otherwise(
        first_of(get(b, "$.text"), get(b, "$.input_text"), get(b, "$.output_text"))))
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")
    return F.when(kind(v, path) == "STRING", get(v, path)).otherwise(F.coalesce(joined, F.lit("")))


def iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def millis(c: Column) -> Column:
    """Epoch milliseconds (number or text) to a timestamp."""
    return F.timestamp_micros((c.try_cast("double") * 1000).cast("bigint"))
