"""Shards by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are shuffled by a seeded hash and ranked; the fraction (rank + 1/2) / rows of the
source puts all sources on one line, on which every stretch holds each source in proportion. The
line is cut into stretches of equal row counts (at most one apart): those are the shards.

Ranks are never taken over a whole source or the whole line in one task. Hashes are uniform, so a
source is cut into equal stretches of them, ranked inside, and a prefix sum over the stretches' counts
gives the start of each; the exchange is by source and stretch. The line is cut into ranges by fraction,
source and rank together: many sources of one row all have the fraction 1/2 and are still spread.
Equal hashes are ordered by all columns used.

Defined results: NULL texts count as empty; NULL sources are one source; NULL doc_ids are rows like
others; equal rows are interchangeable; no rows give no shards. Columns of docs named `shard` or `slot`
give way to those of the operator.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import base

SHARDS = 24
SEED = 42
PER_RANGE = 20_000
BROADCAST_RANGES = 100_000  # starts of so many ranges are a few MB; beyond that they are joined by a shuffle


def _uniform(digest: Column) -> Column:
    """The first 13 hex digits as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def _starts(counts: DataFrame, group: list[str], at: str) -> DataFrame:
    """group, `at`, `before` (rows in earlier stretches of the group), `of` (rows of the group)."""
    whole = Window.partitionBy(*group)
    sums = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, at, F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("before"), F.sum("count").over(whole).alias("of"))


def _keyed(df: DataFrame, seed: int) -> DataFrame:
    """What the order needs: source (never NULL) and the seeded hash of a row."""
    return df.withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn(
        "h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def _placed(rows: DataFrame, shards: int, per_range: int, ties: list[str], work: str) -> DataFrame:
    """rows (source, h, ...; a written table) with shard and slot."""
    total = rows.count()
    per_range = min(per_range, max(200, total // (4 * base.partitions(rows.sparkSession))))
    ranges = max(1, -(-total // per_range))
    # stretches of hashes: none holds more than per_range rows on average, whatever share of the table its source has
    rows = rows.withColumn("u", _uniform(F.col("h"))).withColumn("stretch", F.floor(F.col("u") * ranges))
    starts = _starts(rows.groupBy("source", "stretch").count(), ["source"], "stretch")
    inside = Window.partitionBy("source", "stretch").orderBy("u", "h", *ties)
    rows = rows.repartition("source", "stretch").withColumn("nth", F.row_number().over(inside) - 1).join(starts.hint("merge"), ["source", "stretch"])
    rows = rows.withColumn("rank", F.col("before") + F.col("nth")).withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("of") * 2)).drop("u", "h", "stretch", "nth", "before", "of")
    # the number of a row in its range is the lower part of the id that Spark gives it
    order = ["fraction", "source", "rank"]
    line = base.materialize(rows, f"{work}/line").repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    line = base.materialize(line.withColumn("range", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1)), f"{work}/ranges")
    starts = _starts(line.groupBy("range").count(), [], "range").drop("of")
    place = F.col("before") + F.col("nth")
    line = line.join(F.broadcast(starts) if ranges <= BROADCAST_RANGES else starts.hint("merge"), "range").withColumn("place", place)
    shard = F.expr(f"cast(place * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(cast(place * {shards} div {max(total, 1)} as bigint) * {total} + {shards - 1}) div {shards}")
    return line.withColumn("shard", shard).withColumn("slot", F.col("place") - first).drop("range", "at", "nth", "before", "place", *order)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, per_range: int = PER_RANGE) -> DataFrame:
    """docs (doc_id, source, ...) with all columns and shard, slot. Rows are written once; only numbers are ordered."""
    work = base.new_work(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    held = base.materialize(docs.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("at_row")), f"{work}/docs")
    rows = _keyed(held.select(F.col("at_row").alias("key"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source")), seed)
    placed = _placed(base.materialize(rows, f"{work}/rows"), shards, per_range, ["doc_id", "key"], work)
    return held.join(placed.select(F.col("key").alias("at_row"), "shard", "slot").hint("merge"), "at_row").select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, per_range: int = PER_RANGE) -> None:
    """Parquet below folder/shard=N, each file a stretch of slots in order; an earlier result in the folder is replaced."""
    placed = interleave(docs, shards, seed, per_range)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, per_range: int = PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source of every row of docs (doc_id, text, source)."""
    work = base.new_work(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")), seed)
    rows = base.materialize(rows.withColumn("name", F.when(F.col("source") != "", F.expr("substr(source, 2)"))), f"{work}/rows")  # texts are read once; what follows needs numbers only
    placed = _placed(rows, shards, per_range, ["doc_id", "text_crc32", "size"], work)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("name").alias("source"))


#: assign() in SQL; the table of the checksum is built from its polynomial.
SQL = f"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
a AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS text_crc32 FROM documents, bits),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY s) AS n FROM a),
p AS (SELECT *, row_number() OVER (ORDER BY (rank * 2 + 1)::DOUBLE / (n * 2)::DOUBLE, s, rank) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INTEGER AS shard, place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard, source FROM p
"""
