"""Aggregation operators.  Partial aggregation happens before every shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtrace import dims


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def grouping_counts(df: DataFrame, owner: str, source: str, month: str,
                    measures: dict[str, Column]) -> DataFrame:
    """Additive measures at four grains in one pass: owner, +source, +month, +both."""
    base = df.groupBy(owner, source, month).agg(*[c.alias(n) for n, c in measures.items()])
    return (base.groupingSets([[owner], [owner, source], [owner, month], [owner, source, month]],
                              owner, source, month)
            .agg(*[F.sum(n).alias(n) for n in measures],
                 F.grouping(source).cast("int").alias("all_sources"),
                 F.grouping(month).cast("int").alias("all_months")))


def entropy(df: DataFrame, owner: list[str], name: str) -> DataFrame:
    """Distinct names and normalised entropy of their use (0 when there is one name)."""
    n = df.groupBy(*owner, name).agg(F.count(F.lit(1)).alias("n"))
    return entropy_of_counts(n, owner, "n")


def entropy_of_counts(counts: DataFrame, owner: list[str], n: str) -> DataFrame:
    # H = log2 N - sum(n log2 n) / N, so one aggregation suffices
    agg = counts.groupBy(*owner).agg(
        F.count(F.lit(1)).alias("names"), F.sum(n).alias("total"),
        F.sum(F.col(n) * F.log2(F.col(n).cast("double"))).alias("nlogn"))
    h = F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")
    return agg.select(*owner, "names", "total", F.when(
        F.col("names") > 1, h / F.log2(F.col("names").cast("double"))).otherwise(0.0).alias("entropy"))


def depth_histogram_stats(hist: DataFrame, owner: list[str], value: str, n: str,
                          heavy: int = dims.HEAVY_EDIT_RUN) -> DataFrame:
    """mean, median, nearest-rank p90, max and heavy count from a (value, count) histogram.

    The histogram has one row per distinct value, so the ranking window stays small even
    when one owner holds most of the rows.
    """
    w = Window.partitionBy(*owner).orderBy(value)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = (hist.withColumn("__cum", F.sum(n).over(upto)).withColumn("__tot", F.sum(n).over(whole)))

    def at(rank: Column) -> Column:          # value at a zero-based rank
        return F.min(F.when(F.col("__cum") > rank, F.col(value)))

    tot = F.col("__tot")
    p90 = F.bround(F.lit(0.9) * (tot - 1), 0).cast("bigint")
    return h.groupBy(*owner).agg(
        F.sum(n).cast("bigint").alias("runs"),
        (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"),
        ((at(F.floor((tot - 1) / 2)) + at(F.floor(tot / 2))) / 2.0).alias("median"),
        at(p90).cast("bigint").alias("p90"),
        F.max(value).cast("bigint").alias("max"),
        F.coalesce(F.sum(F.when(F.col(value) > heavy, F.col(n))), F.lit(0)).cast("bigint").alias("heavy"))


def depth_stats(df: DataFrame, owner: list[str], value: str, heavy: int = dims.HEAVY_EDIT_RUN) -> DataFrame:
    hist = df.groupBy(*owner, value).agg(F.count(F.lit(1)).alias("__n"))
    return depth_histogram_stats(hist, owner, value, "__n", heavy)


def fanout_stats(df: DataFrame, owner: list[str], session: list[str], dispatches: Column | None = None) -> DataFrame:
    """Dispatches per session above zero: median, max, sessions, share with at least two."""
    per = df.groupBy(*owner, *session).agg(
        F.count(F.lit(1)).alias("n") if dispatches is None else F.sum(dispatches).alias("n"))
    hist = per.filter("n > 0").groupBy(*owner, "n").agg(F.count(F.lit(1)).alias("c"))
    s = depth_histogram_stats(hist, owner, "n", "c")
    two = hist.groupBy(*owner).agg(
        (F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("c"))), F.lit(0)) / F.sum("c")).alias("share"))
    return s.join(two, owner).select(
        *owner, F.col("median").alias("fanout_median"), F.col("max").alias("max_session_fanout"),
        F.col("runs").alias("delegating_sessions"), F.bround("share", 3).alias("parallel_session_share"))


def top_k(df: DataFrame, owner: list[str], name: str, k: int, first_seen: Column,
          weight: Column | None = None) -> DataFrame:
    """The k most frequent names per owner, ties in order of first appearance."""
    n = df.groupBy(*owner, name).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"), F.min(first_seen).alias("__first"))
    return rank_counts(n, owner, k, "n", ["__first", name]).drop("__first")


def rank_counts(counts: DataFrame, owner: list[str], k: int, n: str, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*owner).orderBy(F.desc(n), *[F.asc(t) for t in ties])
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def share_of_total(df: DataFrame, owner: list[str], name: str, measures: dict[str, Column]) -> DataFrame:
    """Measures per name and their share of the owner's total, rounded to 3 places."""
    agg = df.groupBy(*owner, name).agg(*[c.alias(m) for m, c in measures.items()]).withColumn("__all", F.lit(0))
    total = agg.groupBy(*owner, "__all").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    return agg.join(total, owner + ["__all"]).select(*owner, name, *measures, *[
        F.when(F.col(f"__t_{m}") != 0, F.bround(F.col(m) / F.col(f"__t_{m}"), 3)).otherwise(0.0).alias(f"{m}_pct")
        for m in measures])


def mix(df: DataFrame, owner: list[str], name: str) -> DataFrame:
    """Distinct names and the share of rows not on the most used one."""
    n = df.filter(F.col(name).isNotNull()).groupBy(*owner, name).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*owner).agg(
        F.count(F.lit(1)).alias("names"), F.sum("n").alias("total"),
        (1 - F.max("n") / F.sum("n")).alias("offload"))


def per_message_totals(df: DataFrame, owner: list[str], message: str, repeated: list[str],
                       per_line: list[str]) -> DataFrame:
    """Totals counted per line and per message when a message spans several lines.

    `repeated` columns carry the same value on every line of a message (take one per
    message); `per_line` columns are increments (sum either way).
    """
    one = df.groupBy(*owner, message).agg(
        F.count(F.lit(1)).alias("__lines"),
        *[F.sum(c).alias(f"{c}_line") for c in repeated + per_line],
        *[F.max(c).alias(f"{c}_once") for c in repeated])
    return one.groupBy(*owner).agg(
        F.count(F.lit(1)).alias("messages"), count_if(F.col("__lines") >= 2).alias("spanning"),
        *[F.sum(f"{c}_line").alias(f"{c}_per_line") for c in repeated + per_line],
        *[F.sum(f"{c}_once").alias(f"{c}_per_message") for c in repeated],
        *[F.sum(f"{c}_line").alias(f"{c}_per_message") for c in per_line])


def month_coverage(transcripts: DataFrame, index: DataFrame, owner: list[str], month: str,
                   session: str) -> DataFrame:
    """Sessions per month seen in transcripts against those in an index, with a flag.

    Both sides are reduced to one row per (month, session) in a single aggregation, so the
    overlap needs no join and a month of any size is spread over its sessions.
    """
    keys = owner + [month, session]
    both = (transcripts.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("i"))
            .unionByName(index.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("i")))
            .filter(F.col(month).isNotNull() & F.col(session).isNotNull())
            .groupBy(*keys).agg(F.max("t").alias("t"), F.max("i").alias("i")))
    g = both.groupBy(*owner, month).agg(
        F.sum("t").cast("bigint").alias("available"), F.sum("i").cast("bigint").alias("indexed"),
        F.sum(F.col("t") * F.col("i")).cast("bigint").alias("overlap"))
    return g.select(
        *owner, month, coverage_flag(F.col("indexed"), F.col("available")).alias("flag"),
        F.when(F.col("indexed") > 0, F.col("indexed")).alias("indexed"), "available",
        F.when(F.col("indexed") > 0, F.bround(F.col("available") / F.col("indexed"), 3)).alias("coverage"),
        (F.col("available") - F.when(F.col("indexed") > 0, F.col("overlap")).otherwise(0)).alias("transcript_only"))


def coverage_flag(indexed: Column, transcripts: Column) -> Column:
    """unknown / insufficient / partial / complete from plain counts."""
    return (F.when(indexed.isNull() | (indexed <= 0), "unknown")
            .when(transcripts <= 0, "insufficient")
            .when(transcripts < indexed, "partial").otherwise("complete"))


def busiest(df: DataFrame, owner: list[str], bucket: Column, first_seen: Column, k: int = 3) -> DataFrame:
    """The k busiest buckets (hours, weekdays) per owner."""
    n = df.withColumn("bucket", bucket).filter("bucket is not null")
    return top_k(n, owner, "bucket", k, first_seen)


def weekday(ts: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(ts)


def admitted_sources(df: DataFrame, owner: list[str], source: str, session: str, minimum: int) -> DataFrame:
    """Sources with at least `minimum` distinct sessions."""
    per = df.filter(F.col(session).isNotNull()).select(*owner, source, session).distinct()
    return per.groupBy(*owner, source).agg(F.count(F.lit(1)).alias("sessions")).filter(F.col("sessions") >= minimum)


def span_dedup(discrete: DataFrame, attributed: DataFrame, owner: list[str], span: list[str],
               name: str, order: Column, carry: list[str]) -> DataFrame:
    """Discrete sites count each; an attributed span counts once and only if unclaimed.

    Returns one row per credited use, with the `carry` columns of the first attribution.
    """
    keys = owner + span + [name]
    claimed = discrete.select(*keys).distinct()
    first = (attributed.groupBy(*keys)
             .agg(F.min_by(F.struct(*carry), order).alias("__c"))
             .join(claimed, keys, "left_anti")
             .select(*keys, *[F.col(f"__c.{c}").alias(c) for c in carry]))
    return discrete.select(*keys, *carry).unionByName(first)


def dedup_rank(df: DataFrame, owner: list[str], text: str, score: str, order: Column,
               n: int = 6, floor: float = 0.5) -> DataFrame:
    """Best score per lower-cased text, then the first n within reach of the best one."""
    best = (df.groupBy(*owner, F.lower(text).alias("__k"))
            .agg(F.max_by(F.struct(F.col(text).alias("t"), F.col(score).alias("s")),
                          F.struct(F.col(score), (-order).alias("o"))).alias("b"))
            .select(*owner, F.col("b.t").alias(text), F.col("b.s").alias(score)))
    w = Window.partitionBy(*owner).orderBy(F.desc(score), F.asc(text))
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    lead = F.max(score).over(Window.partitionBy(*owner))
    return top.withColumn("__top", lead).filter(F.col(score) >= F.col("__top") * floor).drop("__top")


def goto_phrase(df: DataFrame, owner: list[str], phrase: str, text: str, session: str, order: Column,
                among: int = 25, uses: int = 3, sessions: int = 2) -> DataFrame:
    """The most repeated phrase with enough uses in enough sessions, among the top ones."""
    per = df.groupBy(*owner, phrase, session).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order.alias("o"), F.col(text).alias("t"))).alias("f"))
    agg = per.groupBy(*owner, phrase).agg(
        F.sum("n").alias("uses"), F.count(F.lit(1)).alias("sessions"), F.min("f").alias("f"))
    agg = agg.select(*owner, phrase, "uses", "sessions", F.col("f.t").alias(text), F.col("f.o").alias("__first"))
    ranked = rank_counts(agg, owner, among, "uses", ["__first"])
    ok = ranked.filter((F.col("uses") >= uses) & (F.col("sessions") >= sessions))
    w = Window.partitionBy(*owner).orderBy("rank")
    return ok.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__first", "rank")


def weighted_mean(weight: Column, value: Column) -> Column:
    """Aggregate: sum(w v) / sum(w) over non-null values, plain mean when weights sum to 0."""
    w = F.when(value.isNotNull(), weight.cast("double"))
    sw = F.sum(w)
    return F.when(sw != 0, F.sum(w * value) / sw).otherwise(F.avg(value))
