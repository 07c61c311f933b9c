"""Scalar scoring expressions: saturation, rates with evidence, weighted means, rounding."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp01(c: Column) -> Column:
    """Bring into [0, 1]; NULL stays NULL (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def sat(x: Column, target: float) -> Column:
    """min(1, x / target); a zero target scores 0.  NULL stays NULL."""
    if not target:
        return F.lit(0.0)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), x.cast("double") / F.lit(float(target))))


def has_evidence(calls: Column, target: float, floor: float = 1.0) -> Column:
    return calls.cast("double") * F.lit(float(target)) > F.lit(float(floor))


def rate(x: Column, calls: Column, target: float, floor: float = 1.0) -> Column:
    """Per-call rate against a target.

    NULL when the denominator is absent or too small for one occurrence to be evidence,
    0 when the denominator is a measured zero.
    """
    return (
        F.when(calls.isNull(), F.lit(None).cast("double"))
        .when(calls <= 0, F.lit(0.0))
        .when(~has_evidence(calls, target, floor), F.lit(None).cast("double"))
        .otherwise(sat(F.try_divide(x.cast("double"), calls.cast("double")), target))
    )


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: it is bound as a lambda variable.

    Repeating a large expression multiplies the plan; a bound variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _terms(terms: list[tuple[float | Column, Column, Column | None]]) -> Column:
    """Live terms as an array of (w, v)."""
    rows = []
    for w, v, cap in terms:
        wc = w if isinstance(w, Column) else F.lit(float(w))
        rows.append(F.struct(wc.cast("double").alias("w"), (v if cap is None else F.when(cap, v)).cast("double").alias("v")))
    return F.filter(F.array(*rows), lambda t: t["v"].isNotNull())


def wsum(terms: list[tuple[float | Column, Column, Column | None]]) -> Column:
    """Weighted mean over live terms, NULL when no term is live.

    A term is (weight, value, capability column or None); NULL values and missing
    capabilities drop out and the remaining weights are renormalised.
    """
    def mean(live: Column) -> Column:
        s = F.aggregate(live, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), lambda a, t: F.struct(
            (a["n"] + t["w"] * t["v"]).alias("n"), (a["d"] + t["w"]).alias("d")))
        return let(s, lambda x: F.when(x["d"] > 0, x["n"] / x["d"]))
    return let(_terms(terms), mean)


def wsum_disclosure(terms: list[tuple[float, Column, Column | None]]) -> Column:
    """{scored, total, weight_scored} when a term was dropped, else NULL."""
    configured = float(sum(w for w, _, _ in terms))
    return let(_terms(terms), lambda live: F.when(F.size(live) < len(terms), F.struct(
        F.size(live).alias("scored"), F.lit(len(terms)).alias("total"),
        F.bround(F.aggregate(live, F.lit(0.0), lambda a, t: a + t["w"]) / F.lit(configured), 4).alias("weight_scored"))))


def ratio(n: Column, d: Column, empty: float | None = 0.0) -> Column:
    """n / d with an explicit value for an empty denominator."""
    other = F.lit(None).cast("double") if empty is None else F.lit(float(empty))
    return F.when(d.isNull() | (d == 0), other).otherwise(n.cast("double") / d.cast("double"))


def tier(total: Column, bands: list[tuple[int, str]], lowest: str = "Novice") -> Column:
    expr = F.lit(lowest)
    for bound, name in reversed(bands):
        expr = F.when(total >= bound, name).otherwise(expr)
    return expr


def count_value(raw: Column) -> Column:
    """A telemetry count held as JSON text: non-negative integral numbers only.

    Booleans, fractions, negatives, strings and non-finite values are malformed -> NULL.
    """
    as_double = raw.try_cast("double")
    well_formed = raw.rlike(r"^-?\d+(\.0+)?([eE]\+?\d+)?$")
    return F.when(well_formed & (as_double >= 0), as_double.cast("bigint"))
