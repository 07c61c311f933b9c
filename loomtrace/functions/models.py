"""Model names and tiers."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtrace import dims


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def pretty(model: Column) -> Column:
    """Display name of a raw model id (vendor prefix and date dropped, version joined)."""
    m = F.coalesce(model, F.lit(""))
    low = F.lower(m)
    bare = F.regexp_replace(F.regexp_replace(m, "^claude-", ""), r"-\d{6,}$", "")
    parts = F.filter(F.split(bare, "-"), lambda p: p != "")
    versions = F.filter(parts, lambda p: p.rlike(r"^\d"))
    words = F.filter(parts, lambda p: ~p.rlike(r"^\d"))
    head = F.get(words, F.lit(0))
    name = F.when(F.length(head) <= 3, F.upper(head)).otherwise(_cap(head))
    plain = F.forall(versions, lambda v: v.rlike(r"^\d+$"))
    version = F.when((F.size(versions) >= 2) & plain, F.array_join(F.slice(versions, 1, 2), ".")).otherwise(
        F.coalesce(F.get(versions, F.lit(0)), F.lit("")))
    extra = F.array_join(F.transform(F.slice(words, 2, F.size(words)), _cap), " ")
    joined = F.array_join(F.filter(F.array(name, version, extra), lambda t: t != ""), " ")
    return (
        F.when(low == "default", "Cursor Auto")
        .when(low.startswith("composer"), F.concat(
            F.lit("Cursor "), F.array_join(F.transform(F.split(low, "-"), _cap), " ")))
        .when(F.size(words) == 0, F.when(m == "", "?").otherwise(m))
        .otherwise(joined)
    )


def tier(provider: Column, model: Column) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    expr = F
    for prov, rules in dims.MODEL_TIERS.items():
        for needle, level in rules:
            expr = expr.when((provider == prov) & low.contains(needle), F.lit(level))
    return expr.otherwise(F.lit(None).cast("int"))
