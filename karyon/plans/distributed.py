"""Ranks and prefix sums that never put one key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_prefix(
    df: DataFrame, keys: Sequence[str], order: Column, value: Column, name: str, salts: int = 64
) -> DataFrame:
    """Exclusive running sum of ``value`` per key, as column ``name``.

    Rows of a key are spread over ``salts`` by a hash of ``order``; the sum runs
    over (salt, order), so each task sees about a ``salts``-th of a hot key.
    ``order`` must be unique within a key for a repeatable result. Null keys
    form a key of their own.
    """
    salt, val, total, base = "__salt", "__val", "__total", "__base"
    tagged = df.withColumn(salt, F.pmod(F.xxhash64(order), F.lit(salts)).cast("int")).withColumn(
        val, value.cast("long")
    )
    inner = Window.partitionBy(*keys, salt).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn(name, F.coalesce(F.sum(val).over(inner), F.lit(0)))
    outer = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        tagged.groupBy(*keys, salt)
        .agg(F.sum(val).alias(total))
        .withColumn(base, F.coalesce(F.sum(total).over(outer), F.lit(0)))
    )
    right = totals.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(salt).alias("__r_salt"), base)
    cond = F.col(salt) == F.col("__r_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    out = local.join(right, cond, "left")
    return out.withColumn(name, F.col(name) + F.col(base)).select(*df.columns, name)
