"""Windows over variants: half-open ranges of variant_index, within one contig.

``variants`` has variant_index (0-based, sorted by contig and position), contig
and position. Windows have window_index, contig, start, stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def genomic_index(df: DataFrame, contig: str, position: str, name: str = "variant_index", bin_size: int = 1 << 20) -> DataFrame:
    """Number rows from 0 by (contig, position), without one global sort.

    Rows are ranked inside bins of a contig; the bins' offsets are a running sum
    over one row per bin. Rows with equal contig and position take any order.
    """
    b = F.floor(F.col(position) / bin_size)
    binned = df.withColumn("__bin", b)
    sizes = binned.groupBy(contig, "__bin").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.orderBy(contig, "__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__base", base).drop("__n")
    local = F.row_number().over(Window.partitionBy(contig, "__bin").orderBy(position)) - 1
    ranked = binned.withColumn("__local", local)
    return ranked.join(offsets, [contig, "__bin"]).withColumn(name, (F.col("__base") + F.col("__local")).cast("bigint")).drop("__bin", "__local", "__base")


def contig_bounds(variants: DataFrame) -> DataFrame:
    """contig, first, stop, last_position."""
    return variants.groupBy("contig").agg(F.min("variant_index").alias("first"), (F.max("variant_index") + 1).alias("stop"), F.max("position").alias("last_position"))


def _numbered(windows: DataFrame, order: str) -> DataFrame:
    """Number windows by contig and ``order``."""
    out = genomic_index(windows, "contig", order, "window_index", bin_size=1 << 16)
    return out.select("window_index", "contig", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


def window_by_variant(variants: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """Windows of ``size`` variants, each ``step``; the last of a contig may be short."""
    step = step or size
    c = contig_bounds(variants)
    w = c.select("contig", "stop", F.explode(F.sequence("first", F.col("stop") - 1, F.lit(step))).alias("start"))
    w = w.withColumn("stop", F.least(F.col("start") + size, "stop"))
    return _numbered(w, "start")


def window_by_position(variants: DataFrame, size: int, step: int | None = None, offset: int = 0) -> DataFrame:
    """Windows over positions [offset + k step, + size) up to the last position (exclusive
    of a start at last + offset); empty windows are kept."""
    step = step or size
    c = contig_bounds(variants).where(F.col("last_position").isNotNull())
    starts = c.select(
        "contig", "first",
        F.explode(F.filter(F.sequence(F.lit(offset), F.greatest(F.lit(offset), F.col("last_position") + offset - 1), F.lit(step)), lambda x: x < F.col("last_position") + offset)).alias("from"),
    )
    # Edges of all windows are merged with the positions of the contig; a running count is the number of smaller positions.
    edges = starts.select("contig", F.explode(F.array(F.col("from"), F.col("from") + size)).alias("at")).distinct()
    ranks = _smaller(variants, edges)
    lo = ranks.select("contig", F.col("at").alias("from"), F.col("n").alias("lo"))
    hi = ranks.select("contig", (F.col("at") - size).alias("from"), F.col("n").alias("hi"))
    w = starts.join(lo, ["contig", "from"]).join(hi, ["contig", "from"])
    w = w.select("contig", "from", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi")).alias("stop"))
    return _numbered(w, "from")


def _smaller(variants: DataFrame, edges: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """contig, at, n: how many positions of the contig are below ``at``.

    Counted inside position bins, with a running sum over bins.
    """
    both = variants.select("contig", F.col("position").alias("at"), F.lit(1).alias("is"), F.lit(1).alias("o")).unionByName(
        edges.select("contig", "at", F.lit(0).alias("is"), F.lit(0).alias("o"))
    ).withColumn("bin", F.floor(F.col("at") / bin_size))
    inner = F.coalesce(F.sum("is").over(Window.partitionBy("contig", "bin").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = both.withColumn("n", inner).where("is = 0")
    per = both.groupBy("contig", "bin").agg(F.sum("is").alias("k"))
    base = per.withColumn("b", F.coalesce(F.sum("k").over(Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    return local.join(base, ["contig", "bin"]).select("contig", "at", (F.col("n") + F.col("b")).alias("n"))


def window_by_locus(variants: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """One window per variant, over positions [position + offset, + size)."""
    first = contig_bounds(variants).select("contig", "first")
    edges = variants.select("contig", F.explode(F.array(F.col("position") + offset, F.col("position") + offset + size)).alias("at")).distinct()
    ranks = _smaller(variants, edges)
    lo = ranks.select("contig", (F.col("at") - offset).alias("position"), F.col("n").alias("lo"))
    hi = ranks.select("contig", (F.col("at") - offset - size).alias("position"), F.col("n").alias("hi"))
    w = variants.join(lo, ["contig", "position"]).join(hi, ["contig", "position"]).join(first, "contig")
    return w.select(F.col("variant_index").alias("window_index"), "contig", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi")).alias("stop"))


def window_by_interval(variants: DataFrame, intervals: DataFrame) -> DataFrame:
    """Windows of intervals (contig, from_position, to_position); empty ones are dropped."""
    first = contig_bounds(variants).select("contig", "first")
    edges = intervals.select("contig", F.explode(F.array("from_position", "to_position")).alias("at")).distinct()
    ranks = _smaller(variants, edges)
    lo = ranks.select("contig", F.col("at").alias("from_position"), F.col("n").alias("lo"))
    hi = ranks.select("contig", F.col("at").alias("to_position"), F.col("n").alias("hi"))
    w = intervals.join(first, "contig").join(lo, ["contig", "from_position"]).join(hi, ["contig", "to_position"]).where("hi > lo")
    order = "interval_index" if "interval_index" in intervals.columns else "from_position"
    return _numbered(w.select("contig", F.col(order).alias("__o"), (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi")).alias("stop")), "__o")


def window_by_genome(variants: DataFrame) -> DataFrame:
    """One window over all variants."""
    return variants.agg(F.count("*").alias("stop")).select(F.lit(0).cast("bigint").alias("window_index"), F.lit(0).cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


def assign(values: DataFrame, windows: DataFrame, bin_size: int = 1024) -> DataFrame:
    """Rows of ``values`` (variant_index, ...) with the window_index of each window they lie in.

    A range join as an equi-join on bins of the index: a window meets the bins it
    covers, a variant the one it lies in.
    """
    wide = windows.where("stop > start").select(
        "window_index", "start", "stop",
        F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size))).alias("__bin"),
    )
    held = values.withColumn("__bin", F.floor(F.col("variant_index") / bin_size))
    return held.join(wide, "__bin").where("variant_index >= start and variant_index < stop").drop("__bin", "start", "stop")


def window_statistic(values: DataFrame, windows: DataFrame, keys: list[str], aggs: dict, bin_size: int = 1024) -> DataFrame:
    """``aggs`` (name to aggregate column) per window and ``keys``; a window without variants has no row."""
    return assign(values, windows, bin_size).groupBy("window_index", *keys).agg(*[a.alias(n) for n, a in aggs.items()])


def moving_statistic(values: DataFrame, variants: DataFrame, size: int, aggs: dict, step: int | None = None) -> DataFrame:
    """``aggs`` over runs of ``size`` variants, each ``step``, that are full and inside a contig."""
    w = window_by_variant(variants, size, step)
    return window_statistic(values, w.where(F.col("stop") - F.col("start") == size), [], aggs)


def window_apply(values: DataFrame, windows: DataFrame, function, schema: str) -> DataFrame:  # noqa: ANN001
    """A function of a pandas frame on the rows of each window; ``schema`` describes its result."""
    return assign(values, windows).groupBy("window_index").applyInPandas(function, schema)
