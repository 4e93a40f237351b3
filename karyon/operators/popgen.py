"""Diversity and differentiation.

``counts`` has variant_index, cohort, cohort_allele_count. Results are keyed by
``unit``: the variant_index, or the window_index where windows are given.
Undefined values are null and make the sum over a window null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyon.functions.calls import cohort_sum
from karyon.operators.windows import assign


def _total(c: str) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")


def _by_unit(values: DataFrame, keys: list[str], windows: DataFrame | None, value: str = "value") -> DataFrame:
    if windows is None:
        return values.select(F.col("variant_index").alias("unit"), *keys, value)
    return assign(values, windows).groupBy(F.col("window_index").alias("unit"), *keys).agg(cohort_sum(F.col(value)).alias(value))


def _pi(counts: DataFrame) -> DataFrame:
    n = _total("cohort_allele_count")
    pairs = n * (n - 1) / 2
    same = F.aggregate("cohort_allele_count", F.lit(0.0), lambda a, x: a + x.cast("double") * (x - 1) / 2)
    return counts.withColumn("value", F.try_divide(pairs - same, pairs))


def diversity(counts: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """unit, cohort, value: mean differences between two alleles of the cohort."""
    return _by_unit(_pi(counts), ["cohort"], windows)


def divergence(counts: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """unit, cohort_0, cohort_1, value: both orders of each pair; the diagonal is the diversity."""
    a = counts.select("variant_index", F.col("cohort").alias("cohort_0"), F.col("cohort_allele_count").alias("a"))
    b = counts.select("variant_index", F.col("cohort").alias("cohort_1"), F.col("cohort_allele_count").alias("b"))
    met = a.join(b, "variant_index").where("cohort_0 < cohort_1")
    shared = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    off = met.withColumn("value", 1 - F.try_divide(shared, _total("a") * _total("b"))).select("variant_index", "cohort_0", "cohort_1", "value")
    diagonal = _pi(counts).select("variant_index", F.col("cohort").alias("cohort_0"), F.col("cohort").alias("cohort_1"), "value")
    upper = _by_unit(off.unionByName(diagonal), ["cohort_0", "cohort_1"], windows)
    mirrored = upper.where("cohort_0 < cohort_1").select("unit", F.col("cohort_1").alias("cohort_0"), F.col("cohort_0").alias("cohort_1"), "value")
    return upper.unionByName(mirrored)


def Fst(counts: DataFrame, windows: DataFrame | None = None, estimator: str = "Hudson") -> DataFrame:  # noqa: N802
    """unit, cohort_0 < cohort_1, value; over a window, a ratio of sums."""
    if estimator not in ("Hudson", "Nei"):
        raise ValueError(f"unknown estimator {estimator}")
    d = divergence(counts, windows).where("cohort_0 <= cohort_1")
    own = d.where("cohort_0 = cohort_1")
    off = d.where("cohort_0 < cohort_1").withColumnRenamed("value", "dxy")
    i = own.select("unit", "cohort_0", F.col("value").alias("dii"))
    j = own.select("unit", F.col("cohort_0").alias("cohort_1"), F.col("value").alias("djj"))
    met = off.join(i, ["unit", "cohort_0"], "left").join(j, ["unit", "cohort_1"], "left")
    both = F.col("dii") + F.col("djj")
    value = 1 - F.try_divide(both / 2, F.col("dxy")) if estimator == "Hudson" else 1 - F.try_divide(2 * both, both + 2 * F.col("dxy"))
    return met.select("unit", "cohort_0", "cohort_1", value.alias("value"))


def Tajimas_D(counts: DataFrame, variant_counts: DataFrame, windows: DataFrame | None = None) -> DataFrame:  # noqa: N802
    """unit, cohort, value. Segregating sites and the sample size are those of all samples.

    Null where the denominator is 0 or undefined.
    """
    seg = variant_counts.select("variant_index", (F.size(F.filter("variant_allele_count", lambda x: x > 0)) - 1).cast("double").alias("value"))
    sites = _by_unit(seg, [], windows).withColumnRenamed("value", "s")
    n = variant_counts.agg(F.max(_total("variant_allele_count"))).first()[0] or 0.0
    n = int(n)
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    pi = diversity(counts, windows).withColumnRenamed("value", "pi")
    if n < 2 or not a1:
        return pi.select("unit", "cohort", F.lit(None).cast("double").alias("value"))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / a1**2
    e1, e2 = c1 / a1, c2 / (a1**2 + a2)
    s = F.col("s")
    var = e1 * s + e2 * s * (s - 1)
    value = F.try_divide(F.col("pi") - s / a1, F.sqrt(F.when(var > 0, var)))
    return pi.join(sites, "unit").select("unit", "cohort", value.alias("value"))


def pbs(fst: DataFrame, triples: list[tuple[int, int, int]] | None = None, epsneg: float = 2.0**-53) -> DataFrame:
    """unit, cohort_0 < cohort_1 < cohort_2, value: population branch statistic of the first."""
    t = fst.select("unit", F.col("cohort_0").alias("i"), F.col("cohort_1").alias("j"), (-F.log(1 - F.least(F.greatest("value", F.lit(0.0)), F.lit(1 - epsneg)))).alias("t"))
    ij = t.select("unit", F.col("i").alias("cohort_0"), F.col("j").alias("cohort_1"), F.col("t").alias("tij"))
    ik = t.select("unit", F.col("i").alias("cohort_0"), F.col("j").alias("cohort_2"), F.col("t").alias("tik"))
    jk = t.select("unit", F.col("i").alias("cohort_1"), F.col("j").alias("cohort_2"), F.col("t").alias("tjk"))
    met = ij.join(ik, ["unit", "cohort_0"]).where("cohort_1 < cohort_2").join(jk, ["unit", "cohort_1", "cohort_2"])
    if triples is not None:
        want = met.sparkSession.createDataFrame([tuple(sorted(x)) for x in triples], "cohort_0 int, cohort_1 int, cohort_2 int")
        met = met.join(F.broadcast(want), ["cohort_0", "cohort_1", "cohort_2"])
    up = (F.col("tij") + F.col("tik") - F.col("tjk")) / 2
    down = 1 + (F.col("tij") + F.col("tik") + F.col("tjk")) / 2
    return met.select("unit", "cohort_0", "cohort_1", "cohort_2", (up / down).alias("value"))


def Garud_H(calls: DataFrame, samples: DataFrame, windows: DataFrame, gt: str = "call_genotype") -> DataFrame:  # noqa: N802
    """unit, cohort, h1, h12, h123, h2_h1 of diploid haplotypes in windows.

    A haplotype is the exact string of its alleles in the window with their
    variants, missing ones being symbols of their own; a sample without a row in
    the window has none.
    """
    held = samples.where("sample_cohort >= 0").select("sample_index", F.col("sample_cohort").alias("cohort"))
    slots = calls.select("variant_index", "sample_index", F.posexplode(gt).alias("slot", "allele"))
    placed = assign(slots, windows).join(held, "sample_index")
    # A window holds few variants, so a haplotype is a bounded string.
    hap = placed.groupBy("window_index", "cohort", "sample_index", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant_index", "allele"))), lambda x: F.concat(x["variant_index"].cast("string"), F.lit(":"), x["allele"].cast("string"))), ",").alias("hap"))
    n = hap.groupBy("window_index", "cohort", "hap").agg(F.count("*").alias("n"))
    w = Window.partitionBy("window_index", "cohort")
    ranked = n.withColumn("f", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "hap")))
    f, r = F.col("f"), F.col("r")
    some = lambda k: F.sum(F.when(r <= k, f).otherwise(0.0))
    rest = lambda k: F.sum(F.when(r > k, f * f).otherwise(0.0))
    g = ranked.groupBy(F.col("window_index").alias("unit"), "cohort").agg(
        F.sum(f * f).alias("h1"),
        (some(2) * some(2) + rest(2)).alias("h12"),
        (some(3) * some(3) + rest(3)).alias("h123"),
        F.max(F.when(r == 1, f)).alias("f1"),
    )
    return g.select("unit", "cohort", "h1", "h12", "h123", ((F.col("h1") - F.col("f1") * F.col("f1")) / F.col("h1")).alias("h2_h1"))
