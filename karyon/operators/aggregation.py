"""Counts and summaries of calls by variant, sample, cohort.

``calls`` has variant_index, sample_index, call_genotype; each aggregate runs in
one shuffle of partial sums on its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyon.functions import calls as C


def count_call_alleles(calls: DataFrame, n_alleles: int, gt: str = "call_genotype", ploidy: int | None = None) -> DataFrame:
    return calls.withColumn("call_allele_count", C.allele_counts(gt, n_alleles, ploidy))


def _sums(n_alleles: int, gt: str | None, counts: str | None, ploidy: int | None = None) -> list[Column]:
    one = (lambda a: C.allele_count(gt, a, ploidy)) if gt else (lambda a: F.get(counts, F.lit(a)))
    return [F.sum(one(a)).cast("bigint") for a in range(n_alleles)]


def count_variant_alleles(calls: DataFrame, n_alleles: int, using: str = "call_genotype", ploidy: int | None = None) -> DataFrame:
    """variant_index, variant_allele_count. Partial calls count too."""
    if using not in ("call_genotype", "call_allele_count"):
        raise ValueError(f"alleles can't be counted using {using}")
    sums = _sums(n_alleles, using if using == "call_genotype" else None, using, ploidy)
    return calls.groupBy("variant_index").agg(F.array(*sums).alias("variant_allele_count"))


def with_cohort(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls with the cohort of their sample; those of cohort -1 or null are left out.

    The join is left to the optimizer, which broadcasts the samples while they
    are below its threshold and else shuffles.
    """
    return calls.join(samples.where("sample_cohort >= 0").select("sample_index", F.col("sample_cohort").alias("cohort")), "sample_index")


def count_cohort_alleles(calls: DataFrame, samples: DataFrame, n_alleles: int, gt: str = "call_genotype", variants: DataFrame | None = None, ploidy: int | None = None) -> DataFrame:
    """variant_index, cohort, cohort_allele_count; with ``variants``, zeros for
    every variant and every cohort up to the largest."""
    got = with_cohort(calls, samples).groupBy("variant_index", "cohort").agg(F.array(*_sums(n_alleles, gt, None, ploidy)).alias("cohort_allele_count"))
    if variants is None:
        return got
    top = samples.agg(F.max("sample_cohort")).first()[0]
    if top is None or top < 0:
        return got
    grid = variants.select("variant_index", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("cohort"))
    zero = F.array(*[F.lit(0).cast("bigint")] * n_alleles)
    return grid.join(got, ["variant_index", "cohort"], "left").withColumn("cohort_allele_count", F.coalesce("cohort_allele_count", zero))


def cohort_allele_frequencies(cohort_counts: DataFrame) -> DataFrame:
    return cohort_counts.withColumn("cohort_allele_frequency", C.frequencies("cohort_allele_count"))


def count_variant_genotypes(calls: DataFrame, n_alleles: int, ploidy: int, gt: str = "call_genotype") -> DataFrame:
    """variant_index, variant_genotype_count: calls of each genotype in G order."""
    labels = C.genotype_labels(n_alleles, ploidy)
    indexed = calls.select("variant_index", C.genotype_index(gt, n_alleles, ploidy).alias("g"))
    return indexed.groupBy("variant_index").agg(F.array(*[F.count_if(F.col("g") == i) for i in range(len(labels))]).alias("variant_genotype_count"))


def _call_stats(gt: str, total: Column, ploidy: int | None) -> list[Column]:
    called, ref, alt = F.count_if(C.is_called(gt, ploidy)), F.count_if(C.is_hom_ref(gt, ploidy)), F.count_if(C.is_hom_alt(gt, ploidy))
    return [
        called.alias("n_called"),
        F.try_divide(called.cast("double"), total).alias("call_rate"),
        F.count_if(C.is_het(gt, ploidy)).alias("n_het"),
        ref.alias("n_hom_ref"),
        alt.alias("n_hom_alt"),
        (called - ref).alias("n_non_ref"),
    ]


def variant_stats(calls: DataFrame, n_samples: int | Column, n_alleles: int, gt: str = "call_genotype", ploidy: int | None = None) -> DataFrame:
    """Call and allele statistics of each variant. Partial calls aren't called, but
    their alleles count. Give ``ploidy`` where all calls have it: it is faster."""
    total = n_samples if isinstance(n_samples, Column) else F.lit(float(n_samples))
    sums = _sums(n_alleles, gt, None, ploidy)
    out = calls.groupBy("variant_index").agg(*_call_stats(gt, total, ploidy), F.array(*sums).alias("variant_allele_count"))
    total_alleles = F.aggregate("variant_allele_count", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.withColumn("variant_allele_total", total_alleles).withColumn("variant_allele_frequency", C.frequencies("variant_allele_count"))


def sample_stats(calls: DataFrame, n_variants: int | Column, gt: str = "call_genotype", ploidy: int | None = None) -> DataFrame:
    total = n_variants if isinstance(n_variants, Column) else F.lit(float(n_variants))
    return calls.groupBy("sample_index").agg(*_call_stats(gt, total, ploidy))


def infer_ploidy(calls: DataFrame, key: str, gt: str = "call_genotype") -> DataFrame:
    """The ploidy that all calls of a variant or sample have, else -1."""
    p = C.call_ploidy(gt)
    return calls.groupBy(key).agg(F.when(F.min(p) == F.max(p), F.min(p)).otherwise(F.lit(-1)).alias("ploidy"))


def cohort_reduce(values: DataFrame, samples: DataFrame, keys: list[str], value: str, how: str | Callable[[Column], Column]) -> DataFrame:
    """``sum``, ``mean`` (null if any value is), ``nansum`` or ``nanmean`` by cohort, or an aggregate that ``how`` makes of the column."""
    x = F.col(value)
    agg = {"sum": C.cohort_sum(x), "mean": C.cohort_mean(x), "nansum": F.coalesce(F.sum(x), F.lit(0.0)), "nanmean": F.avg(x)}
    if not callable(how) and how not in agg:
        raise ValueError(f"no reduction {how}")
    made = how(x) if callable(how) else agg[how]
    return with_cohort(values, samples).groupBy(*keys, "cohort").agg(made.alias("value"))


def observed_heterozygosity(calls: DataFrame, samples: DataFrame, n_alleles: int, gt: str = "call_genotype", ploidy: int | None = None) -> DataFrame:
    """variant_index, cohort, value: mean heterozygosity of the cohort's calls that have one."""
    het = calls.withColumn("het", C.heterozygosity(C.allele_counts(gt, n_alleles, ploidy)))
    return cohort_reduce(het, samples, ["variant_index"], "het", "nanmean")
