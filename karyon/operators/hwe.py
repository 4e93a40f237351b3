"""Exact test of Hardy-Weinberg equilibrium."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_p(hets: int, hom1: int, hom2: int) -> float:
    """Probability of the observed number of heterozygotes or a rarer one.

    The probabilities of all numbers of the same parity are ratios of
    factorials, so they are taken from log-gamma at once; NaN without
    individuals.
    """
    if min(hets, hom1, hom2) < 0:
        raise ValueError("counts must not be negative")
    n = hets + hom1 + hom2
    if n == 0:
        return float("nan")
    rare = 2 * min(hom1, hom2) + hets
    h = np.arange(rare % 2, rare + 1, 2, dtype=np.float64)
    small, large = (rare - h) / 2, n - (rare + h) / 2
    log_p = h * np.log(2.0) - _log_factorial(h) - _log_factorial(small) - _log_factorial(large)
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    seen = p[(hets - rare % 2) // 2]
    return float(min(1.0, p[p <= seen * (1 + 1e-9)].sum()))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """Stirling's series from 20 on, exact products below."""
    table = np.array([lgamma(i + 1.0) for i in range(20)])
    big = np.maximum(x, 20.0)
    series = (big + 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 20, table[np.minimum(x, 19).astype(int)], series)


def hardy_weinberg_p(hets: Column, hom1: Column, hom2: Column) -> Column:
    """Column form; null for null counts or none at all."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        known = a.notna() & b.notna() & c.notna()
        out = pd.Series(np.nan, index=a.index)
        keys = pd.DataFrame({"a": a[known].astype(int), "b": b[known].astype(int), "c": c[known].astype(int)})
        if len(keys):
            each = keys.drop_duplicates().copy()
            each["p"] = [exact_p(*x) for x in each.itertuples(index=False)]
            out[known] = keys.merge(each, on=["a", "b", "c"], how="left")["p"].to_numpy()
        return out

    return F.nanvl(p(hets, hom1, hom2), F.lit(None).cast("double"))


def hardy_weinberg_test(genotype_counts: DataFrame) -> DataFrame:
    """Add variant_hwe_p_value to diploid biallelic ``variant_genotype_count`` (0/0, 0/1, 1/1)."""
    at = lambda i: F.get("variant_genotype_count", F.lit(i))
    return genotype_counts.withColumn("variant_hwe_p_value", hardy_weinberg_p(at(1), at(0), at(2)))


