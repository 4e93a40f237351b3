"""Expressions on one genotype call: an array of allele numbers.

-1 stands for a missing allele, -2 for padding of lower ploidy. Undefined
numbers are null.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _slots(gt: Column | str, ploidy: int) -> list[Column]:
    """The alleles one by one. With a known ploidy, tests on them compile into the
    stage's code, which functions on arrays don't."""
    return [F.get(_c(gt), F.lit(i)) for i in range(ploidy)]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def allele_count(gt: Column | str, allele: int | Column, ploidy: int | None = None) -> Column:
    """Occurrences of one allele in a call."""
    if ploidy:
        return reduce(lambda a, b: a + b, [F.when(x == allele, 1).otherwise(0) for x in _slots(gt, ploidy)])
    return F.size(F.filter(_c(gt), lambda x: x == allele))


def allele_counts(gt: Column | str, n_alleles: int, ploidy: int | None = None) -> Column:
    """Occurrences of alleles 0 .. n_alleles - 1; missing ones count nowhere."""
    return F.array(*[allele_count(gt, a, ploidy).cast("bigint") for a in range(n_alleles)])


def frequencies(counts: Column | str) -> Column:
    """Counts over their sum; nulls where the sum is 0."""
    total = F.aggregate(_c(counts), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(_c(counts), lambda x: F.try_divide(x.cast("double"), total))


def heterozygosity(counts: Column | str) -> Column:
    """Chance that two alleles drawn from a call differ; null for fewer than two."""
    k = F.aggregate(_c(counts), F.lit(0).cast("bigint"), lambda a, x: a + x)
    same = F.aggregate(_c(counts), F.lit(0.0), lambda a, x: a + F.pow(x / k, F.lit(2)))
    return F.when(k > 1, (1 - same) * k / (k - 1))


def is_missing(gt: Column | str, ploidy: int | None = None) -> Column:
    """Whether any allele is missing (or padding)."""
    return ~_all([x >= 0 for x in _slots(gt, ploidy)]) if ploidy else F.exists(_c(gt), lambda x: x < 0)


def is_called(gt: Column | str, ploidy: int | None = None) -> Column:
    return ~is_missing(gt, ploidy)


def is_hom(gt: Column | str, ploidy: int | None = None) -> Column:
    """All alleles equal, none missing."""
    if ploidy:
        first, *rest = _slots(gt, ploidy)
        return _all([first >= 0, *[x == first for x in rest]])
    g = _c(gt)
    return F.forall(g, lambda x: (x >= 0) & (x == F.get(g, F.lit(0))))


def is_hom_ref(gt: Column | str, ploidy: int | None = None) -> Column:
    return _all([x == 0 for x in _slots(gt, ploidy)]) if ploidy else F.forall(_c(gt), lambda x: x == 0)


def is_hom_alt(gt: Column | str, ploidy: int | None = None) -> Column:
    return is_hom(gt, ploidy) & (F.get(_c(gt), F.lit(0)) > 0)


def is_het(gt: Column | str, ploidy: int | None = None) -> Column:
    """No allele missing and not all equal, for any ploidy."""
    return is_called(gt, ploidy) & ~is_hom(gt, ploidy)


def alternate_count(gt: Column | str) -> Column:
    """Alleles other than the reference; -1 where one is missing."""
    return F.when(is_missing(gt), F.lit(-1)).otherwise(F.size(F.filter(_c(gt), lambda x: x > 0)))


def collapse_ploidy(gt: Column | str) -> Column:
    """Sum of allele numbers; -1 where one is missing."""
    return F.when(is_missing(gt), F.lit(-1)).otherwise(F.aggregate(_c(gt), F.lit(0), lambda a, x: a + x.cast("int")))


def fill_mask(gt: Column | str) -> Column:
    """True for padding alleles."""
    return F.transform(_c(gt), lambda x: x < -1)


def call_ploidy(gt: Column | str) -> Column:
    """Alleles that aren't padding."""
    return F.size(F.filter(_c(gt), lambda x: x >= -1))


def complete(gt: Column | str, mixed_ploidy: bool = False) -> Column:
    """A call without any of its alleles if one is missing; padding stays."""
    g = _c(gt)
    if mixed_ploidy:
        return F.when(F.exists(g, lambda x: x == -1), F.transform(g, lambda x: F.when(x >= -1, F.lit(-1)).otherwise(x))).otherwise(g)
    return F.when(is_missing(g), F.transform(g, lambda x: F.lit(-1))).otherwise(g)


def with_replacement(n: int, k: int) -> int:
    """Multisets of size k from n things; none from nothing."""
    return 0 if n == 0 else comb(n + k - 1, k)


def genotype_index(gt: Column | str, n_alleles: int, ploidy: int) -> Column:
    """Place of a genotype in the order of the VCF's G fields; -1 where an allele is missing.

    An allele number outside 0 .. n_alleles - 1 is an error of the data: null.
    """
    g = F.transform(_c(gt), lambda x: x.cast("int"))
    if n_alleles == 2:
        inner = F.aggregate(g, F.lit(0), lambda a, x: a + x)
    else:
        table = F.array(*[F.array(*[F.lit(with_replacement(a, i + 1)) for a in range(n_alleles)]) for i in range(ploidy)])
        inner = F.aggregate(F.transform(F.array_sort(g), lambda x, i: F.get(F.get(table, i), x)), F.lit(0), lambda a, x: a + x)
    return F.when(is_missing(gt), F.lit(-1)).when(F.forall(g, lambda x: x < n_alleles), inner)


def index_genotype(index: int, ploidy: int) -> list[int]:
    """The sorted alleles of a genotype by its place in G order."""
    out, left = [], index
    for i in range(ploidy, 0, -1):
        a = 0
        while with_replacement(a + 1, i) <= left:
            a += 1
        left -= with_replacement(a, i)
        out.append(a)
    return out[::-1]


def genotype_labels(n_alleles: int, ploidy: int) -> list[str]:
    """Labels such as 0/0, 0/1, 1/1 in G order."""
    return ["/".join(map(str, index_genotype(i, ploidy))) for i in range(comb(n_alleles + ploidy - 1, ploidy))]


def hard_call(probability: Column | str, threshold: float = 0.9) -> Column:
    """The likeliest of three diploid genotypes; -1 -1 where one is unknown, the
    best is below the threshold, or two are equally good."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be in [0, 1]")
    p = F.transform(_c(probability), lambda x: F.when(~F.isnan(x), x))
    best = F.array_max(p)
    unknown = (F.size(p) != 3) | F.exists(p, lambda x: x.isNull())
    tied = F.size(F.filter(p, lambda x: x == best)) > 1
    none = F.array(F.lit(-1), F.lit(-1))
    low = (best < threshold) if threshold > 0 else F.lit(False)
    at = F.array_position(p, best)
    return F.when(unknown | low | tied, none).when(at == 1, F.array(F.lit(0), F.lit(0))).when(at == 2, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(1)))


def dosage_of(probability: Column | str) -> Column:
    """Expected alternate alleles of a diploid biallelic call."""
    p = _c(probability)
    return F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2))


def format_genotype(gt: Column | str, phased: Column | None = None) -> Column:
    """0/1 or 0|1; a point for missing alleles, nothing for padding."""
    shown = F.transform(F.filter(_c(gt), lambda x: x >= -1), lambda x: F.when(x == -1, F.lit(".")).otherwise(x.cast("string")))
    flat = F.array_join(shown, "/")
    return flat if phased is None else F.when(phased, F.array_join(shown, "|")).otherwise(flat)


def self_kinship(inbreeding: Column | str, ploidy: Column | int) -> Column:
    """Kinship of an individual with itself."""
    return (1 + (ploidy - 1) * _c(inbreeding)) / ploidy


def cohort_sum(x: Column) -> Column:
    """Sum that is null if any value is."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def cohort_mean(x: Column) -> Column:
    """Mean that is null if any value is, or if there is none."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))
