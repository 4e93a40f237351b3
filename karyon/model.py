"""The dataset: tables keyed by variant, sample and call, with checked columns.

A table holds the variables of one set of dimensions. Inner dimensions of fixed
size (ploidy, alleles, genotypes) are arrays.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karyon.functions import calls as C
from karyon.operators import aggregation as agg


class MergeWarning(UserWarning):
    """A result replaces a column of the same name."""


@dataclass(frozen=True)
class Spec:
    """A variable: its table, kind (i, f, b, s) and number of inner dimensions."""

    name: str
    table: str
    kind: str
    inner: int = 0
    doc: str = ""


_KINDS = {"i": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "f": (T.FloatType, T.DoubleType), "b": (T.BooleanType,), "s": (T.StringType,)}

#: Registered variables: name, table, kind, array dimensions. Fixed values.
_REGISTERED = [
    Spec("contig_id", "contigs", "s", 0),
    Spec("variant_contig", "variants", "i", 0),
    Spec("variant_position", "variants", "i", 0),
    Spec("variant_id", "variants", "s", 0),
    Spec("variant_allele", "variants", "s", 1),
    Spec("variant_allele_count", "variants", "i", 1),
    Spec("variant_allele_frequency", "variants", "f", 1),
    Spec("variant_allele_total", "variants", "i", 0),
    Spec("variant_call_rate", "variants", "f", 0),
    Spec("variant_genotype_count", "variants", "i", 1),
    Spec("variant_hwe_p_value", "variants", "f", 0),
    Spec("variant_n_called", "variants", "i", 0),
    Spec("variant_n_het", "variants", "i", 0),
    Spec("variant_n_hom_alt", "variants", "i", 0),
    Spec("variant_n_hom_ref", "variants", "i", 0),
    Spec("variant_n_non_ref", "variants", "i", 0),
    Spec("variant_ploidy", "variants", "i", 0),
    Spec("variant_score", "variants", "f", 0),
    Spec("sample_id", "samples", "s", 0),
    Spec("sample_cohort", "samples", "i", 0),
    Spec("sample_call_rate", "samples", "f", 0),
    Spec("sample_n_called", "samples", "i", 0),
    Spec("sample_n_het", "samples", "i", 0),
    Spec("sample_n_hom_alt", "samples", "i", 0),
    Spec("sample_n_hom_ref", "samples", "i", 0),
    Spec("sample_n_non_ref", "samples", "i", 0),
    Spec("sample_ploidy", "samples", "i", 0),
    Spec("parent", "samples", "i", 1),
    Spec("parent_id", "samples", "s", 1),
    Spec("stat_Hamilton_Kerr_tau", "samples", "i", 1),
    Spec("stat_Hamilton_Kerr_lambda", "samples", "f", 1),
    Spec("stat_pedigree_inbreeding", "samples", "f", 0),
    Spec("sample_pca_projection", "samples", "f", 1),
    Spec("covariates", "samples", "f", 1),
    Spec("traits", "samples", "f", 1),
    Spec("call_genotype", "calls", "i", 1),
    Spec("call_genotype_phased", "calls", "b", 0),
    Spec("call_genotype_probability", "calls", "f", 1),
    Spec("call_dosage", "calls", "f", 0),
    Spec("call_allele_count", "calls", "i", 1),
    Spec("call_allele_frequency", "calls", "f", 1),
    Spec("call_heterozygosity", "calls", "f", 0),
    Spec("call_ploidy", "calls", "i", 0),
    Spec("call_genotype_index", "calls", "i", 0),
    Spec("call_genotype_complete", "calls", "i", 1),
    Spec("cohort_allele_count", "variant_cohort", "i", 1),
    Spec("cohort_allele_frequency", "variant_cohort", "f", 1),
    Spec("window_contig", "windows", "i", 0),
    Spec("window_start", "windows", "i", 0),
    Spec("window_stop", "windows", "i", 0),
]
SPECS = {spec.name: spec for spec in _REGISTERED}


def validate(df: DataFrame, *names: str) -> None:
    """Columns must be there, of the kind and nesting that their spec says."""
    for n in names:
        if n not in df.columns:
            raise ValueError(f"{n} is not in the table")
        spec = SPECS.get(n)
        if spec is None:
            continue
        kind, depth = df.schema[n].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        if depth != spec.inner or not isinstance(kind, _KINDS[spec.kind]):
            raise ValueError(f"{n} is {df.schema[n].dataType.simpleString()}, not {spec.kind} with {spec.inner} inner dimensions")


@dataclass(frozen=True)
class GenoDataset:
    """Tables by name and facts about them; every method returns a new dataset."""

    tables: dict[str, DataFrame]
    n_alleles: int = 2
    ploidy: int = 2
    attrs: dict = field(default_factory=dict)

    @property
    def fixed_ploidy(self) -> int | None:
        return None if self.attrs.get("mixed_ploidy") else self.ploidy

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_table(self, name: str, df: DataFrame) -> GenoDataset:
        return replace(self, tables={**self.tables, name: df})

    def merge(self, name: str, key: Sequence[str], result: DataFrame, merge: bool = True) -> GenoDataset:
        """Add a result's columns to a table; columns of the same name are replaced, with a warning."""
        if not merge or name not in self.tables:
            return self.with_table(name, result) if merge else replace(self, tables={name: result})
        here = self.tables[name]
        clash = [c for c in result.columns if c in here.columns and c not in key]
        if clash:
            warnings.warn(f"replaced in {name}: {', '.join(clash)}", MergeWarning, stacklevel=2)
        return self.with_table(name, here.drop(*clash).join(result, list(key), "left"))

    def derived(self, table: str, column: str, make: Callable[[GenoDataset], GenoDataset]) -> GenoDataset:
        """This dataset, with ``column`` made if it is absent."""
        return self if table in self.tables and column in self.tables[table].columns else make(self)

    def pipe(self, f: Callable, *args, **kw):  # noqa: ANN002, ANN003, ANN201
        return f(self, *args, **kw)

    def save(self, path: str, partition_by: dict[str, list[str]] | None = None) -> None:
        """One Parquet directory per table; an existing one is an error."""
        for name, df in self.tables.items():
            w = df.write.mode("errorifexists")
            if partition_by and name in partition_by:
                w = w.partitionBy(*partition_by[name])
            w.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tables: Sequence[str], **kw) -> GenoDataset:  # noqa: ANN003
        """Lazily opened tables; columns named ``*_mask`` become boolean."""
        found = {}
        for t in tables:
            df = spark.read.parquet(f"{path}/{t}")
            masks = [f for f in df.schema.fields if f.name.endswith("_mask")]
            found[t] = df.withColumns({f.name: F.col(f.name).cast("array<boolean>" if isinstance(f.dataType, T.ArrayType) else "boolean") for f in masks})
        return cls(found, **kw)


def create_genotype_dataset(variants: DataFrame, samples: DataFrame, calls: DataFrame, n_alleles: int = 2, ploidy: int = 2, contigs: Sequence[str] = ()) -> GenoDataset:
    """Dataset of calls (variant_index, sample_index, call_genotype), with a mask of missing alleles."""
    validate(calls, "call_genotype")
    masked = calls.withColumn("call_genotype_mask", F.transform("call_genotype", lambda x: x < 0))
    return GenoDataset({"variants": variants, "samples": samples, "calls": masked}, n_alleles, ploidy, {"contigs": list(contigs), "mixed_ploidy": False})


def create_dosage_dataset(variants: DataFrame, samples: DataFrame, calls: DataFrame, contigs: Sequence[str] = ()) -> GenoDataset:
    """Dataset of call_dosage and call_genotype_probability; NaN becomes null, masks say where."""
    clean = calls.withColumn("call_dosage", F.when(~F.isnan("call_dosage"), F.col("call_dosage")))
    return GenoDataset({"variants": variants, "samples": samples, "calls": clean.withColumn("call_dosage_mask", F.col("call_dosage").isNull())}, 2, 2, {"contigs": list(contigs)})


def variant_stats(ds: GenoDataset, merge: bool = True) -> GenoDataset:
    return ds.merge("variants", ["variant_index"], agg.variant_stats(ds["calls"], ds["samples"].count(), ds.n_alleles, ploidy=ds.fixed_ploidy), merge)


def sample_stats(ds: GenoDataset, merge: bool = True) -> GenoDataset:
    return ds.merge("samples", ["sample_index"], agg.sample_stats(ds["calls"], ds["variants"].count(), ploidy=ds.fixed_ploidy), merge)


def count_call_alleles(ds: GenoDataset) -> GenoDataset:
    return ds.with_table("calls", agg.count_call_alleles(ds["calls"], ds.n_alleles, ploidy=ds.fixed_ploidy))


def individual_heterozygosity(ds: GenoDataset) -> GenoDataset:
    ds = ds.derived("calls", "call_allele_count", count_call_alleles)
    return ds.with_table("calls", ds["calls"].withColumn("call_heterozygosity", C.heterozygosity("call_allele_count")))


def count_cohort_alleles(ds: GenoDataset) -> GenoDataset:
    return ds.with_table("variant_cohort", agg.count_cohort_alleles(ds["calls"], ds["samples"], ds.n_alleles, variants=ds["variants"], ploidy=ds.fixed_ploidy))


def encode(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Codes of values by first appearance (``order``: a column that tells it)."""
    first = df.groupBy(column).agg(F.min(order).alias("f")).orderBy("f").collect()  # one row per value; for contigs
    values = [r[column] for r in first]
    code = F.lit(None).cast("int")
    for i, v in enumerate(values):
        code = F.when(F.col(column).eqNullSafe(F.lit(v)), F.lit(i)).otherwise(code)
    return df.withColumn(name, code)


def block_sizes(n: int, blocks: int) -> list[int]:
    """Near-equal sizes of ``blocks`` runs of ``n`` things."""
    if blocks <= 0 or blocks > n:
        raise ValueError("there must be between 1 block and as many as things")
    return [n // blocks + (i < n % blocks) for i in range(blocks)]


def cohorts(pairs: Sequence, labels: Sequence[str] | None = None) -> list[tuple[int, ...]]:
    """Tuples of cohort numbers from numbers or labels, all of one length."""
    rows = [p if isinstance(p, (tuple, list)) else (p,) for p in pairs]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("cohort tuples must have one length")
    return [tuple(list(labels).index(x) if isinstance(x, str) else int(x) for x in r) for r in rows]


def simulate_genotype_calls(spark: SparkSession, n_variant: int, n_sample: int, n_ploidy: int = 2, n_allele: int = 2, n_contig: int = 1, seed: int = 0, missing_pct: float | None = None, phased: bool | None = None) -> GenoDataset:
    """Random calls, made where they are stored: each allele is a hash of its place and the seed."""
    sizes = block_sizes(n_variant, n_contig)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    v = spark.range(n_variant).withColumnRenamed("id", "variant_index")
    contig = F.lit(0)
    for i in range(1, n_contig):
        contig = F.when(F.col("variant_index") >= int(starts[i]), F.lit(i)).otherwise(contig)
    base = F.element_at(F.array(*[F.lit(int(s)) for s in starts[:-1]]), contig + 1)
    v = v.withColumn("variant_contig", contig).withColumn("variant_position", F.col("variant_index") - base)
    v = v.withColumn("variant_allele", F.array(*[F.lit("ACGT"[a % 4] * (1 + a // 4)) for a in range(n_allele)]))
    s = spark.range(n_sample).select(F.col("id").cast("int").alias("sample_index"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample_id"))
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40))
    allele = lambda p: F.pmod(draw(p), F.lit(n_allele)).cast("int")
    gone = lambda p: draw(1000 + p) < int((missing_pct or 0.0) * (1 << 40))
    grid = spark.range(n_variant * n_sample)
    calls = grid.select(
        F.floor(F.col("id") / n_sample).alias("variant_index"), (F.col("id") % n_sample).cast("int").alias("sample_index"),
        F.array(*[F.when(gone(p), F.lit(-1)).otherwise(allele(p)) for p in range(n_ploidy)]).alias("call_genotype"),
        *([F.lit(bool(phased)).alias("call_genotype_phased")] if phased is not None else []),
    )
    return create_genotype_dataset(v, s, calls, n_allele, n_ploidy, [str(i) for i in range(n_contig)])


def display_genotypes(ds: GenoDataset, max_variants: int = 60, max_samples: int = 10) -> str:
    """A text grid of the first and last variants and samples."""

    def ends(n: int, most: int) -> list[int]:
        return list(range(n)) if n <= most else [*range(most // 2), *range(n - most // 2, n)]

    vs, ss = ends(ds["variants"].count(), max_variants), ends(ds["samples"].count(), max_samples)
    c = ds["calls"].where(F.col("variant_index").isin(vs) & F.col("sample_index").isin(ss))
    phased = F.col("call_genotype_phased") if "call_genotype_phased" in c.columns else None
    shown = {(r[0], r[1]): r[2] for r in c.select("variant_index", "sample_index", C.format_genotype("call_genotype", phased)).collect()}
    gap = lambda k, keys: k and keys[k] != keys[k - 1] + 1
    lines = ["\t".join(["", *[("...\t" if gap(k, ss) else "") + str(s) for k, s in enumerate(ss)]])]
    for k, v in enumerate(vs):
        if gap(k, vs):
            lines.append("...")
        lines.append("\t".join([str(v), *[("...\t" if gap(j, ss) else "") + shown.get((v, s), ".") for j, s in enumerate(ss)]]))
    return "\n".join(lines)


def num_contigs(ds: GenoDataset) -> int:
    """How many contigs the variants may have: those of the contig table, else those named with the dataset."""
    return ds["contigs"].count() if "contigs" in ds.tables else len(ds.attrs.get("contigs", []))


def get_contigs(ds: GenoDataset) -> list[str]:
    """Names of contigs in the order of their numbers."""
    if "contigs" in ds.tables:
        return [r["contig_id"] for r in ds["contigs"].orderBy("contig_index").collect()]  # one row per contig
    return list(ds.attrs.get("contigs", []))


def get_filters(ds: GenoDataset) -> list[str]:
    """Names of variant filters, those of the filter table or those named with the dataset."""
    if "filters" in ds.tables:
        return [r["filter_id"] for r in ds["filters"].orderBy("filter_index").collect()]  # one row per filter
    return list(ds.attrs.get("filters", []))
