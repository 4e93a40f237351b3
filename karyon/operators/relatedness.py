"""Similarity of samples: identity by state, genomic relationships, distances, PC-Relate.

All are sums over variants of products of two samples' values, so a packed row
of dosages per variant is turned into partial Gram matrices per task. Results
are rows i, j, value for both orders of a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyon.functions import calls as C
from karyon.plans.packing import gram, packed_rows
from karyon.plans.sparse import Block, runs, sparse_gram
from karyon.plans.workspace import Workspace


def _known(x: np.ndarray) -> np.ndarray:
    return (x >= 0).astype(np.float64)


def identity_by_state(calls: DataFrame, n_samples: int, n_alleles: int, method: str = "frequencies", gt: str = "call_genotype", skipna: bool = True, undefined: bool = True) -> DataFrame:
    """Mean identity of two samples over the variants called in both.

    Without ``skipna`` a pair is null unless both are called at every variant that
    anyone is called at.

    Over alleles, the products of the two calls' allele frequencies are added, which
    is the chance that alleles drawn from either match; so the methods
    ``frequencies`` and ``matching`` are one. Without a common variant: null, or no row
    without ``undefined``.
    """
    if method not in ("frequencies", "matching"):
        raise ValueError(f"unknown method {method}")
    freq = C.frequencies(C.allele_counts(gt, n_alleles))
    if skipna:
        names = [f"f{a}" for a in range(n_alleles)]
        known = calls.select("variant_index", "sample_index", freq.alias("f")).where(F.get("f", F.lit(0)).isNotNull())
        rows = runs(known.select("variant_index", "sample_index", *[F.get("f", F.lit(a)).alias(k) for a, k in enumerate(names)]), "variant_index", "sample_index", *names)
        g = sparse_gram(rows, lambda b: {"n": [np.ones(len(b.col))], "s": [b.of[k] for k in names]}, ["n", "s"], n_samples, undefined)
        return g.select("i", "j", F.try_divide(F.col("s"), F.col("n")).alias("value"))
    rows = None
    for a in range(n_alleles):
        v = calls.select("variant_index", "sample_index", F.get(freq, F.lit(a)).alias("f"))
        part = packed_rows(v, "variant_index", "sample_index", "f")
        rows = part if rows is None else rows.unionByName(part)

    def features(x: np.ndarray, _: pd.DataFrame) -> dict:
        k, y = _known(x), np.where(x >= 0, x, 0.0)
        return {"n": [(k, k)], "s": [(y, y)], "all": [(np.ones_like(k), np.ones_like(k))]}

    g = gram(rows, features, ["n", "s", "all"], n_samples)
    value = F.when(F.col("n") == F.col("all"), F.try_divide(F.col("s"), F.col("n") / n_alleles)).alias("value")
    return g.select("i", "j", value) if undefined else g.select("i", "j", value).where("value is not null")


def weir_goudet_beta(ibs: DataFrame) -> DataFrame:
    """(ibs - mean of the pairs) / (1 - mean), the mean being that of defined pairs.

    ``ibs`` is written first, since its mean and its rows are both read.
    """
    ibs = Workspace(ibs.sparkSession, "beta").save(ibs.select("i", "j", "value"), "ibs", mean=F.avg(F.when(F.col("i") > F.col("j"), F.col("value"))))
    mean = ibs.facts["mean"]
    if mean is None or mean == 1:
        return ibs.withColumn("value", F.lit(None).cast("double"))
    return ibs.select("i", "j", ((F.col("value") - mean) / (1 - mean)).alias("value"))


def genomic_relationship(
    dosages: DataFrame, frequencies: DataFrame, n_samples: int, ploidy: int = 2, estimator: str = "VanRaden", skipna: bool = False, undefined: bool = True
) -> DataFrame:
    """``dosages``: variant_index, sample_index, dosage; ``frequencies``: variant_index, frequency.

    VanRaden, for pairs over variants known in both if ``skipna`` (pairs without one are
    null, or without ``undefined`` no row; else a missing dosage makes the sample's values null), or Endelman-Jannink with Ledoit-Wolf
    shrinkage.
    """
    if estimator not in ("VanRaden", "Endelman-Jannink"):
        raise ValueError(f"unknown estimator {estimator}")
    if estimator != "VanRaden" and skipna:
        raise NotImplementedError("skipna needs the VanRaden estimator")
    if skipna:
        known = dosages.where(F.col("dosage") >= 0).join(frequencies.select("variant_index", "frequency"), "variant_index")

        def products(b: Block) -> dict:
            p = b.of["frequency"]
            return {"m": [b.of["dosage"] - ploidy * p], "d": [np.sqrt(np.maximum(0.0, ploidy * p * (1 - p)))]}

        g = sparse_gram(runs(known, "variant_index", "sample_index", "dosage", "frequency"), products, ["m", "d"], n_samples, undefined)
        return g.select("i", "j", F.try_divide("m", "d").alias("value"))
    rows = packed_rows(dosages, "variant_index", "sample_index", "dosage").join(frequencies.select("variant_index", "frequency"), "variant_index")

    def centred(d: np.ndarray, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = part["frequency"].to_numpy()[:, None]
        k = _known(d)
        return np.where(k > 0, d - ploidy * p, 0.0), k, p

    if estimator == "VanRaden":

        def features(x: np.ndarray, part: pd.DataFrame) -> dict:
            m, k, p = centred(x, part)
            one = np.ones_like(k)
            return {"m": [(m, m)], "all": [(one * (ploidy * p), one * (1 - p))], "gaps": [(1 - k, one), (one, 1 - k)]}

        g = gram(rows, features, ["m", "all", "gaps"], n_samples)
        return g.select("i", "j", F.when(F.col("gaps") == 0, F.try_divide(F.col("m"), F.col("all"))).alias("value"))

    # One mean per sample: as many numbers as a packed row has.
    joined = dosages.join(frequencies.select("variant_index", "frequency"), "variant_index")
    mean = np.zeros(n_samples)
    for r in joined.groupBy("sample_index").agg(F.avg(F.col("dosage") - ploidy * F.col("frequency")).alias("w")).collect():
        mean[r["sample_index"]] = r["w"]

    def shrunk(x: np.ndarray, part: pd.DataFrame) -> dict:
        w = centred(x, part)[0] - mean
        return {"s": [(w, w)], "q": [(w**2, w**2)]}

    p = F.col("frequency")
    v, pq = rows.agg(F.count("*"), F.sum(p * (1 - p))).first()
    g = gram(rows, shrunk, ["s", "q"], n_samples).select("i", "j", (F.col("s") / v).alias("s"), (F.col("q") / v).alias("q"))
    g = Workspace(dosages.sparkSession, "shrink").save(g, "sums", trace=F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))))
    mu = (g.facts["trace"] or 0.0) / n_samples
    target = F.when(F.col("i") == F.col("j"), mu).otherwise(0.0)
    up, down = g.agg(F.sum((F.col("q") - F.col("s") ** 2) / v), F.sum((F.col("s") - target) ** 2)).first()
    delta = min(1.0, max(0.0, up / down)) if down else 0.0
    means = dosages.sparkSession.createDataFrame([(i, float(m)) for i, m in enumerate(mean)], "k bigint, w double")  # one number per sample
    out = g.join(means.select(F.col("k").alias("i"), F.col("w").alias("wi")), "i").join(means.select(F.col("k").alias("j"), F.col("w").alias("wj")), "j")
    value = F.try_divide(delta * target + (1 - delta) * F.col("s") + F.col("wi") * F.col("wj"), F.lit(ploidy * pq / v))
    return out.select("i", "j", value.alias("value"))


def pairwise_distance(vectors: DataFrame, metric: str = "euclidean", queries: DataFrame | None = None, block: int = 512) -> DataFrame:
    """i, j, value between the vectors (row_id, vector): all pairs i <= j, or each of
    ``queries`` with every vector.

    Coordinates that are negative or not known in either vector are left out.
    ``correlation`` is 1 - r, null without variance. Vectors are cut into blocks by
    id, and each pair of blocks is one group.
    """
    if metric not in ("euclidean", "correlation"):
        raise NotImplementedError(f"no metric {metric}")
    number = F.dense_rank().over(Window.orderBy("b")) - 1
    right = vectors.select("row_id", F.col("vector").cast("array<double>").alias("x"), F.floor(F.col("row_id") / block).alias("b"))
    left = right if queries is None else queries.select("row_id", F.col("vector").cast("array<double>").alias("x"), F.pmod(F.xxhash64("row_id"), F.lit(16)).alias("b"))
    # Blocks by number: one row per block, each meeting a range of numbers.
    rb = right.groupBy("b").count().select("b", number.alias("n"))
    lb = rb if queries is None else left.groupBy("b").count().select("b", number.alias("n"))
    nr, nl = rb.count(), lb.count()
    if not nl or not nr:
        return right.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(0.0).alias("value")).limit(0)
    first = F.col("n") if queries is None else F.lit(0)
    last = F.col("n") if queries is None else F.lit(nl - 1)
    left = left.join(lb, "b").select(F.col("n").alias("bi"), F.explode(F.sequence(first, F.lit(nr - 1))).alias("bj"), "row_id", "x")
    right = right.join(rb, "b").select(F.explode(F.sequence(F.lit(0), last)).alias("ri"), F.col("n").alias("rj"), F.col("row_id").alias("rid"), F.col("x").alias("rx"))
    half = queries is None

    def pairs(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"i": np.array([], np.int64), "j": np.array([], np.int64), "value": np.array([], float)})
        x, y = np.stack(a["x"].to_numpy()).astype(float), np.stack(c["rx"].to_numpy()).astype(float)
        kx, ky = (x >= 0).astype(float), (y >= 0).astype(float)
        x, y = np.where(kx > 0, x, 0.0), np.where(ky > 0, y, 0.0)
        xx, yy, xy = (x**2) @ ky.T, kx @ (y**2).T, x @ y.T
        if metric == "euclidean":
            v = np.sqrt(np.maximum(0.0, xx + yy - 2 * xy))
            v[v < 1e-6] = 0.0
        else:
            n, sx, sy = kx @ ky.T, x @ ky.T, kx @ y.T
            with np.errstate(divide="ignore", invalid="ignore"):
                den = (xx - sx**2 / n) * (yy - sy**2 / n)
                v = np.where(den > 1e-12, 1 - (xy - sx * sy / n) / np.sqrt(den), np.nan)
        i, j = a["row_id"].to_numpy(), c["rid"].to_numpy()
        p, q = np.nonzero(i[:, None] <= j[None, :]) if half else [z.ravel() for z in np.indices(v.shape)]
        return pd.DataFrame({"i": i[p], "j": j[q], "value": v[p, q]})

    out = left.groupBy("bi", "bj").cogroup(right.groupBy("ri", "rj")).applyInPandas(pairs, "i bigint, j bigint, value double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def pc_relate(calls: DataFrame, components: np.ndarray, n_samples: int, maf: float = 0.01, gt: str = "call_genotype") -> DataFrame:
    """Kinship i, j, value of diploid biallelic calls given ``components`` (samples x components)."""
    if not 0 < maf < 1:
        raise ValueError("maf must be between 0 and 1")
    q, _ = np.linalg.qr(np.column_stack([np.ones(n_samples), components]))
    shared = calls.sparkSession.sparkContext.broadcast((q, q.sum(0)))
    g = calls.select("variant_index", "sample_index", C.collapse_ploidy(gt).cast("double").alias("g")).where("g >= 0")

    def products(b: Block) -> dict:
        """A missing call counts as the variant's mean in the regression on components, and then drops out."""
        basis, whole = shared.value
        x, own = b.of["g"], basis[b.col]
        mean = b.sums(x) / np.diff(b.ptr)
        part = b.sums((x - mean[b.at])[:, None] * own) + mean[:, None] * whole
        mu = 0.5 * (part[b.at] * own).sum(1)
        keep = (mu > maf) & (mu < 1 - maf)
        return {"a": [np.where(keep, x / 2 - mu, 0.0)], "b": [np.where(keep, np.sqrt(np.clip(mu * (1 - mu), 0, None)), 0.0)]}

    m = sparse_gram(runs(g, "variant_index", "sample_index", "g"), products, ["a", "b"], n_samples, True)
    return m.select("i", "j", F.try_divide("a", "b").alias("value"))


# Matrices of relationships: i, j, value


def collect_matrix(m: DataFrame, ids: list[int]) -> np.ndarray:
    """A square matrix of the given ids, NaN where it has no value. For dense linear algebra, which one task does."""
    at = m.sparkSession.createDataFrame([(int(k), n) for n, k in enumerate(ids)], "k bigint, n int")
    cells = m.join(at.select(F.col("k").alias("i"), F.col("n").alias("p")), "i").join(at.select(F.col("k").alias("j"), F.col("n").alias("q")), "j").select("p", "q", "value").toPandas()
    out = np.zeros((len(ids), len(ids)))
    out[cells["p"], cells["q"]] = cells["value"].astype(float)
    return out


def _frame(like: DataFrame, m: np.ndarray, ids: list[int]) -> DataFrame:
    i, j = np.indices(m.shape)
    k = np.asarray(ids)
    return like.sparkSession.createDataFrame(pd.DataFrame({"i": k[i.ravel()], "j": k[j.ravel()], "value": m.ravel()}), "i bigint, j bigint, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def invert_relationship_matrix(m: DataFrame, ids: list[int]) -> DataFrame:
    """Inverse of the sub-matrix of ``ids``, in one task; null in rows and columns of ids with an undefined value."""
    x = collect_matrix(m, ids)
    known = ~np.isnan(np.diag(x))
    known &= ~np.isnan(x[:, known]).any(1)
    out = np.full(x.shape, np.nan)
    out[np.ix_(known, known)] = np.linalg.inv(x[np.ix_(known, known)])
    return _frame(m, out, ids)


def hybrid_relationship(g: DataFrame, a: DataFrame, ids: list[int], genotyped: list[int], tau: float = 1.0, omega: float = 1.0) -> DataFrame:
    """H of Martini: pedigree relationships ``a`` of ``ids`` joined with genomic ``g`` of ``genotyped``."""
    rest = [k for k in ids if k not in set(genotyped)]
    a_all, g22 = collect_matrix(a, rest + genotyped), collect_matrix(g, genotyped)
    n = len(rest)
    a11, a12, a22 = a_all[:n, :n], a_all[:n, n:], a_all[n:, n:]
    a22_inv = np.linalg.inv(a22)
    if omega == 1:
        h22 = g22 / tau
    else:
        h22 = np.linalg.inv(tau * np.linalg.inv(g22) + (1 - omega) * a22_inv)
    t = a12 @ a22_inv
    top = a11 + t @ (h22 - a22) @ t.T
    side = t @ h22
    return _frame(a, np.block([[top, side], [side.T, h22]]), rest + genotyped)


def hybrid_inverse_relationship(a_inv: DataFrame, g_inv: DataFrame, a22_inv: DataFrame, tau: float = 1.0, omega: float = 1.0) -> DataFrame:
    """Inverse of H: a sum of three sparse matrices over (i, j), without linear algebra."""
    w = a_inv.select("i", "j", "value").unionByName(g_inv.select("i", "j", (tau * F.col("value")).alias("value"))).unionByName(a22_inv.select("i", "j", (-omega * F.col("value")).alias("value")))
    return w.groupBy("i", "j").agg(F.sum("value").alias("value"))

