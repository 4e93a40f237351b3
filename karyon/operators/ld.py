"""Linkage disequilibrium within windows, and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyon.plans.sparse import ALONE_NS, TOGETHER_NS, packed_runs, spread
from karyon.plans.workspace import Workspace


def owner_windows(variants: DataFrame, windows: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """variant_index, contig, stop: pairs of a variant reach up to the end of the last
    window that starts at or before it, if it lies inside.

    The last window is sought inside bins of the index; what the bins before end
    with is carried over by a running value over one row per bin.
    """
    marks = windows.select("contig", F.col("start").alias("at"), F.lit(0).alias("o"), F.struct(F.col("start").alias("s"), "window_index", "stop").alias("w"))
    here = variants.select("contig", F.col("variant_index").alias("at"), F.lit(1).alias("o"), F.lit(None).cast(marks.schema["w"].dataType).alias("w"))
    both = marks.unionByName(here).withColumn("bin", F.floor(F.col("at") / bin_size))
    inside = Window.partitionBy("contig", "bin").orderBy("at", "o", F.col("w.window_index")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("contig", "bin").agg(F.max("w").alias("w")).withColumn("carried", F.last("w", ignorenulls=True).over(before)).drop("w")
    local = both.withColumn("own", F.last("w", ignorenulls=True).over(inside)).where("o = 1")
    met = local.join(ends, ["contig", "bin"]).withColumn("stop", F.coalesce("own", "carried")["stop"])
    return met.where("at < stop").select(F.col("at").alias("variant_index"), "contig", "stop")


def _r2(a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """Squared correlation of each row of ``a`` with each of ``b``, over samples known in both (not negative)."""
    sums = np.zeros((6, len(a), len(b)))
    for at in range(0, a.shape[1], step):
        p, q = a[:, at : at + step], b[:, at : at + step]
        ka, kb = (p >= 0).astype(float), (q >= 0).astype(float)
        xa, xb = np.where(p >= 0, p, 0.0), np.where(q >= 0, q, 0.0)
        for s, x, y in zip(sums, (ka, xa, ka, xa, xa**2, ka), (kb, kb, xb, xb, kb, xb**2)):
            s += x @ y.T
    n, sx, sy, xy, xx, yy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, vx, vy = xy / n - sx * sy / n**2, xx / n - (sx / n) ** 2, yy / n - (sy / n) ** 2
        r2 = cov**2 / (vx * vy)
    r2[(vx <= 1e-14) | (vy <= 1e-14)] = np.nan
    return r2


def _entries(part: pd.DataFrame, idx: str = "idx", val: str = "val") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the row, sample and dosage of all known calls (not negative)."""
    size = part[idx].map(len).to_numpy()
    col, x = np.concatenate(part[idx].to_numpy()).astype(np.int64), np.concatenate(part[val].to_numpy())
    row = np.repeat(np.arange(len(part)), size)
    return row[x >= 0], col[x >= 0], x[x >= 0]


def _r2_inside(a: tuple, b: tuple, low: np.ndarray, high: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of ``a`` and j of ``b`` with low[i] <= j < high[i], and their squared correlation.

    Only the samples that both know are met, one by one.
    """
    (ra, ca, xa), (rb, cb, xb) = a, b
    key = cb * (wide + 1) + rb
    order = np.argsort(key)
    key, rb, xb = key[order], rb[order], xb[order]
    first, last = np.searchsorted(key, ca * (wide + 1) + low[ra]), np.searchsorted(key, ca * (wide + 1) + high[ra])
    count = np.maximum(0, last - first)
    i = np.repeat(np.arange(len(ra)), count)
    j = np.repeat(first, count) + spread(count)
    # Pairs inside are numbered one row after the other.
    size = np.maximum(0, high - low)
    start = np.cumsum(size) - size
    x, y = np.repeat(np.arange(len(low)), size), np.repeat(low, size) + spread(size)
    at, u, v = start[ra[i]] + rb[j] - low[ra[i]], xa[i], xb[j]
    n, sx, sy, xx, yy, xy = (np.bincount(at, w, len(x)) for w in (None, u, v, u * u, v * v, u * v))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, vx, vy = xy / n - sx * sy / n**2, xx / n - (sx / n) ** 2, yy / n - (sy / n) ** 2
        r2 = cov**2 / (vx * vy)
    r2[~((vx > 1e-14) & (vy > 1e-14))] = np.nan
    return x, y, r2


def ld_matrix(dosages: DataFrame, variants: DataFrame, windows: DataFrame, n_samples: int, threshold: float | None = None, block: int = 256) -> DataFrame:
    """i, j (i <= j), value (float): squared correlations of the pairs in windows.

    ``dosages``: variant_index, sample_index, dosage (null or negative: missing).
    ``threshold`` keeps defined values of at least it; none or 0 keeps all,
    undefined ones as null. Packed rows are written and cut into blocks of
    ``block`` variants of a contig; each block meets the blocks that its windows reach,
    one pair of blocks per group, so no group grows with the contig. Where few samples
    are known, only those are met; else matrices are multiplied, some samples at a time.
    """
    reach = variants.select("variant_index", "contig").join(owner_windows(variants, windows).select("variant_index", "stop"), "variant_index", "left")
    rows = packed_runs(dosages, "variant_index", "sample_index", "dosage").join(reach, "variant_index").withColumn("b", F.floor(F.col("variant_index") / block))
    rows = Workspace(dosages.sparkSession, "ld").save(rows, "packed")
    left = rows.where("stop is not null").withColumnRenamed("b", "bi")
    left = left.withColumn("bj", F.explode(F.sequence(F.col("bi"), F.floor((F.col("stop") - 1) / block))))
    far = left.groupBy("contig", "bi").agg(F.max("bj").alias("last"), F.max("stop").alias("end"))
    need = far.select("contig", "bi", "end", F.explode(F.sequence("bi", "last")).alias("bj"))
    right = rows.withColumnRenamed("b", "bj").join(need, ["contig", "bj"]).where("variant_index < end")
    keep = float(threshold or 0)

    def pairs(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"i": [], "j": [], "value": []}).astype({"i": "int64", "j": "int64", "value": "float64"})
        if not len(a) or not len(b):
            return out
        a, b = a.sort_values("variant_index"), b.sort_values("rv")
        i, j = a["variant_index"].to_numpy(), b["rv"].to_numpy()
        low, high = np.searchsorted(j, i), np.searchsorted(j, a["stop"].to_numpy())
        ea, eb = _entries(a), _entries(b, "ridx", "rval")
        seen = np.union1d(ea[1], eb[1])
        share = np.maximum(0, high - low).sum() / (len(a) * len(b))
        if len(ea[0]) * len(eb[0]) / max(1, len(seen)) * share * 4 * ALONE_NS > 6 * len(a) * len(b) * len(seen) * TOGETHER_NS:
            wide = []
            for (row, col, x), part in ((ea, a), (eb, b)):
                wide.append(np.full((len(part), len(seen)), -1.0))
                wide[-1][row, np.searchsorted(seen, col)] = x
            r = _r2(*wide)
            size = np.maximum(0, high - low)
            x, y = np.repeat(np.arange(len(a)), size), np.repeat(low, size) + spread(size)
            r = r[x, y]
        else:
            x, y, r = _r2_inside(ea, eb, low, high, len(b))
        r[i[x] == j[y]] = 1.0
        if keep:
            some = np.nan_to_num(r, nan=-1.0) >= keep
            x, y, r = x[some], y[some], r[some]
        return pd.DataFrame({"i": i[x], "j": j[y], "value": r})

    l2 = left.select("contig", "bi", "bj", "variant_index", "stop", "idx", "val")
    r2 = right.select(F.col("contig").alias("rc"), F.col("bi").alias("rbi"), F.col("bj").alias("rbj"), F.col("variant_index").alias("rv"), F.col("idx").alias("ridx"), F.col("val").alias("rval"))
    met = l2.groupBy("contig", "bi", "bj").cogroup(r2.groupBy("rc", "rbi", "rbj")).applyInPandas(pairs, "i bigint, j bigint, value double")
    return met.withColumn("value", F.when(~F.isnan("value"), F.col("value")).cast("float"))


def segments(edges: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """contig, i, segment: runs of variants that no pair leads out of, by their first.

    A run ends where every pair so far ends. Running values are taken inside bins
    of the index and carried over by one row per bin.
    """
    here, past = Window.unboundedPreceding, -1
    n = edges.groupBy("contig", "i").agg(F.max("j").alias("far")).withColumn("bin", F.floor(F.col("i") / bin_size))
    inside, over = Window.partitionBy("contig", "bin").orderBy("i"), Window.partitionBy("contig").orderBy("bin").rowsBetween(here, past)
    ends = n.groupBy("contig", "bin").agg(F.max("far").alias("f")).withColumn("carried", F.max("f").over(over)).drop("f")
    n = n.withColumn("local", F.max("far").over(inside.rowsBetween(here, past))).join(ends, ["contig", "bin"])
    reach = F.greatest("local", "carried")
    n = n.withColumn("first", F.when(reach.isNull() | (F.col("i") > reach), F.col("i"))).select("contig", "bin", "i", "first")
    starts = n.groupBy("contig", "bin").agg(F.max("first").alias("s")).withColumn("before", F.last("s", ignorenulls=True).over(over)).drop("s")
    n = n.withColumn("own", F.last("first", ignorenulls=True).over(inside.rowsBetween(here, 0))).join(starts, ["contig", "bin"])
    return n.select("contig", "i", F.coalesce("own", "before").alias("segment"))


def maximal_independent_set(edges: DataFrame, contig: DataFrame | None = None) -> DataFrame:
    """ld_prune_index_to_drop: greedy over pairs sorted by (i, j).

    ``edges``: i, j and optionally cmp (sign of score_i - score_j). A pair whose
    first was dropped is passed over; else the one of lower score is dropped, the
    second among equals. The order matters only inside a run of variants that no
    pair leads out of, so runs (of each contig, with ``contig``: variant_index,
    contig) go side by side.
    """
    has = "cmp" in edges.columns
    e = edges.where("i < j").select("i", "j", (F.col("cmp") if has else F.lit(0)).cast("int").alias("cmp"))
    e = e.join(contig.select(F.col("variant_index").alias("i"), "contig"), "i") if contig is not None else e.withColumn("contig", F.lit(0))
    e = e.join(segments(e), ["contig", "i"])

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lost = None, set()
        for b in batches:
            drop = []
            for run, i, j, c in zip(zip(b["contig"].to_pylist(), b["segment"].to_pylist()), *(b[k].to_pylist() for k in ("i", "j", "cmp"))):
                if run != now:
                    now, lost = run, set()
                if i not in lost and (k := i if c < 0 else j) not in lost:
                    lost.add(k)
                    drop.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(drop, pa.int64())], ["ld_prune_index_to_drop"])

    # All of a run behind each other, without a group for each of very many.
    e = e.select("contig", "segment", "i", "j", "cmp").repartition("contig", "segment").sortWithinPartitions("contig", "segment", "i", "j")
    return e.mapInArrow(greedy, "ld_prune_index_to_drop bigint")


def ld_prune(dosages: DataFrame, variants: DataFrame, windows: DataFrame, n_samples: int, threshold: float = 0.2, score: str | None = None) -> DataFrame:
    """The variants that remain."""
    edges = Workspace(dosages.sparkSession, "prune").save(ld_matrix(dosages, variants, windows, n_samples, threshold), "edges")
    if score:
        s = variants.select("variant_index", F.col(score).alias("s"))
        edges = edges.join(s.select(F.col("variant_index").alias("i"), F.col("s").alias("si")), "i").join(s.select(F.col("variant_index").alias("j"), F.col("s").alias("sj")), "j").withColumn("cmp", F.signum(F.col("si") - F.col("sj")).cast("int"))
    drop = maximal_independent_set(edges, variants)
    return variants.join(drop, variants["variant_index"] == drop["ld_prune_index_to_drop"], "left_anti")
