"""Most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking.

Vectors are small non-negative integers (values in units of a given step), so
exact distances are whole numbers and ties are real ties. Coarse centroids, four
times the square root of the rows, and codebooks of residuals are fitted on a
bounded sample in two levels; every vector is indexed and every vector is a query.

A query first meets its own list, exactly: its k-th distance there bounds what can
still count. Then it goes to as many of the nearest lists as a gauge against
brute force says, but for those that lie wholly beyond the bound. There asymmetric
distances to the codes, less each code's own error, rule vectors out; all others
are measured exactly. So codes lose nothing: a neighbour is only lost to a list
that isn't probed.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Index:
    """Coarse centroids (lists x d) and codebooks of residuals (parts x codes x d / parts)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1)[None, :] - 2.0 * x @ self.centroids.T
        n = min(n, len(self.centroids))
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each residual is from what its code stands for."""
        m, _, width = self.codebooks.shape
        out, off = np.empty((len(residual), m), np.uint8), np.zeros(len(residual), np.float32)
        for j in range(m):
            r, c = residual[:, j * width : (j + 1) * width], self.codebooks[j]
            out[:, j] = ((c**2).sum(1)[None, :] - 2.0 * r @ c.T).argmin(1)
            off += ((r - c[out[:, j]]) ** 2).sum(1)
        return out, np.sqrt(off)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each query's parts to each code: parts x queries x codes."""
        m, _, width = self.codebooks.shape
        r = residual.reshape(len(residual), m, width).transpose(1, 0, 2)
        return (r**2).sum(2)[:, :, None] - 2.0 * r @ self.codebooks.transpose(0, 2, 1) + (self.codebooks**2).sum(2)[:, None, :]

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries (their residuals to a list) to the codes of the list."""
        total = np.zeros((len(residual), len(codes)), np.float32)
        for j, t in enumerate(self.tables(residual)):
            total += t[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random distinct rows; empty cells take far points."""
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    k = min(k, len(start))
    c = start[rng.choice(len(start), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        a, least = _closest(x, c)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if not full.all():
            far = np.argsort(-(least + (x**2).sum(1)))[: (~full).sum()]
            c[~full] = x[far]
    return c


def _closest(x: np.ndarray, c: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The closest of ``c`` for each of ``x``, and its squared distance less that of ``x`` from 0."""
    at, least, norm = np.empty(len(x), np.int64), np.empty(len(x), np.float32), (c**2).sum(1)[None, :]
    for i in range(0, len(x), rows):
        d = norm - 2.0 * x[i : i + rows] @ c.T
        at[i : i + rows] = d.argmin(1)
        least[i : i + rows] = d.min(1)
    return at, least


def coarse(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """``lists`` centroids in two levels: the square root of them first, then some in each cell by its share of the rows."""
    first = kmeans(x, max(1, int(np.sqrt(lists))), 10, seed)
    at = _closest(x, first)[0]
    size = np.bincount(at, minlength=len(first))
    due = np.maximum(size > 0, np.diff(np.floor(np.concatenate([[0.5], np.cumsum(size) * (lists / len(x)) + 0.5]))).astype(int))
    return np.concatenate([kmeans(x[at == c], int(due[c]), 10, seed + 1 + c) for c in np.flatnonzero(size)])


def fit(sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 7, book_rows: int = 50_000) -> Index:
    """Centroids from the sample; codebooks from the residuals of its first ``book_rows`` rows."""
    x = sample.astype(np.float32)
    parts = parts if x.shape[1] % parts == 0 else 1
    c = coarse(x, lists, seed)
    x = x[:book_rows]
    r, w = x - c[_closest(x, c)[0]], x.shape[1] // parts
    books = [kmeans(r[:, j * w : (j + 1) * w], codes, 8, seed + 1 + j) for j in range(parts)]
    size = max(map(len, books))
    return Index(c, np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), 0)]) for b in books]))


def lists_for(rows: int) -> int:
    return max(1, int(4 * np.sqrt(rows)))


def _matrix(col: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, d)


def _portions(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (x[at : at + size] for at in range(0, len(x), size))


def _k_best(q: np.ndarray, at: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best (dist, at) of each q."""
    order = np.lexsort((at, dist, q))
    q = q[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(q)]])))
    return order[rank < k]


def gauge(vectors: DataFrame, index: Index, asked: np.ndarray, d: int, k: int, target: float) -> int:
    """How many lists must be probed for ``target`` of the true neighbours of the vectors ``asked``, by brute force over all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(asked.astype(np.float32))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for b in batches:
            for x in _portions(_matrix(b["vec"], d), 4096):
                dist = ((x.astype(np.float32) ** 2).sum(1)[None, :] - 2 * q @ x.astype(np.float32).T + (q**2).sum(1)[:, None]).astype(np.float64)
                dist[dist < 0.5] = np.inf  # itself
                c = min(k, len(x))
                at = np.argpartition(dist, c - 1, axis=1)[:, :c]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), c), "dist": np.take_along_axis(dist, at, 1).ravel(), "vec": [x[i].tobytes() for i in at.ravel()]})

    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec"))
    near = vectors.select("vec").mapInPandas(best, "q int, dist double, vec binary").where("dist < double('inf')")
    near = near.withColumn("r", rank).where(F.col("r") <= k).select("q", "vec").toPandas()  # k rows a query
    if not len(near):
        return 1
    lists = index.nearest_lists(_matrix(near["vec"], d).astype(np.float32), 1)[:, 0]
    order = index.nearest_lists(asked.astype(np.float32), len(index.centroids))
    need = np.sort([int(np.flatnonzero(order[q] == c)[0]) + 1 for q, c in zip(near["q"], lists)])
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])


def nearest(
    vectors: DataFrame,
    d: int,
    k: int,
    ws: Workspace,
    train: int = 1_000_000,
    parts: int = 12,
    codes: int = 64,
    target: float = 0.97,
    gauged: int = 400,
    probes: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """The ``k`` nearest other vectors of each: id, near, dist (squared, whole).

    ``vectors`` has id (string, unique) and vec (binary of ``d`` bytes, all
    different). Ties go to the smaller id.

    Lists: four times the square root of the number of rows, whatever that is,
    fitted on 32 rows for each, ``train`` at most. Probes: as many as find
    ``target`` of the neighbours of ``gauged`` vectors, measured by brute force,
    unless ``probes`` is given. The loss is only granted to vectors that were not
    gauged: where all were, none is lost. The share of the lists that is probed falls
    as rows grow. Fewer than k + 1 rows give what there is.
    """
    spark = ws.spark
    n = vectors.count()
    if n < 2:
        return vectors.select("id", F.col("id").alias("near"), F.lit(0).alias("dist")).limit(0)
    # A sample by a hash of the id: alike at every size, and repeatable.
    share = min(1.0, min(train, 32 * lists_for(n)) / n)
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = picked.select(F.xxhash64("id", F.lit(1)).alias("h"), "vec").toPandas().sort_values(["h", "vec"])
    x = _matrix(sample["vec"], d) if len(sample) else _matrix(vectors.limit(2).toPandas()["vec"], d)
    index = fit(x, min(lists_for(n), len(x)), parts, codes)
    asked = x[:gauged]
    probes = min(probes or gauge(vectors, index, asked, d, k, target + (1 - target) * min(1.0, len(asked) / n)), len(index.centroids))
    log.info("%d rows, %d lists, %d probed", n, len(index.centroids), probes)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            for at, x in zip(range(0, len(b), 2048), _portions(_matrix(b["vec"], d), 2048)):
                x = x.astype(np.float32)
                own = ix.nearest_lists(x, 1)[:, 0]
                r = x - ix.centroids[own]
                code, off = ix.encode(r)
                part = b.iloc[at : at + 2048]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": part["vec"].to_numpy(), "list": own.astype(np.int32), "code": [c.tobytes() for c in code], "off": off, "far": np.sqrt((r**2).sum(1))})

    placed = ws.save(vectors.select("id", "vec").mapInPandas(place, "id string, vec binary, list int, code binary, off float, far float"), "placed")
    # Two numbers per list: as many as there are centroids, whatever the data.
    known = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()
    radius, cuts = np.zeros(len(index.centroids), np.float32), np.zeros(len(index.centroids), np.int64)
    radius[known["list"]], cuts[known["list"]] = known["far"], -(-known["n"] // block)
    lists = spark.sparkContext.broadcast((radius, cuts))
    cut = F.pmod(F.xxhash64("id"), "cuts").cast("int").alias("cut")
    sizes = spark.createDataFrame([(int(c), int(cuts[c])) for c in known["list"]], "list int, cuts int")
    stored = placed.join(F.broadcast(sizes), "list").select("list", cut, "id", "vec", "code", "off")

    # Whole numbers up to 2^24 are exact in 32 bits.
    exact = np.float32 if 2 * d * 255**2 < 1 << 24 else np.float64

    def bound(held: pd.DataFrame) -> pd.DataFrame:
        """The k-th distance of each vector within its own block."""
        x = _matrix(held["vec"], d).astype(exact)
        norm, out = (x**2).sum(1), np.full(len(x), np.inf)
        if len(x) > k:
            at = 0
            for part in _portions(x, 512):
                out[at : at + 512] = np.partition(norm[None, :] + norm[at : at + 512, None] - 2 * part @ x.T, k, axis=1)[:, k]  # itself is the least
                at += 512
        return pd.DataFrame({"id": held["id"], "vec": held["vec"], "tau": out})

    bounded = ws.save(stored.groupBy("list", "cut").applyInPandas(bound, "id string, vec binary, tau double"), "bounded")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, (radius, cuts) = shared.value, lists.value
        for b in batches:
            for at, x in zip(range(0, len(b), 512), _portions(_matrix(b["vec"], d), 512)):
                x, part = x.astype(np.float32), b.iloc[at : at + 512]
                near = ix.nearest_lists(x, probes)
                away = np.sqrt(((x[:, None, :] - ix.centroids[near]) ** 2).sum(2)) if probes < 256 else np.stack([np.sqrt(((q - ix.centroids[c]) ** 2).sum(1)) for q, c in zip(x, near)])
                reach = np.sqrt(part["tau"].to_numpy())[:, None]
                i, j = np.nonzero((away - radius[near] <= reach + 0.01 + 1e-5 * away) & (cuts[near] > 0))
                c = near[i, j]
                turn = np.repeat(np.arange(len(i)), cuts[c])
                i, c, which = i[turn], c[turn], np.arange(len(turn)) - np.repeat(np.cumsum(cuts[c]) - cuts[c], cuts[c])
                yield pd.DataFrame({"list": c.astype(np.int32), "cut": which.astype(np.int32), "q_id": part["id"].to_numpy()[i], "q_vec": part["vec"].to_numpy()[i], "tau": part["tau"].to_numpy()[i]})

    asked = bounded.mapInPandas(ask, "list int, cut int, q_id string, q_vec binary, tau double")
    # A block meets its queries in portions, so that no task grows with a hot list; most lists have one.
    turns = F.greatest(F.lit(1), F.ceil(F.col("asked") / (8 * block))).cast("int")
    asked = ws.save(asked, "asked")
    wanted = asked.groupBy("list", "cut").agg(F.count("*").alias("asked")).select("list", "cut", turns.alias("turns"))
    wanted = ws.save(wanted, "wanted")  # a row per block
    stored = stored.join(wanted, ["list", "cut"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asked = asked.join(F.broadcast(wanted.where("turns > 1")), ["list", "cut"], "left").withColumn("turn", F.pmod(F.xxhash64("q_id", F.lit(1)), F.coalesce("turns", F.lit(1))).cast("int"))

    def search(key: tuple, held: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        ix, out = shared.value, []
        if len(held):
            order = np.argsort(held["id"].to_numpy(dtype=object))
            ids, x = held["id"].to_numpy(dtype=object)[order], _matrix(held["vec"], d)[order].astype(np.int32)
            code, off = _matrix(held["code"], len(ix.codebooks))[order], held["off"].to_numpy()[order]
            centre = ix.centroids[int(key[0])]
            qid, q, tau = ask["q_id"].to_numpy(dtype=object), _matrix(ask["q_vec"], d), ask["tau"].to_numpy()
            for at, part in zip(range(0, len(q), 256), _portions(q, 256)):
                limit = tau[at : at + 256]
                low = ix.distances(part.astype(np.float32) - centre, code) - off
                i, j = np.nonzero(low <= (np.sqrt(limit) * 1.0001 + 0.05)[:, None])
                dist = ((part[i].astype(np.int32) - x[j]) ** 2).sum(1)
                good = np.flatnonzero((dist <= limit[i]) & (qid[at + i] != ids[j]))
                # Places are in the order of ids.
                good = good[_k_best(i[good], j[good], dist[good], k)]
                out.append(pd.DataFrame({"id": qid[at + i[good]], "near": ids[j[good]], "dist": dist[good].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype=str), "near": pd.Series(dtype=str), "dist": pd.Series(dtype=np.int64)})

    keys = ["list", "cut", "turn"]
    right = asked.select(*[F.col(c).alias(f"q_{c}") for c in keys], "q_id", "q_vec", "tau")
    hits = stored.select(*keys, "id", "vec", "code", "off").groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(search, "id string, near string, dist bigint")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "near"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_samples(samples: DataFrame, d: int, top: float, step: float, k: int, ws: Workspace, **how) -> DataFrame:
    """The ``k`` nearest samples of each sample: id, near, dist.

    ``samples`` has id, vec (array of numbers), at. Usable vectors have ``d``
    values, each from 0 to ``top``, taken to the nearest whole ``step``, of which there may be 255. Rows with a null id or an
    unusable vector are left out; of several usable rows of an id the latest
    holds. Samples with equal vectors are searched once: for each vector its
    k + 1 smallest ids stand in, which is all that a k-nearest list can need.
    """
    if round(top / step) > 255:
        raise ValueError("more than 255 steps don't fit into a byte")
    usable = samples.where("id is not null and vec is not null").where((F.size("vec") == d) & F.forall("vec", lambda x: F.coalesce((x >= 0) & (x <= top), F.lit(False))))
    one = usable.groupBy("id").agg(F.max(F.struct("at", "vec")).alias("r")).select("id", F.col("r.vec").alias("vec"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.rint(np.stack(b["vec"].to_numpy()) / step).astype(np.uint8) if len(b) else np.empty((0, d), np.uint8)
            yield pd.DataFrame({"id": b["id"], "vec": [r.tobytes() for r in x]})

    byid = ws.save(one.mapInPandas(pack, "id string, vec binary"), "usable")
    ranked = byid.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = ws.save(ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vec", "ids"), "classes")
    near = nearest(classes.select(F.col("rep").alias("id"), "vec"), d, k, ws, **how)
    near = near.select(F.col("id").alias("rep"), F.col("near").alias("rep2"), "dist")
    members = byid.join(classes.select("vec", "rep"), "vec").select("id", "rep")
    there = near.join(classes.select(F.col("rep").alias("rep2"), "ids"), "rep2").select("rep", "dist", "ids")
    own = classes.where(F.size("ids") > 1).select("rep", F.lit(0).cast("bigint").alias("dist"), "ids")
    # Per class: the k + 1 best candidates, few enough to travel as one array.
    flat = there.unionByName(own).select("rep", "dist", F.explode("ids").alias("near"))
    best = flat.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("dist", "near"))).where(F.col("r") <= k + 1)
    offers = ws.save(best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("dist", "near"))).alias("offers")), "offers")
    picked = members.join(offers, "rep").select("id", F.slice(F.filter("offers", lambda o: o["near"] != F.col("id")), 1, k).alias("o"))
    return picked.select("id", F.explode("o").alias("o")).select("id", F.col("o.near").alias("near"), F.col("o.dist").alias("dist"))
