"""Known values of a matrix, row by row: what they cost grows with the values, not with the columns.

A variant is known in few of many samples, so rows come as runs of (row, column, value)
and sums over pairs of columns take only the pairs that a row has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Nanoseconds of one product alone and of one in a matrix product, to choose between the two. Measured once; only speed depends on them.
ALONE_NS, TOGETHER_NS = 20.0, 0.25


def runs(values: DataFrame, row: str, col: str, *more: str) -> DataFrame:
    """``values`` with the known ones of a row behind each other, in the order of columns.

    Values that lie by row already are not shuffled again.
    """
    n = F.row_number().over(Window.partitionBy(row).orderBy(col))
    return values.select(F.col(row).cast("bigint").alias("row"), F.col(col).cast("int").alias("col"), *more, n.alias("__n"))


@dataclass
class Block:
    """Whole rows: ``row`` and ``ptr`` by row, ``at`` (place of the row) and ``col`` by value; other columns by name."""

    row: np.ndarray
    ptr: np.ndarray
    at: np.ndarray
    col: np.ndarray
    of: dict[str, np.ndarray]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums by row of numbers by value (or of vectors by value)."""
        return np.add.reduceat(x, self.ptr[:-1], axis=0)


def whole_rows(batches: Iterator[pa.RecordBatch], values: int = 1 << 17) -> Iterator[Block]:
    """Batches of :func:`runs` as blocks of about ``values`` values that end with a row."""
    held: list[pa.RecordBatch] = []
    n, least = 0, values

    def block(t: pa.Table) -> Block:
        of = {c: t[c].to_numpy() for c in t.column_names}
        first = of.pop("__n") == 1
        ptr = np.append(np.flatnonzero(first), len(first))
        row = of.pop("row")
        return Block(row[ptr[:-1]], ptr, np.cumsum(first) - 1, of.pop("col").astype(np.int64), of)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(t["__n"].to_numpy() == 1)[-1])
        if cut:
            yield block(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        n -= cut
        least = max(values, 2 * n)
    if n:
        yield block(pa.Table.from_batches(held).combine_chunks())


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each of the counts, behind each other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def packed_runs(values: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """``row``, ``idx`` and ``val`` as :func:`karyon.plans.packing.packed_rows` gives them, without collecting in the aggregate."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_rows(batches):
            ends = pa.array(b.ptr.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (b.col.astype(np.int32), b.of["value"])]
            yield pa.RecordBatch.from_arrays([pa.array(b.row), *lists], [row, "idx", "val"])

    known = values.where(F.col(value).isNotNull()).select(row, col, F.col(value).cast("double").alias("value"))
    return runs(known, row, col, "value").mapInArrow(pack, f"{row} bigint, idx array<int>, val array<double>")


Weights = Callable[[Block], dict[str, list[np.ndarray]]]


def sparse_gram(rows: DataFrame, weights: Weights, names: list[str], n: int, undefined: bool = False, tile: int = 2048) -> DataFrame:
    """Sum over rows of products of two columns' values: i, j (both orders) and one column per name.

    ``rows`` is what :func:`runs` gives. ``weights`` turns a block into arrays by value
    per name; the name's sum of i and j is that of w_i w_j over the rows that know both,
    added over the arrays. Pairs of columns are cut into tiles: a row is sent to the pairs
    of tiles it has values in, and a task holds the sums of one pair of tiles. Pairs
    that no row has are left out, unless ``undefined`` asks for them, with sums of 0.
    """
    spark = rows.sparkSession
    tiles = -(-n // tile)
    pairs = tiles * (tiles + 1) // 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    salts = min(parts, 6) if pairs == 1 else 1  # partial sums are as large as the result

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, b in enumerate(whole_rows(batches)):
            got = weights(b)
            w = np.stack([x for k in names for x in got[k]])
            many = ",".join(str(len(got[k])) for k in names)
            t = b.col // tile
            start = np.flatnonzero(np.r_[True, (b.at[1:] != b.at[:-1]) | (t[1:] != t[:-1])])
            size, of, mine = np.diff(np.append(start, len(t))), b.at[start], t[start]
            last = np.searchsorted(of, of, "right")  # the row's pieces end here
            count = last - np.arange(len(start))
            left = np.repeat(np.arange(len(start)), count)
            right = left + spread(count)
            key = mine[left] * tiles + mine[right]
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
            out: list[tuple] = []
            for x, y in zip(edges[:-1], edges[1:]):
                p, q = left[order[x:y]], right[order[x:y]]
                ti, tj = int(mine[p[0]]), int(mine[q[0]])
                send = []
                for pieces, at in ((p, ti),) if ti == tj else ((p, ti), (q, tj)):
                    values = np.repeat(start[pieces], size[pieces]) + spread(size[pieces])
                    send += [size[pieces].astype(np.int32).tobytes(), (b.col[values] - at * tile).astype(np.int16).tobytes(), w[:, values].tobytes()]
                out.append((ti, tj, (turn + ti + tj) % salts, many, *send, *[b""] * (6 - len(send))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)

    fields, kinds = ["ti", "tj", "salt", "many", "ls", "lc", "lw", "rs", "rc", "rw"], [pa.int32()] * 3 + [pa.string()] + [pa.binary()] * 6
    sent = rows.mapInArrow(cut, "ti int, tj int, salt int, many string, ls binary, lc binary, lw binary, rs binary, rc binary, rw binary")
    if undefined:
        none = spark.range(tiles * tiles).select(F.floor(F.col("id") / tiles).cast("int").alias("ti"), (F.col("id") % tiles).cast("int").alias("tj")).where("ti <= tj")
        sent = sent.unionByName(none.select("ti", "tj", F.lit(0).alias("salt"), F.lit("").alias("many"), *[F.lit(b"").alias(c) for c in fields[4:]]))

    def add(total: np.ndarray, ti: int, tj: int, r: dict) -> None:
        many = [int(x) for x in r["many"].split(",")]
        ls, lc = np.frombuffer(r["ls"], np.int32), np.frombuffer(r["lc"], np.int16).astype(np.int64)
        lw = np.frombuffer(r["lw"]).reshape(sum(many), -1)
        if ti == tj:
            rs, rc, rw = ls, lc, lw
            count = np.repeat(ls, ls) - spread(ls)
            first = np.arange(len(lc))
        else:
            rs, rc, rw = np.frombuffer(r["rs"], np.int32), np.frombuffer(r["rc"], np.int16).astype(np.int64), np.frombuffer(r["rw"]).reshape(sum(many), -1)
            count, first = np.repeat(rs, ls), np.repeat(np.cumsum(rs) - rs, ls)
        high, wide = total.shape[1:]
        products, owner = int(count.sum()), np.repeat(np.arange(len(names)), many)
        if products * ALONE_NS > high * wide * (1 + len(ls) * TOGETHER_NS):
            at = [np.repeat(np.arange(len(s)), s) for s in (ls, rs)]
            for low in range(0, len(ls), 256):
                here = [(a >= low) & (a < low + 256) for a in at]
                for k, x, y in zip(owner, lw, rw):
                    l, m = np.zeros((min(256, len(ls) - low), high)), np.zeros((min(256, len(ls) - low), wide))
                    l[at[0][here[0]] - low, lc[here[0]]], m[at[1][here[1]] - low, rc[here[1]]] = x[here[0]], y[here[1]]
                    total[k] += l.T @ m
            return
        flat = total.reshape(len(names), -1)
        ends = np.cumsum(count)
        low = 0
        while low < len(count):
            high_ = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20))))
            c = count[low:high_]
            i = np.repeat(np.arange(low, high_), c)
            j = np.repeat(first[low:high_], c) + spread(c)
            cell = lc[i] * wide + rc[j]
            for k, x, y in zip(owner, lw, rw):
                np.add.at(flat[k], cell, x[i] * y[j])
            low = high_

    def close(total: np.ndarray, ti: int, tj: int) -> Iterator[pa.RecordBatch]:
        for low in range(0, total.shape[1], 256):
            part = total[:, low : low + 256]
            keep = np.ones(part.shape[1:], bool) if undefined else (part != 0).any(0)
            if ti == tj:
                keep = np.triu(keep, low)
            i, j = np.nonzero(keep)
            sums = [x[i, j] for x in part]
            i, j = i + low + ti * tile, j + tj * tile
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, *sums)], ["i", "j", *names])
            other = i != j
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (j, i, *sums)], ["i", "j", *names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for at in range(b.num_rows):
                key = tuple(b.column(c)[at].as_py() for c in range(3))
                if key != now:
                    if now is not None:
                        yield from close(total, *now[:2])
                    now, total = key, np.zeros((len(names), min(n, (key[0] + 1) * tile) - key[0] * tile, min(n, (key[1] + 1) * tile) - key[1] * tile))
                r = {c: b.column(x + 3)[at] for x, c in enumerate(fields[3:])}
                if r["many"].as_py():
                    add(total, *key[:2], {c: v.as_py() if c == "many" else v.as_buffer() for c, v in r.items()})
        if now is not None:
            yield from close(total, *now[:2])

    schema = "i bigint, j bigint, " + ", ".join(f"{k} double" for k in names)
    out = sent.repartition(parts, "ti", "tj", "salt").sortWithinPartitions("ti", "tj", "salt").mapInArrow(meet, schema)
    return out.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names]) if salts > 1 else out
