"""Filling fixed-capacity containers with items.

The histogram of item lengths, at most ``capacity`` bins whatever the number of
items, is all that the driver sees. Combinations of up to three lengths that fill
a window below the capacity are enumerated, all of them; non-negative least
squares says how often to repeat each; what the rounded counts leave over is
solved again, and in the end packed greedily, on the histogram too. Items then find their place by their rank among the items of
their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyon.plans.distributed import salted_prefix
from karyon.plans.workspace import Workspace


#: How the byte-level vocabularies cut text into pieces. Fixed value.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def combinations(hist: np.ndarray, capacity: int, waste: int, times: int, most: int, turn: int = 0) -> np.ndarray:
    """All (a, b, c) of present lengths, a >= b, with a + b + ``times`` * c = ``capacity`` - ``waste``.

    With ``times`` 0 there are only (a, 0, 0) and (a, b, 0). With 1, a >= b >= c.
    Where there would be more than ``most``, b is taken in strides, from another
    beginning in each ``turn``.
    """
    present, total = np.flatnonzero(hist), capacity - waste
    present = present[present > 0]
    have = np.zeros(capacity + 1, bool)
    have[present] = have[0] = True
    stride = max(1, -(-len(present) ** 2 // (12 * most)))
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in present[present <= total]:
        room = total - a
        if times == 0:
            b = np.array([room] if room <= a and have[room] else [], np.int64)
        else:
            low = (room + 1) // 2 if times == 1 else 1
            b = present[np.searchsorted(present, low) : np.searchsorted(present, min(a, room), "right")][turn % stride :: stride]
            b = b[(room - b) % times == 0]
            b = b[have[(room - b) // times]]
        firsts.append(np.full(len(b), a))
        seconds.append(b)
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    return np.stack([a, b, (total - a - b) // max(1, times)], 1)


def nnls(combos: np.ndarray, times: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative repeats of each combination whose lengths come closest to ``target``, by weighted least squares.

    A combination has each of its lengths as often as ``times`` says for its place.
    Projected gradients with momentum; the matrix, with as many entries a column as
    a combination has places, is never built.
    """
    w = weight.copy()
    w[0] = 0  # no length
    flat, scale = combos.ravel(), np.sqrt(((w[combos] * times) ** 2).sum(1))

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, ((x / scale)[:, None] * times).ravel(), len(w)) * w

    def repeats(r: np.ndarray) -> np.ndarray:
        return ((w * r)[combos] * times).sum(1) / scale

    v = np.ones(len(combos))
    for _ in range(8):
        v = repeats(lengths(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(repeats(lengths(v))))
    x = y = np.zeros(len(combos))
    t, due = 1.0, target * w
    for _ in range(rounds):
        z = np.maximum(0, y - step * repeats(lengths(y) - due))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / t2 * (z - x)
        x, t = z, t2
    return x / scale


def solved(left: np.ndarray, capacity: int, waste: int, times: int, most: int, turn: int) -> Counter:
    """Containers by one solution of the least squares; their lengths are taken from ``left``.

    Repeats are rounded along their running sum, so that many small ones count as
    much as few large ones. Longer lengths weigh more and go first: short ones are
    easy to place afterwards.
    """
    made: Counter = Counter()
    combos = combinations(left, capacity, waste, times, most, turn)
    if not len(combos):
        return made
    each = np.array([1, 1, times])
    x = nnls(combos, each, left.astype(float), np.sqrt(np.arange(len(left)) / capacity + 0.02))
    order = np.lexsort((-x, -combos[:, 0]))
    count = np.diff(np.floor(np.concatenate([[0.5], np.cumsum(x[order]) + 0.5]))).astype(np.int64)
    for j in np.flatnonzero(count):
        combo = tuple(sorted((int(n) for n, m in zip(combos[order[j]], each) if n for _ in range(m)), reverse=True))
        need = Counter(combo)
        k = min(int(count[j]), *(int(left[n]) // m for n, m in need.items()))
        if k > 0:
            made[combo] += k
            for n, m in need.items():
                left[n] -= m * k
    return made


def best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Containers by best fit, longest first; equal containers are made together."""
    left, made = left.copy(), Counter()
    while left.any():
        room, take, spare = capacity, [], left.copy()
        n = int(np.flatnonzero(left)[-1])
        while n > 0:
            k = min(int(spare[n]), room // n)
            take += [n] * k
            spare[n] -= k
            room -= k * n
            below = np.flatnonzero(spare[: room + 1])
            n = int(below[-1]) if len(below) else 0
        need = Counter(take)
        times = min(int(left[n] // k) for n, k in need.items())
        made[tuple(take)] += times
        for n, k in need.items():
            left[n] -= k * times
    return made


def plan(hist: np.ndarray, capacity: int, window: int = 8, most: int = 1 << 20) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths, repeats) of containers that use up the histogram exactly, and how many of them the least squares made.

    Combinations leave 0, 1, 2, 4, ... up to ``window`` of a container unused; their
    third length comes once, twice, four times and so on. What rounding leaves over
    is solved again as long as that makes two containers of a hundred; the rest goes
    by best fit. Where short lengths are scarce, pairs must come first, where they
    are plenty, triples that fill wholly: the better of both plans is taken.
    """
    wastes = [0] + [1 << i for i in range(capacity.bit_length()) if 1 << i <= min(window, capacity - 1)]
    repeats = [0, *(1 << i for i in range(capacity.bit_length()))]
    plans = []
    for first in (repeats[:1], repeats[1:2]):
        left, used = hist.astype(np.int64).copy(), Counter()
        left[0] = 0
        steps = [(t, 0) for t in first] + [(t, w) for t in repeats for w in wastes]
        for times, waste in steps:
            turn = 0
            while left.any():
                made = solved(left, capacity, waste, times, most, turn)
                used.update(made)
                turn += 1
                if made.total() < 0.02 * max(1, used.total()) or not made:
                    break
        by_squares = used.total()
        used.update(best_fit(left, capacity))
        plans.append((used.total(), -by_squares, sorted(used.items(), reverse=True)))
    total, by_squares, made = min(plans)
    return made, -by_squares


def count_tokens(texts: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Add ``tokens``: the length of ``text`` in tokens of a byte-level BPE file of ranks.

    ``vocabulary`` is a path or URI that the driver can read; the file is sent to the executors.
    """
    texts.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rpartition("/")[2]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import regex
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        cut, seen = regex.compile(pattern), {}
        for b in batches:
            sizes = np.zeros(len(b), np.int64)
            for i, t in enumerate(b["text"]):
                total = 0
                # Pieces recur: the pattern cuts a text into pieces that are encoded apart.
                for piece in cut.findall(t) if t else ():
                    n = seen.get(piece)
                    if n is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        n = seen[piece] = len(bpe.encode_ordinary(piece))
                    total += n
                sizes[i] = total
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": sizes})

    return texts.select("doc_id", "text").mapInPandas(read, "doc_id bigint, tokens bigint")


def pack(items: DataFrame, capacity: int, ws: Workspace, salts: int = 64) -> DataFrame:
    """Place of each item: doc_id, piece, tokens, container, offset.

    ``items`` has doc_id (unique) and tokens. An item above the capacity is split:
    its first pieces fill containers of their own, the rest is packed like an
    item. An item without tokens (null, 0 or less) has one row with null container
    and offset. Repeated rows are items of their own. Rows with a null doc_id are
    left out, other columns ignored. An empty table gives an empty result.
    """
    spark = ws.spark
    base = items.where("doc_id is not null").select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    pieces = base.select("doc_id", F.explode(F.when(F.col("tokens") > 0, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / capacity) - 1)).otherwise(F.array(F.lit(0).cast("long")))).alias("piece"), F.col("tokens").alias("all"))
    pieces = pieces.withColumn("tokens", F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity)).select("doc_id", "piece", "tokens")
    table = ws.save(pieces, "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in table.groupBy("tokens").count().collect():  # capacity + 1 rows at most
        hist[r["tokens"]] = r["count"]
    rows, container, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, times in plan(hist, capacity)[0]:
        offset = 0
        for n, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((n, int(used[n]), int(used[n]) + k * times, k, container, offset))
            used[n] += k * times
            offset += n * k
        container += times
    runs = spark.createDataFrame(rows, "tokens bigint, low bigint, high bigint, per bigint, base bigint, start bigint") if rows else None
    if runs is None:
        null = F.lit(None).cast("long")
        return table.select("doc_id", "piece", "tokens", null.alias("container"), null.alias("offset"))
    ranked = salted_prefix(table.withColumn("key", F.struct("doc_id", "piece")), ["tokens"], F.col("key"), F.lit(1), "rank", salts)
    # Runs are as many as combinations of lengths in use, not as items.
    met = ranked.drop("key").alias("i").join(F.broadcast(runs.alias("r")), (F.col("i.tokens") == F.col("r.tokens")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    nth = F.col("rank") - F.col("low")
    return met.select(
        "doc_id", "piece", F.col("i.tokens").alias("tokens"),
        (F.col("base") + F.floor(nth / F.col("per"))).alias("container"),
        (F.col("start") + (nth % F.col("per")) * F.col("i.tokens")).alias("offset"),
    )
