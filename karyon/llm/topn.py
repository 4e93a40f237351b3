"""Top N items within every group, reading only row groups that can matter.

The table is first clustered: a group is in one file, a hot one in portions by a
hash of its items. Within a file rows are ordered by the size class of their group
and by score, so that the best rows of all groups of a class come first. Each file
is then read by row groups, best scores first. A row group is skipped on its
statistics once every group that it can contain holds N items strictly better
than its best score.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace

log = logging.getLogger(__name__)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, with the names that Hadoop has for object stores."""
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def cluster(latest: DataFrame, n: int, ws: Workspace, path: str, row_group_bytes: int, portion_rows: int, few: int = 100_000) -> None:
    """Write the rows of each (grp, part) to one file, ordered by (class, score, item).

    Groups of over ``portion_rows`` rows are cut into parts of about that many. They
    are as many as the table has times ``portion_rows`` at most; up to ``few`` of
    them are broadcast, more are joined. ``size`` is the number of rows of (grp,
    part), ``class`` the power of two by which it exceeds ``n``.
    """
    hot = latest.groupBy("grp").count().where(F.col("count") > portion_rows)
    hot = ws.save(hot.select("grp", F.ceil(F.col("count") / portion_rows).cast("int").alias("parts")), "hot", n=F.count(F.lit(1)))
    cut = latest.join(F.broadcast(hot) if hot.facts["n"] <= few else hot, "grp", "left")
    spread = cut.withColumn("part", F.pmod(F.xxhash64("item"), F.coalesce("parts", F.lit(1))).cast("int")).select("grp", "part", "item", "score").repartition("grp", "part")
    sized = spread.withColumn("size", F.count("*").over(Window.partitionBy("grp", "part")))
    class_ = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / n))).cast("int").alias("class")
    (
        sized.select("grp", "part", "item", "score", "size", class_)
        .sortWithinPartitions("class", "score", "item")
        .write.option("compression", "snappy")
        .option("parquet.block.size", str(row_group_bytes))
        .parquet(path)
    )


class _Class:
    """What is held of one size class of a file: rows are met in the order of their scores."""

    def __init__(self, rows: int):
        self.rows, self.met = rows, 0
        self.code: dict[tuple, int] = {}
        self.count = np.zeros(0, np.int64)
        self.full, self.worst = 0, -np.inf

    def best(self, t: pd.DataFrame, n: int) -> np.ndarray:
        """Which of the next rows are among the ``n`` best of their group."""
        keys = list(zip(t["grp"], t["part"]))
        codes = np.empty(len(keys), np.int64)
        for i, (k, size) in enumerate(zip(keys, t["size"])):
            c = self.code.get(k)
            if c is None:
                c = self.code[k] = len(self.code)
                self.met += size
            codes[i] = c
        self.count = np.concatenate([self.count, np.zeros(len(self.code) - len(self.count), np.int64)])
        rank = self.count[codes] + pd.Series(codes).groupby(codes).cumcount().to_numpy()
        self.count += np.bincount(codes, minlength=len(self.code))
        last = rank == n - 1
        self.full += int(last.sum())
        if last.any():
            self.worst = max(self.worst, float(t["score"].to_numpy()[last].max()))
        return rank < n

    def done(self, low: float) -> bool:
        """Whether no row of score ``low`` or more can count: all groups were met and hold n strictly better rows."""
        return self.met == self.rows and self.full == len(self.code) and self.worst < low


def best_of_file(uri: str, n: int) -> tuple[pd.DataFrame, int, int]:
    """The n best of each (grp, part) of a file; row groups there are and were read.

    Classes hold all groups of like size, of which a row group holds some: to be
    better than all of the class is to be better than all that it contains.
    """
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as handle:
        file = pq.ParquetFile(handle)
        meta, at = file.metadata, {name: i for i, name in enumerate(file.schema_arrow.names)}
        groups, rows = [], {}
        for i in range(meta.num_row_groups):
            g = meta.row_group(i)
            c, s = g.column(at["class"]).statistics, g.column(at["score"]).statistics
            groups.append((c.min, c.max, s.min, i))
            mixed = file.read_row_group(i, columns=["class"])["class"].to_numpy() if c.min != c.max else np.full(g.num_rows, c.min)
            for k, m in zip(*np.unique(mixed, return_counts=True)):
                rows[int(k)] = rows.get(int(k), 0) + int(m)
        held = {k: _Class(m) for k, m in rows.items()}
        kept, read = [], 0
        for first, last, low, i in groups:  # in the order of (class, best score), as they were written
            if first == last and first > 0 and held[first].done(low):
                continue
            read += 1
            t = file.read_row_group(i).to_pandas()
            if last == 0:  # no group has more than n rows
                kept.append(t)
                continue
            for k, mine in t.groupby("class"):
                kept.append(mine if k == 0 else mine[held[int(k)].best(mine, n)])
    none = pd.DataFrame({"grp": pd.Series(dtype=str), "item": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
    return (pd.concat(kept)[["grp", "item", "score"]] if kept else none), len(groups), read


def top_n(latest: DataFrame, n: int, ws: Workspace, row_group_bytes: int = 1 << 18, portion_rows: int = 100_000) -> DataFrame:
    """The ``n`` smallest scores of each group, ties by the smaller item.

    ``latest`` has grp, item (strings, one row per pair) and score (double); it is
    read twice. Result: grp, item, score, rank; its ``facts`` say how many row groups
    there were and were read. Groups with fewer items keep all. Rows with a null grp,
    item or score are left out, and those whose score is NaN; a repeated row counts
    as often as it comes; an empty table gives an empty result. Other columns are
    ignored.
    """
    spark = ws.spark
    path = ws.path("clustered")
    usable = latest.where("grp is not null and item is not null and score is not null and not isnan(score)").select("grp", "item", "score")
    cluster(usable, n, ws, path, row_group_bytes, portion_rows)
    files = spark.read.parquet(path).inputFiles()
    shared = spark.sparkContext.broadcast(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                t, groups, met = best_of_file(shared.value[k], n)
                yield pa.RecordBatch.from_arrays([pa.array([None], f.type) for f in schema][:3] + [pa.array([groups]), pa.array([met])], schema=schema)
                t = t.assign(groups=0, read=0)
                yield from pa.Table.from_pandas(t, schema, preserve_index=False).to_batches()

    schema = pa.schema([("grp", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("groups", pa.int64()), ("read", pa.int64())])
    one_each = spark.range(0, len(files), 1, max(1, len(files)))
    best = ws.save(one_each.mapInArrow(read, "grp string, item string, score double, groups bigint, read bigint"), "best", groups=F.sum("groups"), read=F.sum("read"))
    log.info("top %d: %s of %s row groups read", n, best.facts["read"], best.facts["groups"])
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("score", "item"))
    out = best.where("grp is not null").select("grp", "item", "score", rank.alias("rank")).where(F.col("rank") <= n)
    out.facts = best.facts
    return out
