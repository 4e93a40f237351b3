import random

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from karyon.llm.topn import best_of_file, open_fs, top_n

S = "grp string, item string, score double, rank int"


def test_against_brute_force_with_hot_group(spark, ws):
    rng = random.Random(3)
    rows = [("hot", f"i{i:05d}", rng.randrange(1000) / 1000) for i in range(4000)]
    rows += [(f"g{rng.randrange(300):03d}", f"i{i:05d}", rng.randrange(20) / 20) for i in range(8000)]
    df = spark.createDataFrame([(*r, 9) for r in rows] + [(None, "x", 0.0, 9), ("g", None, 0.0, 9), ("g000", "n", float("nan"), 9), ("g000", "z", None, 9)], S)
    got = {}
    for r in top_n(df, 10, ws, row_group_bytes=4096, portion_rows=1000).collect():
        got.setdefault(r.grp, []).append((r.score, r["item"]))
    want = {}
    for g, i, s in rows:
        want.setdefault(g, []).append((s, i))
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:10] for g, v in want.items()}


def test_most_row_groups_are_skipped(spark, ws):
    """300 groups of about 400 rows, many to a row group, beside a hot one and small ones."""
    mid = spark.range(120_000).selectExpr("concat('g', cast(id % 300 as string)) grp", "lpad(cast(id as string), 8, '0') item", "pmod(xxhash64(id), 1000003) / 1000003d score")
    hot = spark.range(60_000).selectExpr("'hot' grp", "lpad(cast(id as string), 8, '0') item", "pmod(id * 7919, 60000) / 60000d score")
    few = spark.range(900).selectExpr("concat('s', cast(id % 300 as string)) grp", "cast(id as string) item", "id / 900d score")
    df = mid.union(hot).union(few)
    out = top_n(df, 10, ws, row_group_bytes=16 << 10, portion_rows=20_000)
    assert out.facts["groups"] > 40 and out.facts["read"] < 0.5 * out.facts["groups"]
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("score", "item"))).where("r <= 10")
    got = out.select("grp", "item", "score", "rank")
    assert got.count() == 300 * 10 + 10 + 900
    assert got.exceptAll(want).count() == 0


def test_object_store_names():
    assert type(open_fs("file:///tmp/x")[0]).__name__ == "LocalFileSystem"
    try:
        assert open_fs("s3a://bucket/a/b.parquet")[1] == "bucket/a/b.parquet"
    except (OSError, pa.ArrowException):
        pass  # built without it, or no network


def test_empty_and_small(spark, ws):
    assert top_n(spark.createDataFrame([], S), 3, ws).count() == 0
    rows = top_n(spark.createDataFrame([("", "b", 0.5, 1), ("", "a", 0.5, 1), ("é" * 5000, "x", 1.0, 1)], S), 1, ws).collect()
    assert {(r.grp[:1], r["item"]) for r in rows} == {("", "a"), ("é", "x")}
