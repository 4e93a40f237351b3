import random

from pyspark.sql import functions as F

from karyon.llm.splits import assign_splits, connected_components, entity_components


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_match_union_find(spark, ws):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)] + [("hub", f"leaf{i}") for i in range(100)] + [("self", "self"), ("hub", "leaf1"), ("x", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string"), ws).collect()}
    assert got == union_find([e for e in edges if None not in e])


def test_splits_keep_entities_together(spark, ws):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        fam = f"f{rng.randrange(900)}" if rng.random() > 0.05 else None
        rows.append((i, fam, f"m{i if rng.random() > 0.02 else rng.randrange(50)}" if rng.random() > 0.03 else None, "old"))
    rows += [(10_000 + i, "hot", None, "old") for i in range(2000)]  # a third of the rows share one entity
    df = spark.createDataFrame(rows, "row_key long, fam string, mem string, split string")
    out = assign_splits(df, ["fam", "mem"], ws).cache()
    assert out.count() == len(rows) and out.where("split is null or component is null").count() == 0
    for c in ("fam", "mem"):
        assert out.where(f"{c} is not null").groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r["count"] / len(rows) for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03


def test_empty_and_unlinked(spark, ws):
    empty = spark.createDataFrame([], "row_key long, fam string, mem string")
    assert assign_splits(empty, ["fam", "mem"], ws).count() == 0
    assert entity_components(empty, ["fam", "mem"], ws).count() == 0
    lone = spark.createDataFrame([(1, None, None), (2, None, "m"), (3, "f", "m")], "row_key long, fam string, mem string")
    comp = {r.row_key: r.component for r in assign_splits(lone, ["fam", "mem"], ws).collect()}
    assert comp[2] == comp[3] != comp[1]
