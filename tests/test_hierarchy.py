import random

from karyon.operators.hierarchy import descendants, hierarchy, paths


def brute(links):
    out = {}
    for v in links:
        seen, at = [], v
        while at not in seen:
            seen.append(at)
            up = links[at]
            if up is None or up not in links:
                break
            at = up
        else:
            out[v] = (min(seen[seen.index(at):]), -1)
            continue
        out[v] = (seen[-1], len(seen) - 1)
    return out


def make(spark, links, grp="g"):
    return spark.createDataFrame([(grp, k, v) for k, v in links.items()], "grp string, id long, parent long")


def test_random_forest_with_loops(spark, ws):
    rng = random.Random(4)
    links = {i: (rng.choice([None, rng.randrange(1, i), i - 1]) if i > 1 else None) for i in range(1, 200)}
    links |= {500: 501, 501: 502, 502: 500, 503: 500, 504: 503, 600: 600, 700: 9999}
    tree = hierarchy(make(spark, links), ws, salts=3, bin_size=32)
    rows = {r.id: r for r in tree.collect()}
    assert {k: (r.root, r.depth) for k, r in rows.items()} == brute(links)
    kids = {}
    for k, v in links.items():
        if v in links:
            kids.setdefault(v, []).append(k)

    def below(v):
        return [x for c in kids.get(v, []) for x in (c, *below(c))]

    for k, r in rows.items():
        if r.depth >= 0:
            assert r.size == len(below(k)) + 1
            inside = {o.id for o in rows.values() if o.root == r.root and not o.looped and r.pre < o.pre <= r.last}
            assert inside == set(below(k))
        else:
            assert r.looped and r.size is None and r.pre is None
    p = {r.id: r.path for r in paths(tree, bin_size=16).collect()}
    assert p[500] is None and p[700] == "700"
    deep = max((r for r in rows.values()), key=lambda r: r.depth)
    chain = [int(x) for x in p[deep.id].split("/")]
    assert len(chain) == deep.depth + 1 and all(links[b] == a for a, b in zip(chain, chain[1:]))
    of = make(spark, {1: None}).select("grp", "id")
    assert sorted(r.descendant for r in descendants(tree, of, bin_size=16).collect()) == sorted(below(1))


def test_long_line_and_hot_parent(spark, ws):
    links = {i: i - 1 if i else None for i in range(300)} | {1000 + i: 0 for i in range(500)}
    rows = {r.id: r for r in hierarchy(make(spark, links), ws, salts=4, bin_size=100).collect()}
    assert rows[299].depth == 299 and rows[0].size == 800 and rows[1000].depth == 1
    assert len({r.pre for r in rows.values()}) == 800


def test_empty_nulls_and_clashing_columns(spark, ws):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "grp string, id long, parent long")
    assert hierarchy(empty, ws).count() == 0
    odd = make(spark, {1: None, 2: 1}).unionByName(spark.createDataFrame([("g", None, 1)], "grp string, id long, parent long"))
    odd = odd.withColumn("root", F.lit("x")).withColumn("size", F.lit(None).cast("string")).withColumn("ptr", F.lit(1))
    assert {(r.id, r.root, r.depth) for r in hierarchy(odd, ws).collect()} == {(1, 1, 0), (2, 1, 1)}


def test_queries_give_paths_and_descendants_of_all(spark, tmp_path):
    from __spark_entry__ import queries

    at = "timestamp '2020-01-01'"
    kin = f"select id as kin_row, id, father, cast(0 as bigint) as mother, {at} as recorded_at from values (1L, 0L), (2L, 1L), (3L, 2L), (4L, 1L), (5L, 6L), (6L, 5L) as t(id, father)"
    spark.sql(kin).write.parquet(f"{tmp_path}/kin_pedigree.parquet")
    spark.sql(f"select 1L as hk_row, 9L as indiv_id, cast(null as bigint) as sire_id, {at} as recorded_at").write.parquet(f"{tmp_path}/hk_pedigree.parquet")
    got = {(r.line, r.id): r.path for r in queries()["p3_paths"](spark, str(tmp_path)).collect()}
    father = {1: "1", 2: "1/2", 3: "1/2/3", 4: "1/4", 5: None, 6: None}
    assert got == {("father", k): v for k, v in father.items()} | {("mother", k): str(k) for k in father} | {("sire", 9): "9"}
    below = {(r.tab, r.line, r.id, r.descendant) for r in queries()["p3_descendants"](spark, str(tmp_path)).collect()}
    assert below == {("kin_pedigree", "father", a, b) for a, b in ((1, 2), (1, 3), (1, 4), (2, 3))}
