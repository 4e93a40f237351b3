"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace


def _facts() -> dict:
    h = F.xxhash64("u", "v")
    return {"n": F.count(F.lit(1)), "low": F.sum(h.bitwiseAND(0xFFFFFFFF)), "high": F.sum(F.shiftrightunsigned(h, 32))}


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Smallest node of each node's component, by alternating large-star and small-star.

    ``edges`` has string columns ``u`` and ``v``. Result: node, component, for each
    node of an edge; loops and repeated edges do no harm, edges with a null end
    are left out. Each step attaches neighbours to a minimum that is aggregated
    before the shuffle and written, one row per node: a node with any number of
    edges is never gathered, and the join's skew can be split.
    """
    pairs = edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    alone = pairs.where("u = v").select("u").distinct()
    now = ws.save(pairs.where("u > v").distinct(), "edges", **_facts())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.save(large, "large", drop=low)
        least = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hang = large.join(least, "u")
        small = hang.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = ws.save(small, "edges", drop=large, **_facts())
        ws.drop(least)
        done = after.facts == now.facts
        ws.drop(now)
        now = after
        if done:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = stars.unionByName(roots)
    return known.unionByName(alone.join(known, alone.u == known.node, "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component")))


def _first(entities: Sequence[str], key: str | None) -> Column:
    tags = [F.concat(F.lit(f"{c}:"), F.col(c)) for c in entities]
    return F.coalesce(*tags, *([F.concat(F.lit("row:"), F.col(key).cast("string"))] if key else []))


def entity_components(records: DataFrame, entities: Sequence[str], ws: Workspace) -> DataFrame:
    """node, component over the entities that stand first in a row.

    A row stands under its first known entity (``column:value``). The others are
    contracted: entities that share one are linked to the smallest of them, which
    is aggregated before the shuffle. An entity met under one other only gives no
    edge, so what the stars iterate over is small. Nodes without an edge are absent.
    """
    first = _first(entities, None)
    pairs = reduce(
        DataFrame.unionByName,
        [records.select(first.alias("k"), F.concat(F.lit(f"{c}:"), F.col(c)).alias("m")) for c in entities],
    ).where("m is not null and m != k").distinct()
    pairs = ws.save(pairs, "pairs")  # read three times
    low = ws.save(pairs.groupBy("m").agg(F.min("k").alias("v"), F.count("*").alias("n")), "low")
    shared = pairs.join(low.where("n > 1"), "m").where("k > v").select(F.col("k").alias("u"), "v")
    firsts = records.select(first.alias("m")).where("m is not null").distinct()
    standing = low.join(firsts, "m", "left_semi").select(F.col("m").alias("u"), "v")
    return connected_components(shared.unionByName(standing), ws)


def assign_splits(
    records: DataFrame,
    entities: Sequence[str],
    ws: Workspace,
    ratios: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    key: str = "row_key",
    large_share: float = 0.002,
    seed: str = "split",
) -> DataFrame:
    """Add ``component`` and ``split``: rows that share an entity, also through
    other rows, get one split.

    ``entities`` are string columns; equal values of different columns are
    different entities. ``key`` must be unique: a row without any entity is its
    own component. Components are hashed into ranges whose rows are proportional to
    ``ratios``, as nearly as one component allows. Those with over ``large_share`` of all rows (1 / large_share at most, so few
    enough to handle singly) would upset the proportions; they are placed first,
    each where most is lacking, and the ranges are those of what then lacks. So the
    ranges depend on all sizes: a component can change its split when the table grows.
    Existing columns ``component`` and ``split`` are replaced. An empty table
    stays empty.
    """
    base = records.drop("component", "split")
    comp = entity_components(base, entities, ws)
    tagged = base.select("*", _first(entities, key).alias("__first"))
    out = tagged.join(comp, tagged["__first"] == comp["node"], "left").withColumn("component", F.coalesce("component", "__first"))
    out = ws.save(out.drop("__first", "node"), "components")
    sizes = ws.save(out.groupBy("component").agg(F.count("*").alias("n")), "sizes", total=F.sum("n"))
    total = sizes.facts.get("total") or 0
    names = [r[0] for r in ratios]
    lack = {r: share * total for r, share in ratios}
    big = sizes.where(F.col("n") > large_share * total).orderBy(F.desc("n"), "component").collect() if total else []
    placed = {}
    for row in big:
        best = max(names, key=lambda r: (lack[r], -names.index(r)))
        placed[row["component"]] = best
        lack[best] -= row["n"]
    rest = {r: max(0.0, v) for r, v in lack.items()}
    at = F.xxhash64(F.lit(seed), "component").bitwiseAND((1 << _BITS) - 1)
    fixed = ws.spark.createDataFrame(list(placed.items()), "component string, placed string")
    small = sizes.join(F.broadcast(fixed), "component", "left_anti").select(at.alias("at"), "n")
    due, split = 0.0, None
    for r in names[:-1]:
        due += rest[r]
        edge = _edge(small, due)
        split = F.when(at < edge, r) if split is None else split.when(at < edge, r)
    split = split.otherwise(names[-1]) if split is not None else F.lit(names[-1])
    return out.join(F.broadcast(fixed), "component", "left").withColumn("split", F.coalesce("placed", split)).drop("placed")


_BITS = 52


def _edge(sizes: DataFrame, due: float, bins: int = 1 << 12) -> int:
    """The hash below which components have ``due`` rows together, as nearly as one component allows.

    ``sizes``: at (hash), n. Rows are summed in ``bins`` of the hash, then in as many
    of the bin where the edge lies, until one component is left there.
    """
    low, width, before = 0, 1 << _BITS, 0
    while width > 1:
        step = max(1, width // bins)
        here = sizes.where((F.col("at") >= low) & (F.col("at") < low + width)).groupBy(F.floor((F.col("at") - low) / step).alias("bin"))
        found = None
        for r in here.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("at").alias("first")).orderBy("bin").collect():  # ``bins`` rows at most
            if before + r["n"] > due:
                found = r
                break
            before += r["n"]
        if found is None:
            return low + width
        if found["k"] == 1:  # below it or with it, whatever is nearer
            return found["first"] + (1 if due - before > before + found["n"] - due else 0)
        low, width = low + int(found["bin"]) * step, step
    return low
