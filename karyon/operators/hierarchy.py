"""Parent-child links to full hierarchies.

Subtree sizes are summed upward, then ranges of preorder numbers are handed down:
a node's begins where those of its elder siblings end. Both go by doubled steps, so
that a line of depth d takes about log2(d) rounds of shuffle joins, and only over
the nodes whose line hasn't ended yet. Everything else is read off the ranges: the
root is the last one to begin, the depth counts the ranges that are still open,
ancestors and descendants are those whose ranges hold one another. A node whose
line never ends lies on a loop or below one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyon.plans.distributed import salted_prefix
from karyon.plans.workspace import Workspace


def _links(nodes: DataFrame) -> DataFrame:
    """One row per node, its parent null unless the parent has a row."""
    ids = nodes.select("grp", F.col("id").alias("parent"), F.lit(True).alias("there"))
    return (
        nodes.join(ids, ["grp", "parent"], "left")
        .select("grp", "id", F.when(F.col("there"), F.col("parent")).alias("parent"))
    )


def hierarchy(nodes: DataFrame, ws: Workspace, salts: int = 64, bin_size: int = 1 << 16) -> DataFrame:
    """Root, depth, subtree size and preorder range of each node.

    ``nodes`` has ``grp`` (which forest), ``id`` (unique in its grp) and
    ``parent``. Result: grp, id, parent, root, depth, size, pre, last, looped.

    * ``parent`` is null where it is null or has no row of its own (a root).
    * ``pre`` numbers the nodes of a grp from 0, tree after tree, each node before
      its descendants; these are the nodes of its grp with ``pre`` in (pre, last].
    * On a loop or below one: ``looped``, ``depth`` -1, ``root`` the smallest id
      of the loop, ``size``, ``pre`` and ``last`` null. A node that is its own
      parent is a loop.
    * Rows with a null id are left out; of several rows with one id any one must
      have been chosen before. An empty table gives an empty result; other
      columns are ignored.
    """
    base = ws.save(_links(nodes.where("id is not null").select("grp", "id", "parent")), "base")
    sizes, stuck = _sizes(base, ws)
    held = base.join(stuck.select("grp", "id"), ["grp", "id"], "left_anti") if stuck is not None else base
    size = held.join(sizes, ["grp", "id"], "left").select("grp", "id", "parent", (F.coalesce("gain", F.lit(0)) + 1).alias("size"))
    placed = _preorder(ws.save(size, "sizes"), ws, salts)
    trees = _read_ranges(placed, ws, bin_size)
    return trees if stuck is None else trees.unionByName(_loops(stuck, ws))


def _sizes(base: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Numbers of descendants (grp, id, gain; no row for leaves), and the nodes whose line never ends.

    A node hands what it has gathered to the node 2^k steps up in round k. Only
    nodes with so long a line are in the round; what all gain is summed at the end.
    """
    active = ws.save(base.where("parent is not null").select("grp", "id", "parent", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size")), "active", n=F.count(F.lit(1)))
    rounds, n = [], active.facts["n"]
    while n:
        rounds.append(active)
        gain = active.groupBy("grp", F.col("ptr").alias("id")).agg(F.sum("size").alias("gain"))
        up = active.select("grp", F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        # The line of a node without a match ends here.
        moved = active.join(up.hint("merge"), ["grp", "ptr"]).join(gain, ["grp", "id"], "left")
        active = ws.save(moved.select("grp", "id", "parent", F.col("ptr2").alias("ptr"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "active", n=F.count(F.lit(1)))
        left = active.facts["n"]
        if left == n:  # no line ended in this round, so none ever will
            break
        n = left
    none = base.limit(0).select("grp", F.col("parent").alias("ptr"), F.lit(0).cast("long").alias("size"))
    handed = reduce(DataFrame.unionByName, [r.select("grp", "ptr", "size") for r in rounds], none)
    total = handed.groupBy("grp", F.col("ptr").alias("id")).agg(F.sum("size").alias("gain"))
    return total, active.select("grp", "id", "parent") if n else None


def _preorder(sized: DataFrame, ws: Workspace, salts: int) -> DataFrame:
    """Add ``pre``: sizes of elder siblings (trees are siblings too), summed along the line.

    Each round reads all nodes' sums, but moves and writes only nodes whose line
    hasn't ended.
    """
    kids = salted_prefix(sized, ["grp", "parent"], F.col("id"), F.col("size"), "before", salts)
    own = F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    step = ws.save(kids.select("grp", "id", "parent", "size", F.col("parent").alias("ptr"), own.alias("pre")), "walk", active=F.count("ptr"))
    done = []
    while True:
        done.append(step.where("ptr is null"))
        active = step.where("ptr is not null")
        if not step.facts["active"]:
            break
        known = reduce(DataFrame.unionByName, [*done, active])
        seen = known.select("grp", F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("pre").alias("pre2"))
        moved = active.join(seen.hint("merge"), ["grp", "ptr"])
        step = ws.save(moved.select("grp", "id", "parent", "size", F.col("ptr2").alias("ptr"), (F.col("pre") + F.col("pre2")).alias("pre")), "walk", active=F.count("ptr"))
    return reduce(DataFrame.unionByName, done).select("grp", "id", "parent", "size", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


def _read_ranges(placed: DataFrame, ws: Workspace, bin_size: int) -> DataFrame:
    """Add root and depth: the last root to begin at or before a node, and how many ranges are open there.

    Every number of a grp begins one range, so the open ones are the number less the
    ranges that have ended. Ends are counted per number, then per bin; a bin of
    numbers is one window, and its totals are carried on over the bins, of which
    there are as many as nodes / ``bin_size``.
    """
    null = F.lit(None).cast("long")
    ends = placed.groupBy("grp", (F.col("last") + 1).alias("pre")).agg(F.count("*").alias("ends"))
    ends = ws.save(ends, "ends")  # read twice
    begin = placed.select("grp", "id", "parent", "size", "pre", "last", F.when(F.col("parent").isNull(), F.col("id")).alias("first"), F.lit(0).cast("long").alias("ends"))
    events = begin.unionByName(ends.select("grp", null.alias("id"), null.alias("parent"), null.alias("size"), "pre", null.alias("last"), null.alias("first"), "ends"))
    events = events.withColumn("bin", F.floor(F.col("pre") / bin_size))
    before = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = events.groupBy("grp", "bin").agg(F.sum("ends").alias("e"), F.max_by("first", F.when(F.col("first").isNotNull(), F.col("pre"))).alias("f"))
    carried = totals.select("grp", "bin", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("carry"), F.last("f", ignorenulls=True).over(before).alias("carry_first"))
    # Ends of a number come before its beginning.
    within = Window.partitionBy("grp", "bin").orderBy("pre", F.col("id").isNotNull())
    open_ = events.withColumn("ended", F.sum("ends").over(within)).withColumn("root", F.last("first", ignorenulls=True).over(within)).where("id is not null")
    return open_.join(carried, ["grp", "bin"]).select(
        "grp", "id", "parent", F.coalesce("root", "carry_first").alias("root"),
        (F.col("pre") - F.col("ended") - F.col("carry")).alias("depth"),
        "size", "pre", "last", F.lit(False).alias("looped"),
    )


def _loops(rest: DataFrame, ws: Workspace) -> DataFrame:
    """Smallest id of the loop that each unprocessed node runs into.

    After k rounds ``low`` is the least id of the 2^k nodes from a node on, and
    ``ptr`` the node after them. Once a round changes no ``low``, it is that of the
    whole loop for nodes on loops; once a round leaves the number of different
    ``ptr`` alone, these are just the nodes on loops.
    """
    walk = ws.save(rest.select("grp", "id", "parent", F.col("parent").alias("ptr"), F.col("id").alias("low")), "loop")
    ends = None
    while True:
        seen = walk.select("grp", F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        met = walk.join(seen.hint("merge"), ["grp", "ptr"])
        walk = ws.save(
            met.select("grp", "id", "parent", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("new")),
            "loop",
            drop=walk,
            new=F.max(F.col("new").cast("int")),
        )
        now = walk.select("grp", "ptr").distinct().count()
        if now == ends and not walk.facts["new"]:
            break
        ends = now
    seen = walk.select("grp", F.col("id").alias("ptr"), F.col("low").alias("low2"))
    null = F.lit(None).cast("long")
    return walk.join(seen.hint("merge"), ["grp", "ptr"]).select(
        "grp", "id", "parent", F.col("low2").alias("root"), F.lit(-1).cast("long").alias("depth"),
        null.alias("size"), null.alias("pre"), null.alias("last"), F.lit(True).alias("looped"),
    )


def _pairs(tree: DataFrame, of: DataFrame, bin_size: int) -> DataFrame:
    """grp, id, depth and descendant of each node of ``of`` and each node in its range, itself included.

    The range join runs on (grp, number div bin_size), so one large tree is spread
    over its bins.
    """
    wide = of.select("grp", "id", "depth", "pre", "last", F.explode(F.sequence(F.floor(F.col("pre") / bin_size), F.floor(F.col("last") / bin_size))).alias("bin"))
    low = tree.select("grp", F.floor(F.col("pre") / bin_size).alias("bin"), F.col("pre").alias("at"), F.col("id").alias("descendant"))
    return wide.join(low, ["grp", "bin"]).where("at >= pre and at <= last").select("grp", "id", "depth", "descendant")


def paths(tree: DataFrame, sep: str = "/", bin_size: int = 4096) -> DataFrame:
    """grp, id, path: the ids from the root to the node, joined by ``sep``.

    Ancestors are the nodes whose range holds the node's number. Looped nodes have a
    null path. The result has as many ids as there are (ancestor, node) pairs; no
    group is larger than a line is deep.
    """
    held = tree.where("not looped")
    line = _pairs(held, held, bin_size).groupBy("grp", F.col("descendant").alias("id")).agg(F.array_sort(F.collect_list(F.struct("depth", F.col("id").cast("string").alias("name")))).alias("line"))
    found = line.select("grp", "id", F.array_join(F.transform("line", lambda x: x["name"]), sep).alias("path"))
    return found.unionByName(tree.where("looped").select("grp", "id", F.lit(None).cast("string").alias("path")))


def descendants(tree: DataFrame, of: DataFrame, bin_size: int = 4096) -> DataFrame:
    """(grp, id, descendant) for the nodes of ``of`` (grp, id), by preorder range.

    Looped nodes have no descendants here.
    """
    held = tree.where("not looped")
    want = held.join(of.select("grp", "id").distinct(), ["grp", "id"], "left_semi").where("last > pre")
    return _pairs(held, want, bin_size).where("id != descendant").select("grp", "id", "descendant")
