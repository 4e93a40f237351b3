"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace


def validity(parents: DataFrame) -> DataFrame:
    """One row per (tab, id): when it first came, and whether its last row withdrew it.

    ``parents`` has tab, id, at, seq (breaks ties of ``at``), state. Only fixed-size
    aggregates, so a key with any number of rows is combined before the shuffle.
    """
    return (
        parents.where("id is not null")
        .groupBy("tab", "id")
        .agg(F.min("at").alias("first_at"), F.max(F.struct("at", "seq", "state")).alias("l"))
        .select("tab", "id", "first_at", F.col("l.state").alias("last_state"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame, ws: Workspace, gone: str = "withdrawn") -> DataFrame:
    """References whose target is missing, deleted or came later.

    ``refs`` has tab, ref, rec_id, field, at; ``parents`` as in :func:`validity`.
    Both sides are partitioned and sorted by (tab, id) and merged as sorted
    streams (a sort-merge join). The parents' intervals are one row per key and are
    written first: a join of two plain shuffles is one whose hot targets Spark's
    skew join can split. Result: tab, rec_id, field, reason, at.

    Null references are no references. A reference with a null time is never
    late, nor is one to a target without any time. Repeated reference rows are
    each judged. An empty parent table makes every reference ``missing``. Other
    columns are ignored.
    """
    held = ws.save(validity(parents), "validity").hint("merge").select("tab", F.col("id").alias("ref"), "first_at", "last_state", F.lit(True).alias("there"))
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("last_state") == gone, "deleted")
        .when(F.col("first_at") > F.col("at"), "late")
    )
    return (
        refs.where("ref is not null")
        .select("tab", "ref", "rec_id", "field", "at")
        .join(held, ["tab", "ref"], "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("tab", "rec_id", "field", "reason", "at")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month of the referring row."""
    return orphans.groupBy("tab", "field", "reason", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
