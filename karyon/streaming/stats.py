"""Variant statistics over calls that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame

from karyon.operators.aggregation import variant_stats


def streaming_variant_stats(calls: DataFrame, n_samples: int, n_alleles: int = 2) -> DataFrame:
    """The aggregate of :func:`variant_stats` on a streaming table, for output mode
    ``update`` or ``complete``. Its state is one row of sums per variant; each call
    must arrive once."""
    return variant_stats(calls, n_samples, n_alleles)
