"""Position exposure kept up to date as lists arrive: sums by input position merge, so a stream needs three numbers a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exposure_counters(lists: DataFrame, k: int) -> DataFrame:
    """A stream of (input array, output array) to running sums by input position; for the complete or update mode."""
    rows = lists.select(F.posexplode("input").alias("input_position", "item_id"), "output")
    n = F.size("output")
    shown = ((F.array_position("output", F.col("item_id")) > 0) & (F.array_position("output", F.col("item_id")) <= k)).cast("int")
    return rows.groupBy("input_position").agg(F.count(F.lit(1)).alias("lists"), F.sum(shown).alias("exposed"), F.sum(F.least(F.lit(k), n) / n).alias("expected"))
