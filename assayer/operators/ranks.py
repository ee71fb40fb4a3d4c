"""Places of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def placed(df: DataFrame, groups: list[str], *order: Column | str, name: str = "place", save: Callable | None = None) -> DataFrame:
    """``df`` with each row's place within its group, from 1, as a window of row numbers gives it.

    No task holds a group: rows are sorted over ranges of (group, order), and what stands in the ranges before is added to a row's
    place in its own. Rows that tie in ``order`` are told apart by a hash of the row. The sorted rows are written once, by ``save``;
    then each range's groups are counted, and those counts are all that is summed up. Null groups are one group.
    """
    save = save or Scratch()
    by = [F.asc(c) for c in groups] + [F.expr(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*df.columns)
    at = save(df.repartitionByRange(*by, tie).sortWithinPartitions(*by, tie).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = at.groupBy(*groups, "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    spans = spans.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(groups)], F.col("_range").alias("_r"), "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(groups)]
    met = at.join(spans, [F.col("_range") == F.col("_r"), *same])
    return met.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_low") + 1).cast("int").alias(name))
