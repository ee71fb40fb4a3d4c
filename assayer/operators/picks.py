"""Order-dependent picks and ordered sets; order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return first_per_key(df, keys, F.desc(seq))


def best_per_key(df: DataFrame, keys: list[str], score: str, seq: str = "seq") -> DataFrame:
    """Best score wins, ties to the first; ``first_seq`` is where the key was first seen."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("first_seq", F.min(seq).over(w))
    return first_per_key(out, keys, F.desc_nulls_last(score), F.asc(seq))


def ordered_distinct(value: Column, seq: Column) -> Column:
    """Aggregate: distinct non-blank values in the order of their first place.

    It lists what it is given: reduce the rows to one for each key and value, with the smallest seq, before.
    """
    pairs = F.sort_array(F.collect_list(F.when(F.coalesce(value, F.lit("")) != "", F.struct(seq.alias("s"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def first_by(value: Column, seq: Column, where: Column | None = None) -> Column:
    """Aggregate: value at the smallest seq, of the rows that satisfy ``where``."""
    return F.min_by(value, F.when(where, seq) if where is not None else seq)


def latest_n(df: DataFrame, key: str, n: int = 50, seq: str = "seq") -> DataFrame:
    """The last ``n`` rows after keeping the latest of each key."""
    return last_per_key(df, [key], seq).orderBy(F.desc(seq)).limit(n)


def top_examples(df: DataFrame, category: str, value: str, n: int = 3) -> DataFrame:
    """category, examples (first n distinct values in order), more (how many others). Each task keeps n values of a category before
    they meet, so a category may be of any size."""
    d = df.select(category, value).distinct()
    w = Window.partitionBy(category).orderBy(value)
    first = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    shown = first.groupBy(category).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("examples"))
    counts = d.groupBy(F.col(category).alias("_c")).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).cast("long").alias("more"))
    return shown.join(counts, F.col(category).eqNullSafe(F.col("_c"))).select(category, "examples", "more")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    names = [c for r in rows for c in r.columns]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in names])
