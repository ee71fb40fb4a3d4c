"""Sinks: fixed columns, refusal to overwrite unless asked, versioned tables published by one pointer."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..operators.ranks import placed


def snapshot_order(*columns: str) -> list[Column]:
    """The order of snapshot rows: each column without regard to case, then as it is."""
    return [F.asc(c) for name in columns for c in (F.lower(name), F.col(name))]


def write_csv(df: DataFrame, path: str, columns: list[str], overwrite: bool = False, order: list[str] | None = None) -> None:
    """Booleans as true/false, lists joined by ';', empty text as an empty cell. With ``order`` rows stand in ``snapshot_order`` over all
    files, whose names follow it."""
    def cell(c):
        kind = df.schema[c].dataType.simpleString()
        return (F.array_join(c, ";") if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)

    d = df.orderBy(*snapshot_order(*order)) if order else df
    d.select(*map(cell, columns)).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


SNAPSHOT_KEYS = ("snapshot_version", "property_id", "floor")


def write_snapshot(df: DataFrame, path: str, by=SNAPSHOT_KEYS, overwrite: bool = False, order: list[str] | None = None) -> None:
    """Parquet in folders by the snapshot's keys. With ``order``, the rows of a folder stand in ``snapshot_order`` over its files;
    rows are dealt by ranges of keys and order, so a folder of any size is written by many tasks."""
    keys = [c for c in by if c in df.columns]
    if order:
        ranges = [*map(F.asc, keys), *snapshot_order(*order)]
        df = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: list[str], buckets: int, overwrite: bool = False) -> None:
    """A table of the warehouse in ``buckets`` by the columns ``by``, sorted by them, one file a bucket. Tables with the same ``by`` and
    number of buckets meet on these columns without a shuffle; the number is chosen so that a bucket of the largest of them
    fits a task."""
    d = df.repartition(buckets, *by)
    d.write.mode("overwrite" if overwrite else "errorifexists").format("parquet").bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def document(edges: DataFrame, header: dict, notes: DataFrame | None = None) -> DataFrame:
    """One row: header fields and the nested edges as JSON. For one floor's edges; tables stay the primary form."""
    body = edges.agg(F.sort_array(F.collect_list(F.struct(*edges.columns))).alias("relationships"))
    if notes is not None:
        body = body.withColumn("_k", F.lit(1)).join(notes.agg(F.collect_list(F.struct(*notes.columns)).alias("review_notes")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return body.withColumns({k: F.lit(v) for k, v in header.items()}).select(F.to_json(F.struct(*header, *body.columns)).alias("document"))


def write_documents(rows: DataFrame, header: dict, path: str, order: str = "seq", name: str = "relationships") -> None:
    """One JSON document for each (property, floor) that rows have: header fields, then the rows in order as the list ``name``.

    A document is a folder of ``path`` whose part files, one after another, are its text, a row a line. Rows stream from sorted
    ranges to the files; none is gathered. A floor of any size goes through as many tasks as it has ranges.
    """
    scope = [c for c in ("property_id", "floor") if c in rows.columns]
    if not scope:
        raise ValueError("documents are told apart by property_id and floor")
    own = [c for c in rows.columns if c not in scope]
    at = placed(rows, scope, F.asc(order))
    counts = at.groupBy(*scope).agg(F.max("place").alias("_n"))
    lines = at.join(counts, scope).select(*scope, "place", F.concat(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), F.when(F.col("place") < F.col("_n"), ",").otherwise("")).alias("value"))
    top = "{" + "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in header.items()) + f"{json.dumps(name)}:["
    ends = counts.select(*scope, F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(top).alias("value")), F.struct((F.col("_n") + 1).alias("place"), F.lit("]}").alias("value")))).alias("e"))
    every = lines.unionByName(ends.select(*scope, "e.*"))
    every.repartitionByRange(*scope, "place").sortWithinPartitions(*scope, "place").select(*scope, "value").write.partitionBy(*scope).text(path)


def write_counted(df: DataFrame, path: str, metrics: dict[str, Column], log: str | None = None, run: dict | None = None) -> dict:
    """Writes ``df`` and counts ``metrics`` (aggregates) in the same pass. With ``log``, the counts are appended there as a row, with
    the values of ``run``. A metric of no rows is what its aggregate gives for none."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("append").parquet(path)
    told = dict(seen.get)
    if log:
        df.sparkSession.createDataFrame([Row(**(run or {}), **told)]).coalesce(1).write.mode("append").json(log)
    return told


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a version's folder and then the pointer table that names it; readers follow the newest pointer, so a failed
    write is never seen and a repeated one changes nothing."""
    path = f"{root}/versions/{version}"
    df.write.mode("overwrite").parquet(path)
    pointer = df.sparkSession.createDataFrame([(version, path)], "version string, path string").withColumn("published_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return path


def published(spark, root: str) -> DataFrame:
    row = spark.read.parquet(f"{root}/pointer").orderBy(F.desc("published_at"), F.desc("version")).first()
    return spark.read.parquet(row["path"])


def export_outbox(spark, corrections: DataFrame, pool_path: str, key: str = "correction_id") -> int:
    """Appends corrections that the pool lacks; a rerun appends nothing."""
    try:
        pool = spark.read.parquet(pool_path)
        new = corrections.join(pool.select(key).distinct(), key, "left_anti")
    except Exception as e:  # no pool yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = corrections
    return write_counted(new.dropDuplicates([key]), pool_path, {"n": F.count(F.lit(1))})["n"]
