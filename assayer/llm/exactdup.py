"""Exact duplicates by radix partitioning on the leading bytes of what two texts have not compared yet.

Every level cuts the next run of bytes off the texts that still share all bytes before it, and counts each (group, run).
A run that occurs once is a text of its own; a run shorter than the level's width ends its texts, so they are equal;
the other groups go on behind the run. Runs grow from level to level, so a text of n bytes takes some log(n) levels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, settled_folder

#: bytes of the first level's run, factor from level to level, longest run
FIRST, FACTOR, LONGEST = 64, 8, 1 << 20
#: bytes of a level's shared runs that are sent to every task; above them the join is a shuffle, whose hot keys are split at run time
CARRIED_BYTES = 32 << 20


def _written(df: DataFrame, base: str) -> str:
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _level(rows: DataFrame, base: str, width: int, last: bool) -> tuple[DataFrame, bool]:
    """``rows`` (row, doc_id, text_sha256, grp, rest) one run further, with keep_id, group_size, kept and open, and whether
    any group stays open. ``last`` is whether a group whose texts end here may be closed."""
    cut = rows.withColumn("run", F.expr(f"substring(rest, 1, {width})"))
    # combined before the shuffle: a group of any size sends one row a task
    runs = cut.groupBy("grp", "run").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("top_row")
    ).where("n > 1")
    path = _written(runs.select("*", F.monotonically_increasing_id().alias("next")), base)
    shared = rows.sparkSession.read.parquet(path)
    ended = F.length("run") < width if last else F.lit(False)
    size, more = shared.agg(F.sum(F.length("run") + 48), F.max(~ended)).first()
    joined = cut.join(F.broadcast(shared) if (size or 0) <= CARRIED_BYTES else shared, ["grp", "run"], "left")
    alone = F.col("n").isNull()
    done = alone | ended
    return joined.select(
        "row", "doc_id", "text_sha256",
        F.when(~done, F.col("next")).alias("grp"),
        F.when(~done, F.expr(f"substring(rest, {width + 1}, length(rest))")).alias("rest"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top_row"))).alias("kept"),
        (~done).alias("open"),
    ), bool(more)


def exact_duplicates(docs: DataFrame, first: int = FIRST, factor: int = FACTOR, longest: int = LONGEST) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. No digest decides anything: ``text_sha256`` is
    output only. Of equal texts the row with the largest doc_id stays. Rows of one text that share that doc_id (repeated
    rows) count in group_size, and exactly one of them is kept; a doc_id of null stays only where its group has no other,
    and keep_id is null then. Very long texts are compared whole, in runs of at most ``longest`` bytes. Empty
    tables give no rows; other columns of ``docs`` are not read.

    The first level sends ``first`` bytes of each text through the shuffle; whole texts move only where the runs that
    groups share exceed ``CARRIED_BYTES``. What the levels still compare lies in the shared folder and goes
    when the next level is written.
    """
    spark, base = docs.sparkSession, f"{settled_folder(docs.sparkSession)}/exactdup-{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(text, 256).alias("text_sha256"), F.lit(0).cast("long").alias("grp"), text.cast("binary").alias("rest"),
    )
    width, levels, before = first, [], None
    while True:
        # rows get their numbers when the first level is written, so that level closes single texts only
        split, more = _level(rows, base, width, last=bool(levels))
        path, schema = f"{base}/level-{len(levels)}", split.schema
        split.write.partitionBy("open").parquet(path)
        levels.append(path)
        if before:
            removed(spark, f"{before}/open=true")
        if not more:
            break
        before, width = path, min(width * factor, longest)
        rows = spark.read.schema(schema).parquet(path).where("open").select("row", "doc_id", "text_sha256", "grp", "rest")
    out = None
    for path in levels:
        part = spark.read.schema(schema).parquet(path).where("NOT open").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        out = part if out is None else out.unionByName(part)
    return out


def oracle_sql() -> str:
    """The same result for DuckDB, by grouping whole texts."""
    return """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
