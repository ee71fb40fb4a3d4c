"""Rows of files with the number they have in their file, however many splits it is read in.

A split's rows stand in order in one task, so a row's place is its place in its split and the rows of the splits before. Splits
are counted in one pass, and only rows that are to be named meet the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import ContractError, checked, csv_contract

PLACE = ["_file", "_block", "_at"]


def placed(df: DataFrame) -> DataFrame:
    """Rows as read from files, with the file, the split and the place in the task: what ``named`` asks for."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def splits(rows: DataFrame) -> DataFrame:
    """(_file, _block, _low, _before): each split's first place, and the rows in the file's splits before it."""
    own = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("_file", "_block", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def named(some: DataFrame, every: DataFrame, first: int = 1) -> DataFrame:
    """``some`` of the placed rows ``every``, with ``file`` and ``row``; a file's first row has the number ``first``."""
    row = (F.col("_before") + F.col("_at") - F.col("_low") + first).alias("row")
    columns = [c for c in some.columns if c not in PLACE]
    return some.join(splits(every), ["_file", "_block"]).select(F.col("_file").alias("file"), row, *columns)


def _refuse(bad: DataFrame, tell) -> None:
    """The first few bad rows by name, if there are any."""
    if rows := bad.orderBy("file", "row").limit(5).collect():
        raise ContractError("; ".join(tell(r) for r in rows))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, lines that aren't one: file, row, rule). A record is a line that holds one JSON object whose fields have the
    schema's types; blank lines are no records. Fields that the schema doesn't have are ignored, and missing ones are null."""
    lines = placed(spark.read.text(path))
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("_v", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rule = (
        F.when(F.trim("value") == "", "blank JSONL record")
        .when(F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{"), "not a JSON object")
        .when(F.col("_v._bad").isNotNull(), "fields of other types")
    )
    good = parsed.where(rule.isNull()).select(*[F.col("_v").getField(c).alias(c) for c in schema.names])
    return good, named(parsed.select(*PLACE, "value", rule.alias("rule")).where("rule IS NOT NULL"), lines)


def strict_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of JSON lines, or an error that names file and line of the first lines that aren't one."""
    good, bad = json_lines(spark, path, schema)
    _refuse(bad, lambda r: f"{r['file']}: {r['rule']} at line {r['row']}")
    return good


def csv_rows(spark: SparkSession, path: str, schema: T.StructType, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of a CSV with exactly the schema's columns, rows that break a rule: file, row, the cells as text, rule). Rows count from 2, as
    the header is row 1. A cell that isn't empty has to be of its column's type; ``rules`` hold for the typed row."""
    text = placed(csv_contract(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in schema.names])))
    typed = {f.name: F.col(f.name) if isinstance(f.dataType, T.StringType) else F.nullif(f.name, F.lit("")).try_cast(f.dataType) for f in schema.fields}
    d = text.select(*PLACE, F.struct(*schema.names).alias("_cells"), *[c.alias(n) for n, c in typed.items()])
    own = {f"{f.name} is no {f.dataType.simpleString()}": F.col(f"_cells.{f.name}").isin("") | F.col(f.name).isNotNull() for f in schema.fields if not isinstance(f.dataType, T.StringType)}
    good, bad = checked(d, {**own, **(rules or {})})
    return good.select(*schema.names), named(bad.select(*PLACE, "_cells.*", "rule"), text, first=2)


def strict_csv_rows(spark: SparkSession, path: str, schema: T.StructType, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows of a CSV, or an error that names file, row and rule of the first rows that break one."""
    good, bad = csv_rows(spark, path, schema, rules)
    _refuse(bad, lambda r: f"{r['file']}: CSV row {r['row']} failed validation: {r['rule']}")
    return good
