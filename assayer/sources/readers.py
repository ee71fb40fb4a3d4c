"""Scans with explicit contracts; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import strip


class ContractError(ValueError):
    pass


def csv_contract(spark: SparkSession, path: str, *schemas: T.StructType) -> DataFrame:
    """CSV whose header, as a set, equals one of ``schemas``; a byte-order mark is tolerated, empty cells read as ''."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if len(set(raw.columns)) != len(raw.columns):
        raise ContractError(f"{path}: duplicate columns")
    for s in schemas:
        if set(s.names) == set(raw.columns):
            cast = lambda f: F.coalesce(F.col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType)
            return raw.select(*[cast(f).alias(f.name) for f in s.fields])
    want = " or ".join(str(sorted(s.names)) for s in schemas)
    raise ContractError(f"{path}: columns {sorted(raw.columns)} are not {want}")


def csv_some(spark: SparkSession, path: str, columns: list[str], required: list[str] | None = None) -> DataFrame:
    """CSV of which only ``required`` must be there; other listed columns become '' where they lack."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if lost := set(required or []) - set(raw.columns):
        raise ContractError(f"{path}: missing required column(s): {', '.join(sorted(lost))}")
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def checked(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that break one with the names of those broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    d = df.withColumn("_broken", broken)
    return d.where(F.size("_broken") == 0).drop("_broken"), d.where(F.size("_broken") > 0).withColumn("rule", F.array_join("_broken", ",")).drop("_broken")


def unit_rules() -> dict[str, Column]:
    return {
        "from a source": F.expr("in_topics OR in_drawings"),
        "settled or under review": F.expr("(status = 'settled') = (NOT review_required)"),
        "review has a reason": F.expr("NOT review_required OR coalesce(review_reason, '') <> ''"),
        "contested status and category agree": F.expr("(status = 'floor_ambiguous') = (discrepancy_category = 'floor_ambiguous')"),
    }


def run_rules() -> dict[str, Column]:
    return {
        "completed after started": F.expr("completed_at >= started_at"),
        "succeeded has items and no error": F.expr("(run_status = 'succeeded') = (items IS NOT NULL AND error IS NULL)"),
        "failure keeps its text": F.expr("run_status NOT IN ('parse_failed', 'validation_failed') OR raw_text IS NOT NULL"),
        "digest": F.expr("source_sha256 RLIKE '^[0-9a-f]{64}$'"),
    }


def action_rules() -> dict[str, Column]:
    return {
        "known action": F.expr("action IN ('approve', 'edit', 'reject', 'clear')"),
        "approve and reject carry no payload": F.expr("action NOT IN ('approve', 'reject') OR payload IS NULL"),
        "edit has payload and reason": F.expr("action <> 'edit' OR (payload IS NOT NULL AND coalesce(trim(reason), '') <> '')"),
        "reject has a reason": F.expr("action <> 'reject' OR coalesce(trim(reason), '') <> ''"),
    }


def proposal_rules() -> dict[str, Column]:
    return {
        "ends differ and are named": F.expr("coalesce(child, '') <> '' AND coalesce(parent, '') <> '' AND child <> parent"),
        "no separator in names": F.expr("NOT contains(child, '|') AND NOT contains(parent, '|')"),
        "equipment ref": F.expr("ref_type IN ('airRef', 'chilledWaterRef', 'hotWaterRef', 'condenserWaterRef')"),
    }


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    """JSON lines; strict: a blank or bad line fails the read, else such lines are left out."""
    lines = spark.read.text(path)
    d = lines.withColumn("_v", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("_ok", F.try_parse_json("value").isNotNull() & F.col("value").startswith("{"))
    if strict:
        return d.where(F.coalesce("_ok", F.lit(False)) | F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 80))).isNull()).select("_v.*")
    return d.where("_ok").select("_v.*")


def snapshot(spark: SparkSession, path: str, schema: T.StructType, scopes: DataFrame | None = None, **keys) -> DataFrame:
    """A partitioned snapshot, or the folders of it that are asked for: ``keys`` (snapshot_version, property_id, floor) by value, ``scopes`` by a
    frame of some of these columns, up to ``SCOPES`` of them. Other folders aren't read. Keys are texts, whatever they
    look like. A folder that doesn't exist gives no rows."""
    named = ["snapshot_version", "property_id", "floor"]
    wide = T.StructType([f for f in schema.fields if f.name not in named] + [T.StructField(c, T.StringType()) for c in named if c in schema.names])
    d = spark.read.schema(wide).parquet(path)
    for c, value in keys.items():
        d = d.where(F.col(c) == str(value))
    if scopes is not None:
        on = [c for c in named if c in scopes.columns]
        asked = scopes.select(*[F.col(c).cast("string") for c in on]).dropna().distinct()
        few = asked.limit(SCOPES + 1).collect()
        named_by = F.concat_ws("\0", *on)
        d = d.where(named_by.isin(["\0".join(r) for r in few])) if len(few) <= SCOPES else d.join(asked, on, "left_semi")
    return d.select(*schema.names)


#: scopes by which folders are chosen before the scan; more are met in a shuffle
SCOPES = 10_000


def edge_document(spark: SparkSession, path: str) -> DataFrame:
    """{relationships: [...]} or a bare list, one row an edge."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.explode("relationships").alias("e")).select("e.*") if "relationships" in d.columns else d


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def listing(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """(key, size) under a path; contents aren't read."""
    d = files(spark, path).select(F.col("path").alias("key"), F.col("length").alias("size"))
    return d.where(~F.col("key").contains(without)) if without else d


def names(df: DataFrame, column: str, seq: str = "seq") -> DataFrame:
    """Distinct names that aren't blank, in the order of their first place. None at all is an error."""
    d = df.withColumn("name", strip(F.col(column))).where("name <> ''")
    if d.limit(1).count() == 0:
        raise ContractError(f"no equipment names found in column '{column}'")
    return d.groupBy("name").agg(F.min(seq).alias(seq)).orderBy(seq)


def topic_names(df: DataFrame, column: str) -> DataFrame:
    """The names of a column that aren't blank, every one of them, as often as it stands."""
    return df.select(strip(F.col(column)).alias("topic_name")).where("topic_name <> ''")


def type_library(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {type, point_types: [...], equip_tags: [...]}: one row a type, both lists as they stand."""
    schema = T.StructType.fromDDL("type string, point_types array<string>, equip_tags array<string>")
    return json_lines(spark, path, schema, strict=True)


def topics(df: DataFrame, property_id, prefix: str) -> DataFrame:
    return df.where((F.col("property_id") == property_id) & F.col("topic_name").startswith(f"{prefix}/")).orderBy("topic_name")


def catalog(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(name, type, labels array) to (equipment(name, type), aliases(alias, name), names with several types)."""
    types = rows.groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("types"))
    aliases = rows.select(F.explode("labels").alias("alias"), "name").where("alias <> ''").distinct()
    return types.where(F.size("types") == 1).select("name", F.get("types", F.lit(0)).alias("type")), aliases, types.where(F.size("types") > 1)


def jdbc(spark: SparkSession, url: str, dbtable: str, **options) -> DataFrame:
    """Table of a database; filters on it are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
