"""File inventories, raw-copy plans, quality gates, tiles and listing sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import file_type, image_class, image_quality, object_key, tile_starts


def manifest(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, length, content) to size, SHA-256, type and status."""
    kind = file_type(F.col("path"))
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("file_type"), F.when(kind == "unsupported", "unsupported").otherwise("discovered").alias("status"))


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG header; null for other bytes."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    at = lambda p: F.when(png, F.conv(F.hex(F.substring(content, p, 4)), 16, 10).cast("int"))
    return at(17), at(21)


def preservation_plan(files: DataFrame, listing: DataFrame, prefix: str) -> DataFrame:
    """Target key of each file: planned, conflict (exists already), skipped (unsupported), duplicate or rejected path. Rejected paths have no
    key and meet nothing; how often a key stands is counted before it is looked up."""
    d = files.withColumn("object_key", object_key(prefix, F.col("file_type"), F.col("relative_path")))
    keyed = d.where("object_key IS NOT NULL")
    twice = keyed.groupBy("object_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    have = listing.select(F.col("key").alias("object_key"), F.lit(True).alias("_there")).distinct()
    status = (
        F.when(F.col("file_type") == "unsupported", "skipped").when(F.col("_n").isNotNull(), "duplicate").when(F.col("_there"), "conflict").otherwise("planned")
    )
    told = keyed.join(twice, "object_key", "left").join(have, "object_key", "left").withColumn("status", status)
    rejected = d.where("object_key IS NULL").withColumn("status", F.lit("rejected"))
    return told.select(*d.columns, "status").unionByName(rejected)


def with_plan(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    return manifest.join(plan.select("relative_path", "object_key", F.col("status").alias("plan_status")), "relative_path", "left")


def prepared(files: DataFrame) -> dict[str, DataFrame]:
    """files(relative_path, file_type, width, height) as images that pass, deferred documents, failures and unsupported files."""
    ok, why = image_quality(F.col("width"), F.col("height"))
    d = files.withColumn("quality_flag", ok).withColumn("quality_reason", why).withColumn("image_class", image_class(F.col("width").cast("long") * F.col("height")))
    image = F.col("file_type").isin("png", "jpeg")
    return {"prepared": d.where(image & F.col("quality_flag")), "failures": d.where(image & ~F.col("quality_flag")), "deferred": d.where(F.col("file_type") == "pdf"), "unsupported": d.where(~image & (F.col("file_type") != "pdf"))}


def file_quality(pages: DataFrame, keys=("relative_path",)) -> DataFrame:
    """A file passes if all its pages do; without pages it doesn't."""
    return pages.groupBy(*keys).agg(F.coalesce(F.bool_and("quality_flag"), F.lit(False)).alias("quality_flag"))


def tile_boxes(images: DataFrame, tile: int = 2500, overlap: int = 128) -> DataFrame:
    """image rows (width, height) to boxes left, top, right, bottom that cover them."""
    d = images.withColumn("left", F.explode(tile_starts(F.col("width"), tile, overlap))).withColumn("top", F.explode(tile_starts(F.col("height"), tile, overlap)))
    return d.withColumn("right", F.least(F.col("left") + tile, "width")).withColumn("bottom", F.least(F.col("top") + tile, "height"))


def inked(tiles: DataFrame, least: float = 0.0015) -> DataFrame:
    return tiles.where(F.col("ink_fraction") >= least)


def sync_plan(remote: DataFrame, local: DataFrame, extensions=("png", "jpg", "jpeg", "pdf")) -> DataFrame:
    """remote(key, size) against local(filename, size): new, changed, up_to_date or skipped."""
    name = F.regexp_extract("key", r"([^/]+)$", 1)
    r = remote.withColumn("filename", name).withColumn("_ext", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)))
    j = r.join(local.select("filename", F.col("size").alias("_size")), "filename", "left")
    status = F.when(~F.col("_ext").isin(*extensions), "skipped").when(F.col("_size").isNull(), "new").when(F.col("_size") != F.col("size"), "changed").otherwise("up_to_date")
    return j.withColumn("status", status).drop("_ext", "_size")
