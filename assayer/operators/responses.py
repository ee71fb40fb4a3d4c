"""Model responses: strict parsing to typed rows, with a status for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical_key, single_json_object, unfenced
from .picks import best_per_key

EQUIPMENT = "struct<equipment: array<struct<raw_label: string, canonical_name: string, equipment_type: string, confidence: string>>>"
RELATIONSHIPS = "struct<relationships: array<struct<child: string, parent: string, ref_type: string, confidence: string, conflict: boolean, conflict_reason: string>>>"
RESPONSE_TYPES = ("AHU", "VAV", "VAVRH", "FCU", "OAVAV", "FPTU", "unknown")


def parsed(runs: DataFrame, schema: str = EQUIPMENT, field: str = "equipment", types=RESPONSE_TYPES) -> DataFrame:
    """runs(raw_text, ...) with ``items`` and run_status: parse_failed, validation_failed (also for an empty list) or succeeded."""
    d = runs.withColumn("_t", unfenced(F.col("raw_text"))).withColumn("_one", single_json_object(F.col("_t")))
    d = d.withColumn("_p", F.from_json("_t", schema)).withColumn("items", F.col(f"_p.{field}"))
    conf = lambda x: x["confidence"].try_cast("double")
    named = (lambda x: (F.coalesce(x["raw_label"], F.lit("")) != "") & x["equipment_type"].isin(*types)) if field == "equipment" else (lambda x: (F.coalesce(x["child"], F.lit("")) != "") & (F.coalesce(x["parent"], F.lit("")) != ""))
    good = F.forall("items", lambda x: F.coalesce(named(x) & conf(x).between(0, 1), F.lit(False)))
    status = (
        F.when(F.coalesce(F.col("_t"), F.lit("")) == "", "parse_failed").when(~F.col("_one"), "parse_failed")
        .when(F.col("items").isNull() | ~good | (F.size("items") == 0), "validation_failed").otherwise("succeeded")
    )
    return d.withColumn("run_status", status).drop("_t", "_one", "_p")


# The bound below which a candidate is reviewed, and the reason given.
LOW, LOW_REASON = 0.75, "low_confidence"


def flattened(runs: DataFrame, image: str = "image") -> DataFrame:
    """Succeeded runs to one row a unit of an image: best confidence, first place kept, low confidence flagged.

    Within an image a unit is told by the key of its proposed name, or of its label where none is proposed; a name without a
    token by its letters.
    """
    d = runs.where("run_status = 'succeeded'").select(image, F.posexplode("items").alias("seq", "e"))
    d = d.select(image, "seq", "e.raw_label", F.coalesce("e.canonical_name", F.lit("")).alias("llm_proposed_canonical_name"), "e.equipment_type", F.col("e.confidence").cast("double").alias("confidence"))
    label = F.coalesce(F.nullif("llm_proposed_canonical_name", F.lit("")), F.col("raw_label"))
    d = d.withColumn("_k", F.coalesce(canonical_key(label), F.upper(F.regexp_replace(label, r"\s+", ""))))
    low = F.col("confidence") < LOW
    return best_per_key(d, [image, "_k"], "confidence").drop("_k").withColumn("review_required", low).withColumn("review_reason", F.when(low, LOW_REASON).otherwise(""))


def tile_union(labels: DataFrame, keys=("image",)) -> DataFrame:
    """Candidates of all tiles by their canonical name without white space; the best confidence wins, the first of equals."""
    d = labels.withColumn("_k", F.regexp_replace(F.coalesce("canonical_name", F.lit("")), r"\s+", ""))
    return best_per_key(d, [*keys, "_k"], "confidence").drop("_k", "first_seq")


def unit_rows(df: DataFrame, text: str) -> DataFrame:
    """Array of unit objects to rows, with defaults for what they lack."""
    schema = "array<struct<raw_label: string, equipment_type: string, confidence: string, review_required: string, review_reason: string>>"
    d = df.withColumn("u", F.explode(F.from_json(F.col(text), schema)))
    return d.select(
        *[c for c in df.columns if c != text], F.coalesce("u.raw_label", F.lit("")).alias("raw_label"), F.coalesce("u.equipment_type", F.lit("UNRESOLVED")).alias("equipment_type"),
        F.coalesce(F.col("u.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.lower("u.review_required").isin("true", "1", "yes"), F.lit(False)).alias("review_required"),
        F.coalesce("u.review_reason", F.lit("")).alias("review_reason"),
    )


def relationship_document(runs: DataFrame) -> DataFrame:
    d = runs.where("run_status = 'succeeded'").select(F.explode("items").alias("e")).select("e.*").withColumn("confidence", F.col("confidence").cast("double"))
    return d.withColumn("review_required", (F.col("confidence") < 0.75) | F.coalesce("conflict", F.lit(False)))
