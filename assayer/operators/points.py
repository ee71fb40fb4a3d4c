"""Point names grouped into units, with coverage and path checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import append_reason, match_key, path_context, strip, strip_device_prefix, type_base, type_contained

# Evidence marks, and the reasons and words by which reasons are told.
WEAK, STRONG = "weak_topic_evidence", "multiple_point_evidence"
NO_PATH = "no deterministic path match (non-standard topic format)"
NO_IMAGE = "no screenshot for vision second pass"
NOTHING_SEEN = "vision second pass found no equipment"
RETAINED = "review retained because prior reasons were not exclusively type-only"
TYPE_PATH = r"^type '.+' not evident in path label '.+'$"
NOT_OF_TYPE = r"\b(?:group(?:ing|ed|s)?|floor|identity|path|context(?:s)?|merge(?:d|s|ing)?|split(?:s|ting)?|span(?:s|ned|ning)?)\b"
TYPE_MARK = r"^(?:type-only|\[type-only\])$|^type-only:|^\[type-only\]"
TYPE_SUBJECT = r"\b(?:equipment )?type\b"
TYPE_DOUBT = r"\b(?:ambiguous|ambiguity|uncertain|uncertainty|unclear|unresolved|unknown|mismatch|conflict|disagreement)\b|low confidence|not evident"


def units(points: DataFrame, keys=("property_id", "floor")) -> DataFrame:
    """points(property_id, floor, topic_name) to one row a unit: label, type, count, strength; a single point is weak."""
    d = points.withColumn("context", path_context(F.col("topic_name"), F.col("floor"))).where("context IS NOT NULL")
    n = F.col("topic_count")
    out = d.groupBy(*keys, "context").agg(F.count(F.lit(1)).alias("topic_count"))
    label = strip_device_prefix(F.col("context"), any_case=False)
    return out.select(
        *keys, F.col("context").alias("raw_equipment_context"), label.alias("raw_label"), type_contained(label).alias("inferred_raw_type"), "topic_count",
        F.when(n == 1, WEAK).otherwise(STRONG).alias("evidence_strength"), (n == 1).alias("review_required"),
        F.when(n == 1, WEAK).otherwise("").alias("review_reason"),
    )


def expect_contexts(units: DataFrame, expected: int) -> DataFrame:
    """``units`` as they are, or an error where their number isn't ``expected``."""
    n = units.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n != expected:
        raise ValueError(f"Expected {expected} topic contexts, found {n}")
    return units


def coverage(expected: DataFrame, assigned: DataFrame, col: str) -> DataFrame:
    """Multiset difference: rows (kind, value, n) that are missing, unexpected or assigned too often."""
    lost, extra = expected.select(col).exceptAll(assigned.select(col)), assigned.select(col).exceptAll(expected.select(col))
    known = expected.select(col).distinct()
    parts = (("missing", lost), ("unexpected", extra.join(known, col, "left_anti")), ("duplicate", extra.join(known, col, "left_semi")))
    rows = [d.groupBy(col).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), F.col(col).alias("value"), "n") for k, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def path_checked(parsed: DataFrame) -> DataFrame:
    """parsed(raw_label, equipment_type, floor, source_topics, review_required, review_reason) with flags from the topics' own paths:
    none of them fits, they span several contexts, or the type isn't in the one context's label."""
    context = lambda t: strip_device_prefix(path_context(t, F.col("floor")), any_case=False)
    known = lambda t: path_context(t, F.col("floor")).isNotNull()
    d = parsed.withColumn("_c", F.array_sort(F.array_distinct(F.transform(F.filter("source_topics", known), context))))
    n, label, base = F.size("_c"), F.get("_c", F.lit(0)), type_base(F.col("equipment_type"))
    kind = F.coalesce("equipment_type", F.lit(""))
    absent = (base != "") & ~F.contains(F.upper(label), base) & (kind != "UNRESOLVED")
    why = (
        F.when(n == 0, NO_PATH)
        .when(n > 1, F.concat(F.lit("topics span multiple path contexts ['"), F.array_join("_c", "', '"), F.lit("']")))
        .when(absent, F.concat(F.lit("type '"), kind, F.lit("' not evident in path label '"), label, F.lit("'")))
    )
    d = d.withColumn("n_contexts", n).withColumn("_why", why)
    return (
        d.withColumn("review_required", F.col("review_required") | F.col("_why").isNotNull())
        .withColumn("review_reason", append_reason(F.col("review_reason"), F.col("_why"))).drop("_c", "_why")
    )


def type_only(reason: Column) -> Column:
    """Whether every part of a reason speaks of nothing but the type."""
    parts = F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), strip), lambda x: x != "")

    def one(x):
        t = F.lower(F.regexp_replace(x, r"\s+", " "))
        return t.rlike(TYPE_PATH) | (~t.rlike(NOT_OF_TYPE) & (t.rlike(TYPE_MARK) | (t.rlike(TYPE_SUBJECT) & t.rlike(TYPE_DOUBT))))

    return (F.size(parts) > 0) & F.forall(parts, one)


def second_opinion(units: DataFrame, detected: Column, seen: Column | None = None) -> DataFrame:
    """Merges a detected type into flagged units; every outcome is noted. ``seen``: whether the unit has an image at all.

    Agreement settles a unit whose reasons were all about its type; other doubts are retained. Disagreement and images in which
    nothing was found leave it flagged.
    """
    have, kind = F.upper(F.coalesce("equipment_type", F.lit(""))), F.nullif(strip(detected), F.lit(""))
    same, settled = F.upper(kind) == have, type_only(F.col("review_reason"))
    confirmed = F.concat(F.lit("vision second pass CONFIRMED "), kind)
    conflict = F.concat(F.lit("vision second pass CONFLICT: sees "), kind, F.lit(", topics say "), F.coalesce("equipment_type", F.lit("")))
    note = (
        F.when(~(F.lit(True) if seen is None else seen), NO_IMAGE).when(kind.isNull(), NOTHING_SEEN)
        .when(same & settled, confirmed).when(same, append_reason(confirmed, F.lit(RETAINED))).otherwise(conflict)
    )
    flagged = F.coalesce("review_required", F.lit(False))
    d = units.withColumn("_note", F.when(flagged, note)).withColumn("_clear", F.coalesce(flagged & kind.isNotNull() & same & settled, F.lit(False)))
    return (
        d.withColumn("review_required", flagged & ~F.col("_clear"))
        .withColumn("review_reason", append_reason(F.col("review_reason"), F.col("_note"))).drop("_note", "_clear")
    )


def only_candidate(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """units(unit_id, raw_context, raw_label) with ``detected``: the type of the one candidate that names the unit by its label or its
    canonical name; none or several give null. candidates(candidate_id, raw_label, canonical_name, equipment_type)."""
    keys = lambda *cs: F.explode(F.filter(F.array_distinct(F.array(*[match_key(F.col(c)) for c in cs])), lambda k: k != ""))
    u = units.select("unit_id", keys("raw_context", "raw_label").alias("_k"))
    c = candidates.select("candidate_id", F.nullif(strip(F.col("equipment_type")), F.lit("")).alias("_t"), keys("raw_label", "canonical_name").alias("_k"))
    # a key that many units and many candidates have meets as one row of either, not as all pairs
    c = c.groupBy("_k").agg(F.min("candidate_id").alias("_a"), F.max("candidate_id").alias("_b"), F.min("_t").alias("_t"))
    met = u.join(c, "_k").groupBy("unit_id").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.min("_t").alias("detected"))
    return units.join(met.where("_a = _b").select("unit_id", "detected"), "unit_id", "left")


# Extensions of images that can show a unit.
IMAGE_NAMES = r"(?i)\.(png|jpg|jpeg|webp)$"


def screenshots(units: DataFrame, images: DataFrame) -> DataFrame:
    """Each unit with the first image whose file stem agrees with its context or label."""
    stem = F.regexp_extract("filename", r"([^/\\]+?)(\.[^.]*)?$", 1)
    keys = images.where(F.col("filename").rlike(IMAGE_NAMES)).groupBy(match_key(stem).alias("_k")).agg(F.min("filename").alias("filename")).where("_k <> ''")
    u = units.withColumn("_k", F.explode(F.array_distinct(F.array(match_key(F.col("raw_context")), match_key(F.col("raw_label"))))))
    hit = u.join(keys, "_k").groupBy("unit_id").agg(F.min("filename").alias("filename"))
    return units.join(hit, "unit_id", "left")


def vision_pass(units: DataFrame, images: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flagged units against what an image model found: resolve the image, pick the one candidate, merge."""
    d = only_candidate(screenshots(units, images), candidates)
    return second_opinion(d, F.col("detected"), F.col("filename").isNotNull()).drop("detected")
