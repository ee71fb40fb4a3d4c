"""The review inbox of snapshots, and the lists that are read from the ledger.

Tables of the inbox meet by (property_id, floor, key). Stored by ``sinks.write_bucketed`` with these columns and one number of buckets,
they are joined where they lie, without a shuffle, however often the inbox is loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical_key, relationship_key, split_list
from ..operators import review

SCOPE = ["property_id", "floor"]
KEYS = [*SCOPE, "evidence_key"]
# What a contested floor is resolved to where no ruling names another.
RULED_FLOOR, CONTESTED, RESOLVED = "1", "floor_ambiguous", "resolved_out_of_scope"
SEVERITIES = {"error": "errors", "orphan": "orphans", "review": "review_items"}


def evidence_by_key(*sources: DataFrame) -> DataFrame:
    """(property_id, floor, evidence_key, evidence, n_evidence) of sources (property_id, floor, key, source, detail), in order of source and detail:
    what is stored beside the units. A null property or floor is the empty one."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    every = every.fillna("", SCOPE).where("key IS NOT NULL").withColumnRenamed("key", "evidence_key")
    each = F.sort_array(F.collect_list(F.struct("source", "detail")))
    return every.groupBy(*KEYS).agg(each.alias("evidence")).withColumn("n_evidence", F.size("evidence").cast("long"))


def keyed_units(units: DataFrame) -> DataFrame:
    """units(property_id, floor, canonical_name, canonical_key, source_files) with evidence_key, the stored key or else that of the name, and
    ``files``, the source files as a list. Confidence isn't calibrated across sources, so none is shown."""
    key = F.coalesce(F.nullif("canonical_key", F.lit("")), canonical_key(F.col("canonical_name")))
    d = units.fillna("", SCOPE).withColumn("evidence_key", key).withColumn("files", split_list(F.col("source_files")))
    return d.withColumn("confidence", F.lit(None).cast("double"))


def equipment(keyed: DataFrame, evidence: DataFrame) -> DataFrame:
    """``keyed_units`` with their evidence, one row a unit; units without evidence have an empty list."""
    d = keyed.join(evidence, KEYS, "left")
    none = F.array().cast(evidence.schema["evidence"].dataType)
    return d.withColumn("evidence", F.coalesce("evidence", none)).withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def gaps(report: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """The gap report; rows whose floor is contested stand as resolved, with the floor that ``rulings`` (building, equipment_id, resolved_floor)
    gives the unit, else ``RULED_FLOOR``. Of several rulings on one unit the least floor holds."""
    hit = F.col("status") == CONTESTED
    if rulings is None:
        ruled = report.withColumn("_ruled", F.lit(RULED_FLOOR))
    else:
        one = rulings.groupBy("building", "equipment_id").agg(F.min("resolved_floor").alias("_ruled"))
        ruled = report.join(one, ["building", "equipment_id"], "left")
    to = F.coalesce("_ruled", F.lit(RULED_FLOOR))
    return ruled.withColumn("resolved_floor", F.when(hit, to)).withColumn("status", F.when(hit, RESOLVED).otherwise(F.col("status"))).drop("_ruled")


def relationships(edges: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """The relationship view: edges with item_key; findings by their severity; ``summary``, a row for each scope of either, with the number
    of each and whether the scope passed. A scope without findings passes."""
    e = edges.withColumn("item_key", relationship_key(F.col("child"), F.col("ref_type"), F.col("parent")))
    count = F.count(F.lit(1)).alias("edges")
    told = [F.count_if(F.col("severity") == s).alias(name) for s, name in SEVERITIES.items()]
    own = lambda d: d.fillna("", SCOPE).groupBy(*SCOPE)
    both = own(edges).agg(count).join(own(findings).agg(*told), SCOPE, "full_outer").fillna(0)
    view = {name: findings.where(F.col("severity") == s) for s, name in SEVERITIES.items()}
    return {"edges": e, **view, "summary": both.withColumn("passed", (F.col("errors") == 0) & (F.col("orphans") == 0))}


def pending(units: DataFrame, edges: DataFrame, applied: DataFrame) -> DataFrame:
    """(property_id, floor, item_type, item_key) still to decide: units by their name and edges by their key, without those that ``applied``
    (the same columns) names in any session of the scope."""
    keys = lambda d, kind, key: d.select(*SCOPE, F.lit(kind).alias("item_type"), F.col(key).alias("item_key"))
    every = keys(units, "equipment", "canonical_name").unionByName(keys(edges, "relationship", "item_key"))
    every, applied = (d.fillna("", SCOPE).distinct() for d in (every, applied))
    return every.join(applied, [*SCOPE, "item_type", "item_key"], "left_anti")


def progress(live: DataFrame, reviewable: DataFrame) -> DataFrame:
    """(session_id, total, approved, rejected, left): distinct keys of ``reviewable`` (session_id, item_type, item_key), and the live decisions
    on those among them; decisions on keys that aren't reviewable count for nothing."""
    keys = reviewable.select(*review.ITEM).distinct()
    d = keys.join(live.select(*review.ITEM, "action"), review.ITEM, "left").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action").isin("approve", "edit")).alias("approved"), F.count_if(F.col("action") == "reject").alias("rejected")
    )
    return d.withColumn("left", F.col("total") - F.col("approved") - F.col("rejected"))


def sessions_list(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """All sessions (session_id, floor, status, created_by, created_at, n_open) in the order in which they were opened, with their counts."""
    counts = review.session_state(sessions, events)
    return sessions.drop("n_open").join(counts, "session_id", "left").orderBy("created_at", "session_id")


def unfed(corrections: DataFrame) -> DataFrame:
    """Corrections that the example pool was not given yet, oldest first."""
    return corrections.where("NOT coalesce(fed_to_fewshot, false)").orderBy("created_at", "correction_id")
