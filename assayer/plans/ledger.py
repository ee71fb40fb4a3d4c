"""The review ledger as tables that change together: sessions, events, master, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from ..sources import commits
from ..sources.scratch import Scratch

TABLES = ("sessions", "events", "master", "corrections")


def opened(spark: SparkSession, root: str, sessions: DataFrame, events: DataFrame, master: DataFrame) -> commits.Snapshot:
    """The first version of a ledger, without corrections."""
    none = F.lit(None).cast("string")
    log = sessions.where("false").select(*review.ITEM[:1], *[none.alias(c) for c in ("item_type", "item_key", "original", "corrected", "reason", "reviewer", "correction_id")])
    first = {"sessions": sessions.withColumn("committed_at", F.lit(None).cast("timestamp")), "events": events, "master": master, "corrections": log}
    return commits.commit(commits.snapshot(spark, root), root, first, uses=TABLES)


def commit_open(spark: SparkSession, root: str, items: DataFrame, edges: DataFrame, at, read: commits.Snapshot | None = None) -> tuple[commits.Snapshot, dict[str, DataFrame]]:
    """Commits all open sessions of the ledger that have no problem, with one new version of its four tables: the master, the new
    corrections, the events with their applied flags, and the sessions as committed ``at``. (that version, outputs of the commit).

    All four are seen together or not at all. If another commit changed one of them since ``read`` (the newest version), this one is
    refused with ``commits.Conflict``. Where no session can be committed no version is made.
    """
    read = read or commits.snapshot(spark, root)
    scratch = Scratch()
    out = review.commit(read["sessions"], read["events"], items, edges, read["master"], save=scratch)
    done = scratch(out["counts"])
    if done.isEmpty():
        return read, out
    applied = out["applied"].withColumnRenamed("applied", "_now")
    events = read["events"].join(applied, review.ITEM, "left").withColumn("applied", F.coalesce("_now", "applied")).select(read["events"].columns)
    gone = done.select("session_id", F.lit(True).alias("_done"))
    sessions = read["sessions"].join(gone, "session_id", "left").withColumns({
        "status": F.when(F.col("_done"), "committed").otherwise(F.col("status")),
        "committed_at": F.when(F.col("_done"), F.lit(at).cast("timestamp")).otherwise(F.col("committed_at")),
    }).select(read["sessions"].columns)
    named = out["corrections"].withColumn("correction_id", F.sha2(F.to_json(F.array(*review.ITEM)), 256))
    log = read["corrections"].unionByName(named)
    new = commits.commit(read, root, {"sessions": sessions, "events": events, "master": out["master"].drop("change"), "corrections": log}, uses=TABLES)
    return new, out
