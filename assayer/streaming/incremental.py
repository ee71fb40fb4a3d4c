"""Incremental forms of batch operators. What has to be remembered is keyed state of the stream, kept with its checkpoint: a batch reads and
writes the state of its own keys, and what it adds to a result table. Every batch writes a partition of its own, so a batch that
runs again replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import made_folder
from ..sources.sinks import export_outbox

ITEM = ["session_id", "item_type", "item_key"]


def _run(stream: DataFrame, each, checkpoint: str):
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _batch(df: DataFrame, path: str, batch_id: int) -> None:
    """What a batch adds, in a folder of its own that a second run replaces."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(made_folder(spark, path))


def new_files(spark, folder: str, glob: str, handle, checkpoint: str):
    """Files not seen before, each once; ``handle(df, batch_id)`` gets path, length, content."""
    schema = spark.read.format("binaryFile").load(folder).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return _run(stream, handle, checkpoint)


def resumable(stream: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "key"):
    """``work`` on rows whose key hasn't succeeded yet; its rows (``key``, ``status``, more) are the results table at ``done_path``.

    The results come back into the stream, so the state of a key says whether it is due or has succeeded, and no batch reads
    the table: it reads what was added since. A key that stands in several rows of a batch, or that is due, is worked on once; one
    whose result isn't 'succeeded' is worked on again when it next arrives after that result. Rows without a key are left out.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType
    told = T.StructType([T.StructField(key, kind), T.StructField("status", T.StringType())])
    back = spark.readStream.schema(told).parquet(made_folder(spark, done_path))
    every = stream.withColumn("_status", F.lit(None).cast("string")).unionByName(back.select(key, F.col("status").alias("_status")), allowMissingColumns=True)
    columns = [f.name for f in stream.schema.fields]

    def due(_, parts: Iterator[pd.DataFrame], state: GroupState):
        was, first = state.get[0] if state.exists else "", None
        told = []
        for part in parts:
            told += part["_status"].dropna().tolist()
            rows = part[part["_status"].isna()]
            if first is None and len(rows):
                first = rows.iloc[:1][columns]
        if told:
            was = "succeeded" if was == "succeeded" or "succeeded" in told else "failed"
        if first is not None and was not in ("due", "succeeded"):
            was = "due"
            state.update((was,))
            yield first
        elif told:
            state.update((was,))

    todo = every.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(due, stream.schema, "status string", "append", GroupStateTimeout.NoTimeout)
    return _run(todo, lambda batch, k: _batch(work(batch), done_path, k), checkpoint)


def outbox(stream: DataFrame, pool_path: str, checkpoint: str, key: str = "correction_id"):
    """At least once from the stream, once in the pool: deduplicated by id against all that was ever written."""
    return _run(stream, lambda b, _: export_outbox(b.sparkSession, b, pool_path, key), checkpoint)


#: a live decision's part in its session's counters
CHANGES = "session_id string, n_approved long, n_rejected long"


def live_counters(stream: DataFrame, changes_path: str, checkpoint: str):
    """Keeps the changes of session counters that action events (session_id, item_type, item_key, action, created_at, action_id) make.

    The state of a (session, item) is its latest event, by created_at, then action_id: a late older event and a repeated one change
    nothing. A batch writes one row for each session whose counters it changes; ``counters`` adds them up.
    """
    order = [stream.schema[c].dataType.simpleString() for c in ("created_at", "action_id")]
    state_schema = f"created_at {order[0]}, action_id {order[1]}, action string"
    part = lambda action: (int(action in ("approve", "edit")), int(action == "reject"))

    def latest(key, parts: Iterator[pd.DataFrame], state: GroupState):
        was = state.get if state.exists else None
        now = was
        for part_ in parts:
            for row in part_[["created_at", "action_id", "action"]].itertuples(index=False, name=None):
                now = row if now is None or row[:2] > now[:2] else now
        if now != was:
            state.update(tuple(x.item() if hasattr(x, "item") else x for x in now))
            a, b = part(now[2]), part(was[2]) if was else (0, 0)
            if a != b:
                yield pd.DataFrame({"session_id": [key[0]], "n_approved": [a[0] - b[0]], "n_rejected": [a[1] - b[1]]})

    keyed = stream.select(*ITEM, "action", "created_at", "action_id").groupBy(*ITEM)
    changed = keyed.applyInPandasWithState(latest, CHANGES, state_schema, "append", GroupStateTimeout.NoTimeout)

    def each(batch, k):
        _batch(batch.groupBy("session_id").agg(F.sum("n_approved").alias("n_approved"), F.sum("n_rejected").alias("n_rejected")), changes_path, k)

    return _run(changed, each, checkpoint)


def counters(spark: SparkSession, changes_path: str) -> DataFrame:
    """(session_id, n_approved, n_rejected) of all sessions that ever had a decision."""
    rows = _table(spark, changes_path, CHANGES)
    return rows.groupBy("session_id").agg(F.sum("n_approved").alias("n_approved"), F.sum("n_rejected").alias("n_rejected"))
