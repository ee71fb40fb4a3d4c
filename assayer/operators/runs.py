"""Run bookkeeping: checkpoints, reuse, re-attachment of results, escalation, tile outcomes, tokens and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .picks import last_per_key, side_by_side

# USD for a million (input, output) tokens; a longer model name matches by prefix, in this order.
PRICES = (("small", 1.0, 5.0), ("medium", 3.0, 15.0), ("large", 5.0, 25.0))
CACHE_READ, CACHE_WRITE, BATCH = 0.1, 1.25, 0.5
TOKENS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def checkpoint_state(log: DataFrame) -> DataFrame:
    return last_per_key(log, ["key"])


def pending(routes: DataFrame, log: DataFrame) -> DataFrame:
    return routes.join(checkpoint_state(log).where("status = 'succeeded'").select("key"), "key", "left_anti")


def reused(routes: DataFrame, log: DataFrame) -> DataFrame:
    return routes.join(checkpoint_state(log).where("status = 'succeeded'").drop("seq"), "key")


def status_counts(log: DataFrame) -> DataFrame:
    return checkpoint_state(log).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def attach(requests: DataFrame, results: DataFrame, key: str = "request_id") -> DataFrame:
    """Every request with its result; one that has none becomes a failed row."""
    j = requests.join(results.withColumn("_hit", F.lit(True)), key, "left")
    return j.withColumn("status", F.when(F.col("_hit").isNull(), "failed").otherwise(F.coalesce("status", F.lit("failed")))).drop("_hit")


def routed(records: DataFrame, kind: Column, flat: bool = False, large: str = "large", small: str = "small") -> DataFrame:
    tiled = (kind == "drawing") & F.lit(not flat)
    return records.withColumn("route", F.when(tiled, "drawing").otherwise("flat")).withColumn("model", F.when(tiled, large).otherwise(small))


def escalated(attempts: DataFrame, key: str, gate: Column) -> DataFrame:
    """First tier that passes the gate, else the last attempt, with the trail of tiers."""
    return attempts.groupBy(key).agg(
        F.coalesce(F.min(F.when(gate, F.col("tier"))), F.max("tier")).alias("tier"),
        F.coalesce(F.min_by("result", F.when(gate, F.col("tier"))), F.max_by("result", "tier")).alias("result"),
        F.bool_or(gate).alias("accepted"),
        F.array_join(F.transform(F.array_sort(F.collect_set("tier")), lambda t: t.cast("string")), ",").alias("trail"),
    )


def drawing_status(tiles: DataFrame, keys=("image",)) -> DataFrame:
    """tiles(outcome: blank, parsed, transport_failed, parse_failed; labels) to one status a drawing."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    d = tiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tiles"), n("blank").alias("blank"), n("parsed").alias("parsed"), n("transport_failed").alias("transport"),
        n("parse_failed").alias("parse"), F.sum(F.when(F.col("outcome") == "parsed", F.coalesce("labels", F.lit(0))).otherwise(0)).alias("labels"),
    )
    content = F.col("tiles") - F.col("blank")
    status = (
        F.when(content == 0, "succeeded").when(F.col("parsed") == 0, F.when(F.col("transport") >= F.col("parse"), "transport_failed").otherwise("parse_failed"))
        .when((F.col("parsed") == content) & (F.col("labels") > 0), "succeeded").otherwise("validation_failed")
    )
    return d.select(*keys, "tiles", content.alias("content_tiles"), F.col("parsed").alias("succeeded_tiles"), status.alias("status"))


def rates(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with rate_in, rate_out of prices(name, rate_in, rate_out, ord): exact name, else the first prefix; null if none.

    The price list, which the caller writes by hand and which has a row for each model family, is broadcast and matched once
    for each distinct model; models are few.
    """
    m = usage.select("model").distinct()
    hit = m.join(F.broadcast(prices), F.col("model").startswith(F.col("name")))
    w = Window.partitionBy("model").orderBy(F.desc(F.col("model") == F.col("name")), "ord")
    best = hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("model", "rate_in", "rate_out")
    return usage.join(best, "model", "left")


def price_list(spark, prices=PRICES) -> DataFrame:
    return spark.createDataFrame([(n, a, b, i) for i, (n, a, b) in enumerate(prices)], "name string, rate_in double, rate_out double, ord int")


def cost(rate_in: Column, rate_out: Column, batch: Column) -> Column:
    i, o, r, w = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in TOKENS)
    full = ((i + CACHE_READ * r + CACHE_WRITE * w) * rate_in + o * rate_out) / 1e6
    return F.round(F.coalesce(F.when(batch, full * BATCH).otherwise(full), F.lit(0.0)), 6)


def first_nonzero(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs], F.lit(0))


def usage_costs(usage: DataFrame, prices: DataFrame, totals: bool = False) -> DataFrame:
    """Calls, tokens and cost by (model, batch); with ``totals`` one more row over all (is_total)."""
    d = rates(usage, prices)
    aggs = [F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in TOKENS]]
    by = d.groupBy("model", "batch", "rate_in", "rate_out").agg(*aggs).withColumn("cost", cost(F.col("rate_in"), F.col("rate_out"), F.col("batch"))).drop("rate_in", "rate_out")
    if not totals:
        return by
    return by.groupingSets([["model", "batch"], []], "model", "batch").agg(
        F.sum("calls").alias("calls"), *[F.sum(c).cast("long").alias(c) for c in TOKENS], F.round(F.sum("cost"), 6).alias("cost"), (F.grouping("model") == 1).cast("int").alias("is_total")
    )


def item_summary(items: DataFrame, rate_in: float, rate_out: float, batch: bool = True) -> DataFrame:
    d = items.agg(F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") != "succeeded").alias("errored"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in TOKENS])
    return d.withColumn("cost", cost(F.lit(rate_in), F.lit(rate_out), F.lit(batch)))


def outcome(runs: DataFrame, routes: DataFrame, candidates: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts for a run. runs(run_status), routes(key, route), candidates(confidence), log: the checkpoints before it."""
    n = lambda c, name: F.count_if(c).alias(name)
    done = checkpoint_state(log).where("status = 'succeeded'").select("key", F.lit(True).alias("_done"))
    images = runs.agg(F.count(F.lit(1)).alias("images_total"), n(F.col("run_status") == "succeeded", "images_succeeded"), n(F.col("run_status") != "succeeded", "images_incomplete"))
    routed_ = routes.join(done, "key", "left").agg(
        n(F.col("_done").isNotNull(), "images_reused_from_checkpoint"), n(F.col("_done").isNull(), "images_run"),
        n(F.col("route") == "drawing", "images_routed_to_tiling"), n(F.col("route") == "flat", "images_routed_flat"),
    )
    found = candidates.agg(
        F.count(F.lit(1)).alias("equipment_candidates_total"), n(F.col("confidence") >= 0.75, "equipment_candidates_confident"),
        n(~F.coalesce(F.col("confidence") >= 0.75, F.lit(False)), "equipment_candidates_review_required"),
    )
    return side_by_side(images, routed_, found)


def run_status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_status").agg(F.count(F.lit(1)).alias("n"))
