"""Places in groups of any size, against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.operators import picks, ranks, review
from assayer.sources.scratch import Scratch


def test_places_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 0.1, 0.5, 0.9]), k) for k in range(3000)]
    d = spark.createDataFrame(rows, "g string, score double, id int").repartition(7)
    order = [F.desc_nulls_last("score"), F.asc("id")]
    want = d.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(str, ranks.placed(d, ["g"], *order).collect())) == sorted(map(str, want.collect()))
    assert ranks.placed(d.where("false"), ["g"], *order).count() == 0


@pytest.fixture
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_group_of_all_rows_is_dealt_over_tasks(spark, no_coalescing):
    d = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("equipment_id"), F.lit("VAV").alias("equipment_type"), F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("severity_hint"))
    saved = []

    def save(df):
        saved.append(Scratch()(df))
        return saved[-1]

    got = ranks.placed(d, ["equipment_type"], "equipment_id", name="n", save=save)
    assert got.where("n <> equipment_id + 1").count() == 0
    per = [r["count"] for r in saved[0].groupBy("_range").count().collect()]
    assert len(per) >= 3 and max(per) < 30_000
    r = review.ranked_groups(d)
    assert r.where("place = 1").first()["severity_rank"] == 0 and r.agg(F.max("place"), F.count_distinct("place")).first()[:] == (40_000, 40_000)


def test_ties_and_repeated_rows_have_places_of_their_own(spark):
    d = spark.createDataFrame([("g", 1)] * 50 + [("g", 2)] * 2, "g string, v int")
    got = sorted((r["place"], r["v"]) for r in ranks.placed(d, ["g"], "v").collect())
    assert [p for p, _ in got] == list(range(1, 53)) and [v for _, v in got] == [1] * 50 + [2] * 2


def test_top_examples_keep_few_before_they_meet(spark):
    d = spark.range(5000).select(F.when(F.col("id") < 4990, "hot").when(F.col("id") < 4995, "b").alias("c"), F.format_string("v%05d", "id").alias("v")).union(spark.createDataFrame([("b", "v04990")], "c string, v string"))
    got = {r["c"]: (r["examples"], r["more"]) for r in picks.top_examples(d, "c", "v").collect()}
    assert got == {"hot": ("v00000,v00001,v00002", 4987), "b": ("v04990,v04991,v04992", 2), None: ("v04995,v04996,v04997", 2)}
    assert "WindowGroupLimit" in picks.top_examples(d, "c", "v")._jdf.queryExecution().executedPlan().toString()
