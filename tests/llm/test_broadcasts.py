"""Joins with tables that grow with the corpus do not go through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import common, jaccard


def last_plan(spark) -> str:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.apply(runs.size() - 1).physicalPlanDescription()


def test_large_stored_tables_are_not_broadcast(spark):
    scratch = common.Scratch(spark, "broadcasts")
    before = spark.conf.get(common.JOIN_KEY)
    found = {}
    for n in (400_000, 1000):
        side = scratch.save(spark.range(n).select(F.xxhash64("id").alias("id"), F.col("id").alias("label")), f"side-{n}")
        rows = scratch.save(spark.range(2 * n).select(F.xxhash64("id").alias("id"), F.xxhash64("id", F.lit(1)).alias("x")), f"rows-{n}")
        assert scratch.save(rows.join(side, "id", "left").filter("label is not null"), f"out-{n}").count() == n
        scratch.save(rows.join(side, "id", "left"), f"last-{n}")
        found[n] = last_plan(spark)
    assert "SortMergeJoin" in found[400_000] and "BroadcastHashJoin" not in found[400_000]
    assert "BroadcastHashJoin" in found[1000]
    assert spark.conf.get(common.JOIN_KEY) == before


def test_components_are_joined_by_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m")], "doc_id bigint, text string")
    out = jaccard.join(docs)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
