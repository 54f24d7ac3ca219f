"""Toxicity scores keep the labelled rows' share of toxic ones when the sample is capped."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import common, toxicity


def test_capped_sample_keeps_the_share(spark):
    labels = spark.range(440).select(F.col("id").alias("doc_id"), (F.col("id") % 11 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.lit("same words").alias("text"))  # no term tells, so the score is the share
    share = labels.filter(~common.held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    for per_class in (8000, 20):
        got = toxicity.score(docs.limit(1), toxicity.train(docs, labels, per_class=per_class)).first().score
        assert abs(got - share) < 0.08, per_class
