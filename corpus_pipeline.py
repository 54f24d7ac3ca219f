"""The corpus pipeline: toxicity, quality rules, line dedup, near duplicates, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import jaccard, line_dedup, packing, quality, toxicity
from sieveline.llm.common import Scratch, quoted, split_by_ids, table, unused


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; the machine learns from labelled rows of docs that are not held out."""
    machine = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, machine).filter("predicted = 0").select(*docs.columns)


def poor_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rule or a certified cutoff of their language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), "doc_id", "text", "lang")
    counted = Scratch(spark, "quality").save(quality.counts(held).drop("text"), "counts")  # once, beside the rows they judge
    cuts = quality.cutoffs(counted, labels)
    return counted.filter(~quality.base_failed() & quality.verdict(cuts)).select("row.*")


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later three-line windows go; documents that lose every line that holds a word go with them."""
    (lost,) = unused(docs.columns, "_removed")
    out = line_dedup.dedup(docs, removed=lost)
    return out.filter((F.col(lost) == 0) | line_dedup.has_word(F.col("text"))).withColumn(
        "n_chars", F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*[quoted(c) for c in docs.columns])


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows with the same doc_id and text are one document, of which one row stays; so are rows without a doc_id that have
    the same text. Other texts of a doc_id that stays, and other texts without a doc_id, stay.
    """
    scratch = Scratch(spark, "near-copies")
    gone, place, turn = unused(docs.columns, "_gone", "_place", "_turn")
    found = scratch.save(jaccard.join(docs.select("doc_id", "text")).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    touched, rest = split_by_ids(docs, "doc_id", found)
    kept = touched.join(found, F.col("doc_id") == F.col(gone), "left_anti").unionByName(rest)
    # only rows that repeat an id and a text are moved to be told apart
    where = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    repeated = scratch.save(docs.filter("text is not null").groupBy(where.alias(place)).count().filter("count > 1").select(place), "repeated")
    if not repeated.isEmpty():
        twice, once = split_by_ids(kept.withColumn(place, where), place, repeated)
        order = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
        first = twice.withColumn(turn, F.row_number().over(order)).filter((F.col(turn) == 1) | F.col("text").isNull()).drop(turn)
        kept = first.unionByName(once).drop(place)
    return kept.select(*[quoted(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_go),
    ("quality", poor_go),
    ("line_dedup", repeated_lines_go),
    ("near_duplicates", near_copies_go),
    ("packing", packed),
]

#: Learned scores, tokens and the linear program are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
