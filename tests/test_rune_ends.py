"""Every document's interval of global code points."""

from __future__ import annotations

from sieveline.plans import catalogue


def test_every_document(spark, tmp_path):
    texts = ["abc", "", None, "éà", "x" * 2000, "z"]
    rows = [(i, "src0", "en", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["rune_to_doc_ends"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2), (3, 3, 4), (4, 5, 2004), (5, 2005, 2005)]
