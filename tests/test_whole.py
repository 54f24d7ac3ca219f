"""Queries over postings and stored indexes against their SQL and plain counts, on documents of several sources."""

from __future__ import annotations

from collections import Counter

import pytest

from sieveline.operators import index as ix
from sieveline.plans import catalogue
from sieveline.sources import corpus as source

duckdb = pytest.importorskip("duckdb")

TEXTS = ["therea there the\nthereafter of", "", "ab", "abc", None, "There THE therein of aaaa éàü", "the there on " * 9, "x\0there", "thereas on there of"]
NAMES = sorted(
    "trigram_postings trigram_encode trigram_decode case_variants case_trigrams posting_lists posting_deltas delta_roundtrip posting_bytes bucket_directory rune_to_doc "
    "candidate_files_and candidate_files_or posting_or_merge posting_case_union distance_join index_literal index_literal_ci index_regex index_regex_ci index_counters "
    "index_contents multi_shard_merge extension_section search_stats literal_bytes".split()
)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, f"src{i % 4}", "en", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = rows_of(catalogue.queries()[name](spark, sf_dir).select(*columns))
    assert got == Counter(want.fetchall())


def test_every_document_takes_part(spark, sf_dir):
    got = rows_of(catalogue.queries()["trigram_postings"](spark, sf_dir).select("file_idx", "tri", "pos"))
    assert got == Counter((i, t[k : k + 3], k) for i, t in enumerate(TEXTS) if t for k in range(len(t) - 2))
    hits = rows_of(catalogue.queries()["index_literal"](spark, sf_dir).select("file_idx", "byte_offset"))
    assert hits == Counter((i, len(t[:k].encode())) for i, t in enumerate(TEXTS) if t and "\0" not in t for k in range(len(t)) if t.startswith("there", k))


def test_document_above_the_small_shard(spark, tmp_path):
    rows = [(0, "src0", "en", "x" * 100_000 + " there"), (1, "src1", "en", "there")]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(catalogue.queries()["index_literal"](spark, str(tmp_path)).select("file_idx", "byte_offset"))
    assert got == Counter([(0, 100_001), (1, 0)])


def test_skipped_file_larger_than_a_shard(spark, tmp_path):
    builder = ix.IndexBuilder(source.BuilderOptions(shard_max=60, file_max=50))
    files = [("a", "hello"), ("b", "x" * 61), ("c", "there"), ("d", b"\0" * 300), ("e", "is"), ("f", "last one")]
    done = builder.build(source.from_rows(spark, files), str(tmp_path / "i"))
    assert {r.skip_reason: r.files for r in done.collect()} == {"None": 3, "TooLarge": 2, "TooSmall": 1}
    index = ix.Index(spark, [str(tmp_path / "i")])
    assert sorted((r.file_idx, r.shard) for r in index.table("contents").collect()) == [(0, 0), (2, 1), (5, 2)]
    with pytest.raises(source.DocumentTooLarge):
        ix.IndexBuilder(source.BuilderOptions(shard_max=60)).build(source.from_rows(spark, [("b", "x" * 61)]), str(tmp_path / "j"))
