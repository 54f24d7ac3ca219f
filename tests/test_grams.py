"""Trigrams in Arrow batches against plain counts: repeated and null file numbers, texts across blocks, stored rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.operators import grams, index as ix

ROWS = [(3, "banana ban"), (1, "aéa日本éa"), (3, "anana"), (None, "anan"), (2, "ab"), (4, ""), (5, None), (None, "nana"), (6, "😀🎉🚀😀🎉🚀"), (7, "x" * 300)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def merged(rows):
    """{(file, tri): sorted places}, rows of one file merged."""
    out = defaultdict(list)
    for i, t in rows:
        for k in range(len(t or "") - 2):
            out[i, t[k : k + 3]].append(k)
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(params=[1, 1 << 19])
def corpus(spark, monkeypatch, request):
    monkeypatch.setattr(grams, "BLOCK", request.param)
    return spark.createDataFrame(ROWS, "file_idx bigint, text string").repartition(3)


def test_lists_steps_and_sums(corpus):
    want = merged(ROWS)
    assert {(r.file_idx, r.tri): r.positions for r in ix.posting_lists(corpus).collect()} == want
    for stored_form in (False, True):
        got = {(r.file_idx, r.tri): (r.n, r.positions) for r in ix.joined_lists(corpus, stored_form).collect()}
        assert got == {k: (len(v), ",".join(map(str, v))) for k, v in want.items()}
    steps = Counter((r.file_idx, r.tri, r.pos, r.delta) for r in ix.posting_deltas(corpus).collect())
    assert steps == Counter((*k, p, p - q) for k, v in want.items() for p, q in zip(v, [0, *v]))
    stats = {r.tri: (r.freq, r.docs) for r in grams.totals(ix._long(corpus)).collect()}
    assert stats == {t: (sum(len(v) for k, v in want.items() if k[1] == t), sum(k[1] == t for k in want)) for _, t in want}
    size = {r.tri: r.bytes for r in ix.posting_bytes(corpus).collect()}
    assert size == {t: sum(1 if p - q < 128 else 2 for k, v in want.items() if k[1] == t for p, q in zip(v, [0, *v])) for _, t in want}


def test_rows_and_chosen(corpus):
    every = Counter((i, t[k : k + 3], k, len(t[:k].encode())) for i, t in ROWS for k in range(len(t or "") - 2))
    assert Counter(map(tuple, ix.postings(corpus).select("file_idx", "tri", "pos", "byte_offset").collect())) == every
    got = Counter(map(tuple, ix.positions(corpus, ["ana", "日本é", "zzz"]).select("file_idx", "tri", "pos").collect()))
    assert got == Counter({k[:3]: n for k, n in every.items() if k[1] in ("ana", "日本é")})


def test_stored_rows(corpus):
    docs = ix._long(corpus.withColumn("shard", F.lit(1).cast("bigint"))).repartition("shard").sortWithinPartitions("shard", "file_idx")
    got = Counter(map(tuple, grams.places(grams.stored(docs), "shard").select("shard", "file_idx", "tri", "pos", "byte_offset").collect()))
    assert got == Counter((1, i, t[k : k + 3], k, len(t[:k].encode())) for i, t in ROWS for k in range(len(t or "") - 2))


def test_lists_move_no_places(spark):
    """Without a repeated file_idx nothing is shuffled; before, every place was."""
    docs = spark.createDataFrame([(1, "banana"), (2, "ananas")], "file_idx bigint, text string")
    for made in (ix.posting_lists(docs), ix.posting_deltas(docs), ix.joined_lists(docs, True)):
        assert "Exchange" not in plan_of(made)


def test_varints():
    rng = random.Random(1)
    values = [0, 127, 128, 2**63 - 1, *(rng.randrange(1 << rng.randrange(1, 63)) for _ in range(500))]
    blobs = grams.encoded(np.array(values), np.array([0, 3, 100]))
    assert len(blobs) == 3 and grams.decoded(blobs).tolist() == values
    assert grams.decoded(grams.encoded(np.array([2**64 - 1], np.uint64), np.array([0]))).tolist() == [2**64 - 1]
    assert grams.decoded(pa.array([], pa.binary())).tolist() == []
