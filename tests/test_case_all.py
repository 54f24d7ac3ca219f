"""Case variants of every code point and trigram, against Python's case mapping."""

from __future__ import annotations

from itertools import product

from sieveline.plans import catalogue

TEXTS = ["a,ß", "Straße", "İxy", "éÀ1", "", None, "ab"]


def variants(rune):
    return set(rune + rune.lower() + rune.upper())


def test_every_rune_and_trigram(spark, tmp_path):
    rows = [(i, f"src{i}", "de", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert {r.rune: set(r.variants.split("|")) for r in run("case_variants")} == {c: variants(c) for t in TEXTS for c in t or ""}
    tris = {t[k : k + 3] for t in TEXTS if t for k in range(len(t) - 2)}
    got = [(r.tri, r.variant) for r in run("case_trigrams")]
    assert len(got) == len(set(got)) and set(got) == {(t, "".join(v)) for t in tris for v in product(*map(variants, t))}
