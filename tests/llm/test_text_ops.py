"""Operators on texts against plain versions, with nulls, empty and long texts, repeats and odd columns."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sieveline.llm import byte_bpe, common, line_dedup, packing, quality, token_counts, toxicity  # noqa: E402
from sieveline.llm.word_bpe import reader  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n", "x", "a b c a b c", "\n\n x\n x\nx \x0b", "a b c " * 3000, "<b> |&\n\n😀 é", "İ ΑΣ don't  I'll\t\"q\"", "foo\x1cbar \x85 baz\xa0z", "y" * 3000, "a b c a b c"]
PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with a repeated row, a null id and columns whose names clash with what operators add."""
    rows = [(i, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD)] + [(3, "x", "en", 3), (None, "null id", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    return docs.withColumn("_id", F.lit(1)).withColumn("length", F.lit("q")).withColumn("last", F.lit("l")).withColumn("a.b", F.lit("d"))


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def test_word_hashes():
    h, n = common.word_hashes(*common.buffers(pa.array(ODD)), lower=True)
    assert n.tolist() == [len(WORD.findall(t or "")) for t in ODD]
    words = [w for t in ODD for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))


def test_split_by_ids(spark):
    docs = spark.range(3000).withColumnRenamed("id", "k")
    ids = docs.filter("k % 7 = 0").select(F.col("k").alias("w"))
    maybe, rest = common.split_by_ids(docs, "k", ids)
    kept = {r.k for r in maybe.collect()}
    assert kept >= set(range(0, 3000, 7)) and len(kept) < 500 and kept | {r.k for r in rest.collect()} == set(range(3000))
    assert common.split_by_ids(docs, "k", ids.limit(0))[0].count() == 0


# ---------------------------------------------------------------- quality

def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    covered = {k for i, x in enumerate(tri) if many[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd):
    rows = quality.counts(odd).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
    assert quality.counts(empty(spark)).count() == 0


def test_counts_keep_other_columns(spark):
    docs = spark.createDataFrame([("a b c a b c", "en")], "text string, lang string")
    names = ["_words", "_lines", "_packed", "_close", "_same", "_at", "a.b", "a`b", "n_words"]
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    r = quality.counts(docs).first()
    assert all(r[n] == n for n in names[:-1]) and r.n_words == 6 and r.n_repeat_words == 6


def test_binomial_tail():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 10, 0.1), (10, 10, 0.5), (2, 500, 0.01), (40, 1000, 0.04), (499, 500, 0.9), (0, 107, 0.04), (300, 500, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert 0.4 < quality.binomial_tail(40_000_000, 1_000_000_000, 0.04) < 0.6  # no list of terms


def test_certified_cutoffs(spark):
    text = lambda i, end: " ".join(f"w{i}x{k}{end}" for k in range(60))
    good = [(i, text(i, ""), "en") for i in range(300)]
    junk = [(5000 + i, text(i, "###"), "en") for i in range(50)]
    few = [(6000 + 100 * j + i, text(i, "" if i < 40 else "$$"), lang) for j, lang in enumerate(("fr", "de", None)) for i in range(60)]
    none = [(9000, text(1, "###"), "xx")]
    docs = spark.createDataFrame(good + junk + few + none, "doc_id bigint, text string, lang string")
    ok = (F.col("doc_id") < 5000) | (F.col("doc_id") >= 6000) & (F.col("doc_id") % 100 < 40)
    labels = docs.filter("doc_id < 9000").select("doc_id", F.when(ok, 1).otherwise(0).alias("quality")).unionByName(spark.createDataFrame([(1, None), (None, 1), (77777, 1)], "doc_id bigint, quality int"))
    counted = quality.counts(docs)
    cuts = quality.cutoffs(counted, labels)
    assert set(cuts) == {"en", "fr", "de", None}  # three short strata are pooled; one without labels has no cutoff
    assert not cuts["en"].pooled and (cuts["en"].good, cuts["en"].good_rejected, cuts["en"].bad_rejected) == (300, 0, 50)
    assert cuts["fr"] == cuts["de"] == cuts[None] and cuts["fr"].pooled and (cuts["fr"].good, cuts["fr"].bad_rejected) == (120, 60)
    kept = {r.doc_id for r in quality.judge(docs, labels).filter("kept").collect()}
    assert kept == {r.doc_id for r in docs.filter(ok | (F.col("doc_id") == 9000)).collect()}
    assert not quality.cutoffs(counted, labels.filter("doc_id < 20")) and not quality.cutoffs(counted, labels.limit(0))
    assert quality.judge(docs, labels.limit(0)).filter("kept").count() == docs.count()
    assert quality.judge(docs.limit(0), labels).count() == 0
    odd = quality.judge(docs.withColumn("kept", F.lit("x")).withColumn("base_failed", F.lit("y")), labels)
    assert odd.filter("kept").count() == len(kept)


def test_guarantee():
    """Over many holdouts of good documents whose true tail is known, a cutoff that rejects over alpha is rarely certified."""
    rng = np.random.default_rng(8)
    alpha, level, wrong, some = 0.04, 0.05, 0, 0
    share = 0.3 * 0.85 ** np.arange(quality.CELLS + 2)
    share /= share.sum()
    bad = [0] * quality.CELLS + [50, 50]
    for n in (150, 400, 3000):
        for _ in range(700):
            good = rng.multinomial(n, share).tolist()
            # a tiny price makes the choice greedy for low cutoffs, the worst case
            found = quality.certify(good, [b + 1 for b in bad], level, alpha, 1e-9)
            some += found is not None
            wrong += found is not None and share[found[0] + 1 :].sum() > alpha
    assert some > 2000 and wrong <= 2100 * level


# ---------------------------------------------------------------- line dedup

def plain_dedup(rows):
    """rows: (doc_id, text) -> {(doc_id, text): text without the lines of later windows, but with those of first ones}."""
    spaces = " \t\n\x0b\x0c\r"
    first, places, seen = {}, {}, {}
    for i, t in rows:
        if i is None or t is None:
            continue
        full = [k for k, x in enumerate(t.split("\n")) if x.strip(spaces)]
        places[i, t] = full
        for at in range(len(full) - 2):
            key = tuple(t.split("\n")[k].strip(spaces) for k in full[at : at + 3])
            first[key] = min(first.get(key, (i, at)), (i, at))
            seen.setdefault(key, set()).add((i, at, t))
    out = {}
    for (i, t), full in places.items():
        lines, late, kept = t.split("\n"), set(), set()
        for at in range(len(full) - 2):
            key = tuple(lines[k].strip(spaces) for k in full[at : at + 3])
            if first[key] != (i, at):
                late |= {at, at + 1, at + 2}
            elif len(seen[key]) > 1:
                kept |= {at, at + 1, at + 2}
        late -= kept
        gone = {full[k] for k in late} | {x for k in late if k + 1 in late for x in range(full[k], full[k + 1])}
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark, odd):
    passage = "one line here\ntwo lines here\nthree lines here"
    texts = [f"top\n{passage}\nend", f"{passage}\n\nfour", f"start\n {passage} \nx\ny\nz", "a\nb\nc\nd\na\nb\nc\nd", "x\ny\nz\nw", passage, passage, "q\nq\nq\nq\nq", "a1\nb1\na1\nb1\n\na1\n \nb1", "k\n\nl\nm\nn\n\nk\n\nl\nm\n\nn\n", None, ""]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score int"))
    for name in ("_at", "_l", "_f", "_s", "_g", "_id", "_tie", "_Lines", "_full", "_gone", "_spans", "_gaps", "_keep", "_bits", "_bucket", "a.b", "n"):
        docs = docs.withColumn(name, F.lit(name))
    rows = docs.collect()
    want = plain_dedup([(r.doc_id, r.text) for r in rows])
    got = line_dedup.dedup(docs, removed="n").collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, want.get((r.doc_id, r.text), r.text)) for r in rows)
    assert all(r[c] == c for r in got for c in docs.columns[3:-1]) and {r.text for r in got} >= {"q\nq\nq", "a1\nb1\na1\nb1\n"}
    assert line_dedup.dedup(empty(spark)).count() == 0


# ---------------------------------------------------------------- toxicity

def test_toxicity(spark, odd):
    rng = np.random.default_rng(1)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, marks = [], []
    for i in range(1200):
        w = list(rng.choice(words, 60))
        # "thud" is toxic beside "group" only: the pair decides, not either word
        kind = i % 4
        w[5], w[9] = ("thud", "group") if kind == 0 else ("thud", words[3]) if kind == 1 else (words[4], "group") if kind == 2 else (words[5], words[6])
        rows.append((i, " ".join(w)))
        marks.append((i, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (1, None), (77777, 1), (None, 1)], "doc_id bigint, toxic int")
    machine = toxicity.train(docs, labels)
    out = toxicity.score(docs, machine).withColumn("h", common.held_out(F.col("doc_id"))).join(labels, "doc_id").filter("h and toxic is not null").collect()
    assert len(out) > 300 and sum((r.predicted == 1) == (r.toxic == 1) for r in out) / len(out) > 0.97
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    scored = toxicity.score(odd, machine)
    assert scored.columns == ["doc_id", "text", "lang", "_id", "length", "last", "a.b", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == len(ODD) + 2
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_factorization_machine():
    """Scores are the sum over single terms and over all pairs; the gradients are those of that sum."""
    rng = np.random.default_rng(6)
    slot = np.full(toxicity.CELLS, -1, np.int32)
    slot[np.arange(5) * 7] = np.arange(5)
    m = toxicity.Machine(slot, 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    texts = [[0, 7, 14, 7], [], [28], [3, 21, 0, 0, 28, 99]]
    got = m.scores(np.array([c for t in texts for c in t], np.int64), np.array([len(t) for t in texts]))
    for t, s in zip(texts, got, strict=True):
        terms = sorted({int(slot[c]) for c in t if slot[c] >= 0})
        x = m.w0 + sum(m.w[i] for i in terms) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(terms) for j in terms[k + 1 :])
        assert s == pytest.approx(1 / (1 + np.exp(-x)))
    s, h = np.array([0, 2, 3]), 1e-6
    base, total = toxicity._logits(m, np.zeros(3, int), s, 1)
    for k in range(3):
        for f in range(3):
            m.v[s[k], f] += h
            assert (toxicity._logits(m, np.zeros(3, int), s, 1)[0][0] - base[0]) / h == pytest.approx(total[0, f] - (m.v[s[k], f] - h), abs=1e-4)
            m.v[s[k], f] -= h


# ---------------------------------------------------------------- tokens

def tokens(t, plain=False):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    if plain:
        own.encode_special_tokens = True
    return own.encode(t or "", add_special_tokens=False).ids


SPECIAL = ["hello <|endoftext|> world", "a<|startoftext|>b.", "abc<| endoftext|> x"]


def test_chunked_ids():
    texts = ODD + SPECIAL
    for plain in (False, True):
        ids, n = reader(PATH, plain).ids(*common.buffers(pa.array(texts)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokens(t, plain) for t in texts]
    assert tokens(SPECIAL[0]) == [3306, 49407, 1002]


def test_chunk_memory(monkeypatch):
    from sieveline.llm import spans

    calls = []
    own = spans.Chunks(lambda cs: calls.append(list(cs)) or [[len(c)] for c in cs])
    long, texts = "你" * 3000, ["a bb a", None, "你" * 3000, "ccc"]
    for _ in range(2):
        ids, n = own.ids(*common.buffers(pa.array(texts)))
        assert n.tolist() == [3, 0, 1, 1] and ids.tolist() == [1, 3, 2, 9000, 3]
    assert all(len(c) <= spans.LONG for c in own.rank) and sum(long.encode() in c for c in calls) == 2
    monkeypatch.setattr(spans, "CACHE_BYTES", 10)
    assert own.ids(*common.buffers(pa.array(["zz"])))[0].tolist() == [2] and list(own.rank) == [b"zz"]


def test_patterns_across_gaps():
    ranks = {bytes([i]): i for i in range(256)} | {b".\n": 256}
    own = byte_bpe.Codec(ranks, r"[^\s\p{L}\p{N}]+[\r\n]*|\s+|\p{L}+|\p{N}+")
    ids, n = own.texts(*common.buffers(pa.array(["a.\nb", None, "x"])))
    assert ids.tolist() == [97, 256, 98, 120] and n.tolist() == [3, 0, 1]


def test_byte_bpe(spark, odd):
    import base64
    import hashlib

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in byte_bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect():
        want = own.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(" ".join(map(str, want)).encode()), sha((r.text or "").encode()))
    got = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN).select("text", "ids").collect()
    assert all(r.ids == own.encode_ordinary(r.text or "") for r in got)
    assert byte_bpe.digests(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_separator_scan(spark, tmp_path, odd):
    rng = np.random.default_rng(3)
    want, files = [], []
    for k in range(6):
        ids = np.where(rng.random(rng.integers(0, 300)) < (0.3 if k < 4 else 0.01), 2, 7).astype("<u2")
        if k == 5:
            ids[:] = 7
        ids.tofile(tmp_path / str(k))
        files.append((str(tmp_path / str(k)), 2 * len(ids)))
        ends = [-1, *np.flatnonzero(ids == 2).tolist()]
        want += [(files[-1][0], j, b - a - 1, True) for j, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        if len(ids) - 1 > ends[-1]:
            want.append((files[-1][0], len(ends) - 1, len(ids) - 1 - ends[-1], False))
    listed = spark.createDataFrame(files, "file string, bytes bigint")
    for block in (2, 6, 64, 1 << 20):
        for group in (2, 1024):
            assert sorted(map(tuple, token_counts.scan(listed, end_id=2, block=block, group=group).collect())) == sorted(want)
    assert token_counts.counts(spark, empty(spark), PATH).count() == 0
    got = token_counts.counts(spark, odd, PATH).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, len(tokens(r.text, True))) for r in odd.collect())


# ---------------------------------------------------------------- packing

def test_plan_holds_every_item():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 400, 20_000):
        demand = np.bincount(rng.integers(0, 64, n), minlength=64)
        plan = packing.plan(demand)
        assert (sum((p * u for p, u in plan), np.zeros(64, np.int64)) == demand).all()
        assert all((p * (np.arange(64) + 1)).sum() <= 64 for p, _ in plan)
        least = sum(u for _, u in packing.solve(demand))  # of the linear program, so of any packing
        assert least >= (demand * (np.arange(64) + 1)).sum() / 64 - 1e-6
        assert sum(u for _, u in plan) <= 1.03 * least + 2


def test_price_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        duals = rng.random(12)
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1], *(best[c - k] + duals[k - 1] for k in range(1, c + 1))])
        value, pattern = packing.price(duals, 12)
        assert abs(value - best[12]) < 1e-9 and abs(pattern @ duals - value) < 1e-9 and pattern @ (np.arange(12) + 1) <= 12


def test_pack(spark, odd):
    out = packing.pack(odd, PATH, length=256).collect()
    ids = [(r.doc_id, np.array([*tokens(r.text), 2], "<u4")) for r in odd.collect()]
    want = Counter()
    for i, x in ids:
        for s in range(0, len(x), 256):
            want[i, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty(spark), PATH).count() == 0
