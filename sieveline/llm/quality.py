"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every text gets exact counts and a few ratios; its score is the largest ratio, so that one error budget serves all rules
of a stratum. Cutoffs are CELLS nested steps on the score. On labelled rows that pass the base rule, H0 for a stratum
and a cutoff is "it rejects more than `alpha` of the good documents"; the exact binomial tail P(Bin(n, alpha) <= rejected
good) is its p-value. A lower cutoff rejects all that a higher one does, so the cutoffs are tested in order from the
highest and testing stops at the first that is not certified: a fixed sequence needs no correction. Bonferroni over the
strata keeps the chance of any false certificate below `delta`. Of the certified cutoffs the one with most rejected junk,
less `price` times the rejected good, is used; without any, nothing but the base rule rejects in that stratum. So, with
confidence 1 - delta, at most alpha of each stratum's good documents are rejected.

Strata with too few good labels for a certificate even without any rejected good document are pooled: which ones is
decided by these numbers alone. They share a cutoff, and the guarantee holds for all of them together, not for each.

Nulls and edges: a null or empty text has zero counts and fails the base rule (under `min_words`). A null
language is a stratum of its own; a stratum without labels has no cutoffs, so only the base rule holds there.
Labels without a document and null labels take no part; a document labelled twice counts twice. Repeated rows
are judged alike. Extra columns of the input are kept, and win no clash: the outputs' names replace them. An empty table
gives no rows. A very long text is one row: its arrays of words and windows are held by the task that reads it.

The cutoffs are searched on counts per (stratum, cell), which is bounded by the number of strata.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, SPACES_RE, fence, quoted, unused

SYMBOLS = "#*$%&|<>"
#: Bits of a packed window that hold its position; a Spark string has fewer words than 2 ** 31.
POSITION_BITS = 31

#: Rule -> the ratio that it bounds from above, in SQL.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "shouts": "n_exclaims / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 40",
}
#: Cutoffs are 1 / CELLS, 2 / CELLS ... 1; a score over 1 falls in the last cell.
CELLS = 64
SCORE = f"greatest({', '.join(RULES.values())})"


def _windows(words: Column) -> Column:
    """The 3-word windows, each packed as 33 bits of hash above 31 bits of position, sorted.

    Neighbours that share the hash are candidates for windows found twice, and only these are compared as text,
    so hash collisions cost time and never change a count.
    """
    mask = ~((1 << POSITION_BITS) - 1)
    return F.sort_array(
        F.transform(
            F.when(F.size(words) >= 3, F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(mask)).bitwiseOR(i.cast("long")),
        )
    )


def _near(a: Column, x: Column, i: Column, key) -> Column:
    return F.coalesce(key(F.get(a, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(a, i + 1)) == key(x), F.lit(False))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_exclaims, all long."""
    t = F.coalesce(quoted(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims"]
    keep = [quoted(c) for c in docs.columns if c not in names]
    own = unused([*docs.columns, *names], "_words", "_lines", "_packed", "_close", "_same", "_at")
    words, line, packed, near, same_, at_ = own
    w, p, c, g, q = (F.col(x) for x in (words, packed, near, same_, at_))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE, -1)).alias(words),
        lines.alias(line),
        F.length(F.regexp_replace(t, SPACES_RE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )
    counted = [F.col(x) for x in names if x != "n_repeat_words"]
    step = step.select(*keep, words, "word_chars", "n_symbols", "n_exclaims", F.size(w).cast("long").alias("n_words"), (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"), _windows(w).alias(packed))
    close = F.transform(F.filter(p, lambda x, i: _near(p, x, i, lambda y: F.shiftright(y, POSITION_BITS))), lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))
    step = step.select(*keep, *counted, words, close.alias(near))
    same = F.sort_array(F.transform(c, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    step = step.select(*keep, *counted, F.when(F.size(c) > 0, same).alias(same_))
    at = F.sort_array(F.transform(F.filter(g, lambda x, i: _near(g, x, i, lambda y: y["g"])), lambda x: x["i"]))
    step = step.select(*keep, *counted, at.alias(at_))
    covered = F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(q, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select(*keep, *[fence(F.coalesce(covered, F.lit(0)).cast("long")).alias(x) if x == "n_repeat_words" else x for x in names])


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k): the regularised incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), k + 1.0, 1.0 - p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log1p(-p) + b * log(p))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(b, a, p) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


@dataclass
class Cut:
    """A certified cutoff and what it does to the labelled rows of its stratum or pool. cell: scores in higher cells are rejected."""

    cell: int
    pooled: bool
    good: int
    good_rejected: int
    bad: int
    bad_rejected: int


def certify(good: list[int], bad: list[int], level: float, alpha: float, price: float) -> tuple[int, int, int] | None:
    """(cell, rejected good, rejected bad) of the best certified cutoff, or None. good, bad: labelled rows per cell."""
    n_good, n_bad, best = sum(good), sum(bad), None
    if not n_good:
        return None
    for cell in range(CELLS, 0, -1):
        false, true = sum(good[cell + 1 :]), sum(bad[cell + 1 :])
        if binomial_tail(false, n_good, alpha) > level:
            break  # the sequence ends here
        gain = true / max(1, n_bad) - price * false / n_good
        if gain > (best[0] if best else 0):  # ties: the higher cutoff
            best = (gain, cell, false, true)
    return best[1:] if best else None


def cutoffs(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", good: str = "quality", alpha: float = 0.04, delta: float = 0.05, price: float = 20.0) -> dict[str | None, Cut]:
    """stratum -> its certified cutoff. labels: (doc_id, quality). counted: from counts()."""
    rows = (
        counted.filter(~base_failed()).select(quoted(doc_id).alias("id"), quoted(stratum).cast("string").alias("s"), cell_of().alias("cell"))
        .join(labels.filter(F.col(good).isNotNull()).select(F.col(doc_id).alias("id"), (F.col(good) == 1).alias("ok")), "id")
        .groupBy("s", "ok", "cell").count().collect()
    )  # a row for each stratum, cell and label at most
    seen: dict[str | None, dict[bool, list[int]]] = {}
    for r in rows:
        seen.setdefault(r["s"], {True: [0] * (CELLS + 2), False: [0] * (CELLS + 2)})[r["ok"]][r["cell"]] += r["count"]
    needed = ceil(log(delta / max(1, len(seen))) / log1p(-alpha))  # good labels that certify a cutoff which rejects none
    groups = [[s] for s, by in seen.items() if sum(by[True]) >= needed]
    if short := [s for s, by in seen.items() if sum(by[True]) < needed]:
        groups.append(short)
    out: dict[str | None, Cut] = {}
    for group in groups:
        total = {ok: [sum(x) for x in zip(*(seen[s][ok] for s in group), strict=True)] for ok in (True, False)}
        if found := certify(total[True], total[False], delta / len(groups), alpha, price):
            cell, false, true = found
            out |= {s: Cut(cell, len(group) > 1, sum(total[True]), false, sum(total[False]), true) for s in group}
    return out


def cell_of() -> Column:
    """The cell of a counted row's score."""
    return F.least(F.greatest(F.ceil(F.expr(SCORE) * CELLS), F.lit(0)), F.lit(CELLS + 1)).cast("int")


def verdict(cuts: dict[str | None, Cut], stratum: str = "lang") -> Column:
    """True where no certified cutoff of the row's stratum rejects it."""
    reject = F.lit(False)
    for s, cut in sorted(cuts.items(), key=lambda x: (x[0] is not None, x[0] or "")):
        reject = reject | (quoted(stratum).cast("string").eqNullSafe(F.lit(s)) & (cell_of() > cut.cell))
    return ~reject


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", counted: DataFrame | None = None, **kw) -> DataFrame:
    """docs with its counts, base_failed and kept. counted: counts(docs) if they are stored already."""
    counted = counts(docs) if counted is None else counted
    cuts = cutoffs(counted, labels, stratum=stratum, **kw)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cuts, stratum))
