"""The registered queries of the search engine and their SQL.

All run on the whole documents table as a corpus: file_idx is doc_id, the path source/lang/doc_id.txt. Queries through
a stored index cover every document that an index admits whatever its limits on size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs, ngrams, text as tx
from ..operators import index as ix, postings as px, results, search as se
from ..sources import corpus as source
from . import regex as rx
from .folding import posting_variants
from .query import Query, SearchOptions

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable) -> Callable:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.load(spark, sf_dir)


def _q(pattern: str, is_regex: bool = False, **options) -> Query:
    return Query(pattern, is_regex, SearchOptions(**options))


# ---------------------------------------------------------------- SQL parts

C = "c as (select doc_id as file_idx, source || '/' || lang || '/' || doc_id || '.txt' as path, text from documents where text is not null)"
#: Columns of a hit at code point i (from 1) that is n code points long.
OFFSETS = "strlen(left(text, i - 1))::bigint as byte_offset, strlen(substring(text, i, n))::bigint as byte_length"
LINE = "case when contains(text, chr(10)) then (strlen(left(text, i - 1)) - strlen(replace(left(text, i - 1), chr(10), '')) + 1)::bigint end as line_number"


def literal_cte(pattern: str, case_sensitive: bool = True, where: str = "true") -> str:
    p, n = pattern.replace("'", "''"), len(pattern)
    same = f"substring(text, i, {n}) = '{p}'" if case_sensitive else f"lower(substring(text, i, {n})) = lower('{p}')"
    some = f"contains(text, '{p}')" if case_sensitive else "true"
    return f"""{C}, h as (select file_idx, path, text, i, {n} as n from (
      select file_idx, path, text, unnest(generate_series(1, length(text) - {n} + 1)) as i from c where {some} and {where}) where {same})"""


def literal_sql(pattern: str, case_sensitive: bool = True, where: str = "true", tail: str = "") -> str:
    return f"with {literal_cte(pattern, case_sensitive, where)} select file_idx, {OFFSETS}, {LINE} from h {tail}"


def regex_cte(pattern: str, flags: str = "", where: str = "true") -> str:
    """RE2 spelling. Starts are prefix sums over the pieces between matches and the matches."""
    p = pattern.replace("'", "''")
    p = f"(?{flags}){p}" if flags else p
    return f"""{C}, m as (
      select file_idx, path, text, regexp_extract_all(text, '{p}') as found, string_split_regex(text, '{p}') as gaps from c where regexp_matches(text, '{p}') and {where}),
    h as (select file_idx, path, text, found[k] as hit,
      (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) + 1)::bigint as i, length(found[k]) as n
      from (select *, unnest(generate_series(1, len(found))) as k from m))"""


def regex_sql(pattern: str, flags: str = "", where: str = "true", tail: str = "") -> str:
    return f"with {regex_cte(pattern, flags, where)} select file_idx, {OFFSETS}, {LINE} from h {tail}"


def tri_cte(where: str = "true") -> str:
    return f"""{C}, t as (select file_idx, i - 1 as pos, substring(text, i, 3) as tri, text from (
      select file_idx, text, unnest(generate_series(1, length(text) - 2)) as i from c where {where} and length(text) >= 3))"""


# ---------------------------------------------------------------- literal search

@query(literal_sql("the"))
def literal_matches(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("the"))


@query(literal_sql("qu"))
def literal_short(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("qu"))


@query(literal_sql("é"))
def literal_unicode(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("é"))


@query(literal_sql("the", False))
def literal_ci(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("the", case_sensitive=False))


@query(literal_sql("Él", False))
def literal_ci_unicode(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("Él", case_sensitive=False))


@query(literal_sql("$$", True))
def literal_overlap(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("$$"))


@query(literal_sql("the", where="path glob 'src1*.txt'"))
def literal_glob(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("the", file_pattern="src1*.txt"))


@query(literal_sql("the", tail="order by file_idx, byte_offset limit 100"))
def literal_limit(spark, sf_dir):
    return se.search_literal(docs(spark, sf_dir), "the", max_matches=100)


@query("select page_id as file_idx, strlen(left(html, i - 1))::bigint as byte_offset, 3::bigint as byte_length, case when contains(html, chr(10)) then (strlen(left(html, i - 1)) - strlen(replace(left(html, i - 1), chr(10), '')) + 1)::bigint end as line_number from (select page_id, html, unnest(generate_series(1, length(html) - 2)) as i from pages where contains(html, '<p>')) where substring(html, i, 3) = '<p>'")
def literal_pages(spark, sf_dir):
    return se.matches(source.load(spark, sf_dir, "pages"), _q("<p>"))


@query(f"with {literal_cte('the')} select file_idx, count(*) as hits from h group by file_idx")
def literal_counts(spark, sf_dir):
    return se.with_hits(docs(spark, sf_dir), _q("the")).select("file_idx", F.size("hits").cast("bigint").alias("hits"))


@query(f"with {C} select file_idx, path from c where (path glob 'src1*' or path glob '*/fr/*') and not path glob '*/??/*5.txt'")
def include_exclude(spark, sf_dir):
    return docs(spark, sf_dir).filter(globs.admitted(F.col("path"), ["src1*", "*/fr/*"], ["*/??/*5.txt"])).select("file_idx", "path")


# ---------------------------------------------------------------- regular expressions

@query(regex_sql("th(?:e|is)[a-z]* (?:on|of)"))
def regex_matches(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("th(e|is)[a-z]* (on|of)", True))


@query(regex_sql("tionon|queau|schlich"))
def regex_alternation(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("tionon|queau|schlich", True))


@query(regex_sql("the[a-z]+ of", "i"))
def regex_ci(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("the[a-z]+ of", True, case_sensitive=False))


@query(regex_sql("[0-9]+[.-][0-9]+"))
def regex_no_literal(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("[0-9]+[.-][0-9]+", True))


@query(regex_sql("a[a-z](?:nd|th)e", where="path glob '*/en/*'"))
def regex_glob(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("a[a-z](nd|th)e", True, file_pattern="*/en/*"))


@query(regex_sql("tionon|queau", tail="order by file_idx, byte_offset limit 25"))
def regex_limit(spark, sf_dir):
    return se.search_regex(docs(spark, sf_dir), "tionon|queau", max_matches=25)


@query(literal_sql("ther"))
def regex_pure_literal(spark, sf_dir):
    return se.matches(docs(spark, sf_dir), _q("ther", True))


@query(f"with {C} select file_idx, 0::bigint as byte_offset, strlen(regexp_extract(text, '^[a-zA-Z]*'))::bigint as byte_length, case when contains(text, chr(10)) then 1::bigint end as line_number from c")
def regex_empty(spark, sf_dir):
    """A pattern that may match nothing, anchored: one match a document."""
    return se.matches(docs(spark, sf_dir), _q("^[a-zA-Z]*", True))


@query(f"with {C} select file_idx from c where contains(text, 'tionon') and (contains(text, 'the') or contains(text, 'and'))")
def regex_prefilter(spark, sf_dir):
    """Documents that the filter derived from a pattern lets through."""
    need = rx.required(rx.parse("tionon.*(the|and)"))
    return docs(spark, sf_dir).filter(se.filter_column(F.col("text"), need)).select("file_idx")


# ---------------------------------------------------------------- contexts and rendering

LINES = "l as (select *, case when ls[-1] = '' then ls[:len(ls) - 1] else ls end as ll from (select file_idx, path, text, string_split_regex(text, '\\r?\\n') as ls from c))"


@query(f"""with {literal_cte('tionon')}, {LINES},
x as (select h.file_idx, h.path, h.text, h.i, h.n, l.ll, {LINE.replace('text', 'h.text').replace('(h.h.text', '(h.text')} from h join l using (file_idx))
select file_idx, path, {OFFSETS}, line_number, ll[coalesce(line_number, 1)] as line_text,
  array_to_string(ll[greatest(coalesce(line_number, 1) - 2, 1):coalesce(line_number, 1) - 1], chr(10)) as before,
  array_to_string(ll[coalesce(line_number, 1) + 1:coalesce(line_number, 1) + 2], chr(10)) as after from x""")
def context_lines(spark, sf_dir):
    rows = se.contexts(docs(spark, sf_dir), _q("tionon", context_lines=2))
    return rows.select("file_idx", "path", "byte_offset", "byte_length", "line_number", "line_text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query(f"""with {literal_cte('tionon')}, {LINES}, x as (select h.file_idx, h.path, h.text, h.i, h.n, l.ll, {LINE} from (select file_idx, path, text, i, n from h) h join (select file_idx, ll from l) l using (file_idx))
select file_idx, strlen(left(text, i - 1))::bigint as byte_offset, path || ':' || coalesce(line_number, 0) || ':' || ll[coalesce(line_number, 1)] as rendered from x""")
def render_matches(spark, sf_dir):
    return results.match_lines(docs(spark, sf_dir), _q("tionon"))


@query(f"""with recursive {literal_cte('tionon')}, {LINES},
hl as (select distinct file_idx, path, coalesce({LINE.replace(' as line_number', '')}, 1) as k from h),
o as (select *, row_number() over (partition by file_idx order by k) as r from hl),
w as (select file_idx, path, k, r, true as hit, k + 1 as last from o where r = 1
  union all select o.file_idx, o.path, o.k, o.r, o.k > w.last, greatest(w.last, o.k + 1) from w join o on o.file_idx = w.file_idx and o.r = w.r + 1),
s as (select distinct w.file_idx, w.path, unnest(generate_series(greatest(w.k - 1, 1), least(w.k + 1, len(l.ll)))) as line from w join l using (file_idx)),
p as (select s.file_idx, s.path, s.line, l.ll[s.line] as t, exists (select 1 from w where w.file_idx = s.file_idx and w.k = s.line and w.hit) as hit,
  s.line - lag(s.line) over (partition by s.file_idx order by s.line) > 1 as gap from s join l on l.file_idx = s.file_idx)
select file_idx, line::bigint as line, 1 as part, path || case when hit then ':' else '-' end || line || case when hit then ':' else '-' end || t as rendered from p
union all select file_idx, line::bigint, 0, '--' from p where gap""")
def render_context(spark, sf_dir):
    return results.context_lines(docs(spark, sf_dir), _q("tionon", context_lines=1))


# ---------------------------------------------------------------- admissibility, summaries, shards

LIMITS = source.BuilderOptions(file_max=6000, trigram_max=600)
REASON = f"""case when strlen(text) = 0 then 'None' when strlen(text) < 3 then 'TooSmall' when strlen(text) > {LIMITS.file_max} then 'TooLarge' when contains(text, chr(0)) then 'Binary'
  when strlen(text) - 2 > {LIMITS.trigram_max} and (select count(distinct substring(text, i, 3)) from (select unnest(generate_series(1, length(text) - 2)) as i)) > {LIMITS.trigram_max} then 'TooManyTrigrams' else 'None' end"""
JUDGED = f"{C}, d as (select file_idx, count(distinct tri) as k from (select file_idx, substring(text, i, 3) as tri from (select file_idx, text, unnest(generate_series(1, length(text) - 2)) as i from c where length(text) > 2)) group by 1), j as (select c.file_idx, c.path, strlen(c.text) as b, case when strlen(text) = 0 then 'None' when strlen(text) < 3 then 'TooSmall' when strlen(text) > {LIMITS.file_max} then 'TooLarge' when contains(text, chr(0)) then 'Binary' when strlen(text) - 2 > {LIMITS.trigram_max} and coalesce(k, 0) > {LIMITS.trigram_max} then 'TooManyTrigrams' else 'None' end as skip_reason from c left join d using (file_idx))"


@query(f"with {JUDGED} select file_idx, path, skip_reason from j")
def admissibility(spark, sf_dir):
    return source.admitted(docs(spark, sf_dir), LIMITS, "text").select("file_idx", "path", "skip_reason")


@query(f"with {JUDGED} select skip_reason, count(*) as files, sum(b)::bigint as bytes from j group by 1")
def index_summary(spark, sf_dir):
    return source.index_summary(source.admitted(docs(spark, sf_dir), LIMITS, "text"), "text")


SHARD = 200_000


@query(f"""with recursive {C}, o as (select file_idx, strlen(text) as b, row_number() over (order by file_idx) as r from c),
w as (select file_idx, b, r, 0::bigint as shard, b as used from o where r = 1
  union all select o.file_idx, o.b, o.r, case when w.used > 0 and w.used + o.b > {SHARD} then w.shard + 1 else w.shard end, case when w.used > 0 and w.used + o.b > {SHARD} then o.b else w.used + o.b end from w join o on o.r = w.r + 1)
select file_idx, shard from w""")
def shard_assignment(spark, sf_dir):
    return source.assign_shards(docs(spark, sf_dir), SHARD, "text").select("file_idx", "shard")


def _quarters(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("shard", F.floor(F.col("file_idx") / 256).cast("bigint"))


@query(f"with {C} select (file_idx // 256)::bigint as shard, 1::bigint as version, count(*) as file_count, sum(strlen(text))::bigint as total_bytes, sum(length(text))::bigint as total_runes, bool_and(length(text) = strlen(text)) as plain_ascii from c group by 1")
def shard_metadata(spark, sf_dir):
    return ix.metadata(_quarters(spark, sf_dir), "shard")


@query(f"with {C} select (file_idx // 256)::bigint as shard, file_idx, coalesce(sum(strlen(text)) over (partition by file_idx // 256 order by file_idx rows between unbounded preceding and 1 preceding), 0)::bigint as content_offset, strlen(text)::bigint as content_length from c")
def content_bounds(spark, sf_dir):
    return ix.files(_quarters(spark, sf_dir), "shard").select("shard", "file_idx", "content_offset", "content_length")


@query(f"with {C} select file_idx, sum(length(text)) over (partition by file_idx // 256 order by file_idx)::bigint as end_rune from c")
def doc_rune_ends(spark, sf_dir):
    return ix.files(_quarters(spark, sf_dir), "shard").select("file_idx", "end_rune")


@query(f"with {C}, x as (select file_idx, text, unnest(generate_series(1, length(text))) as i from c where contains(text, chr(10))) select file_idx, (strlen(left(text, i - 1)))::bigint as newline from x where substring(text, i, 1) = chr(10)")
def newline_offsets(spark, sf_dir):
    return docs(spark, sf_dir).select("file_idx", F.explode(tx.newline_offsets(F.col("text"))).alias("newline"))


@query(f"with {C} select file_idx, unnest(generate_series(0, length(text) - 1, 100))::bigint as rune, null::bigint as byte from c where false union all select file_idx, r::bigint, strlen(left(text, r))::bigint from (select file_idx, text, unnest(generate_series(0, length(text) - 1, 100)) as r from c where length(text) > 0)")
def rune_offset_sample(spark, sf_dir):
    """The byte offset of every hundredth code point of each document."""
    t = docs(spark, sf_dir).filter(F.length("text") > 0).select("file_idx", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(100))).alias("r"))
    return t.select("file_idx", F.col("r").cast("bigint").alias("rune"), tx.rune_to_byte(F.col("text"), F.col("r")).alias("byte"))


@query(f"""with {C}, e as (select file_idx, sum(length(text)) over (order by file_idx) as hi, sum(length(text)) over (order by file_idx) - length(text) as lo from c),
g as (select unnest(generate_series(0, (select max(hi) - 1 from e)::bigint, 997)) as g) select g::bigint as rune, file_idx, (g - lo)::bigint as local from g join e on g >= lo and g < hi""")
def rune_to_doc(spark, sf_dir):
    """Every 997th global code point: its document, and its place there. A place equal to an end is the next document's."""
    e = ix.files(docs(spark, sf_dir).filter(F.col("text").isNotNull())).select("file_idx", F.col("end_rune").alias("hi"), F.col("start_rune").alias("lo")).filter("hi > lo")
    # each interval lists its own multiples, so no range join is needed
    first = F.ceil(F.col("lo") / 997)
    last = F.floor((F.col("hi") - 1) / 997)
    return e.filter(first <= last).select("file_idx", "lo", F.explode(F.sequence(first, last)).alias("k")).select((F.col("k") * 997).cast("bigint").alias("rune"), "file_idx", (F.col("k") * 997 - F.col("lo")).cast("bigint").alias("local"))


@query(f"with {C}, e as (select file_idx, length(text) as n, sum(length(text)) over (order by file_idx) as hi from c) select file_idx, (hi - n)::bigint as first_rune, (hi - 1)::bigint as last_rune from e where n > 0")
def rune_to_doc_ends(spark, sf_dir):
    """The first and the last global code point of every document that has any."""
    e = ix.files(docs(spark, sf_dir).filter(F.col("text").isNotNull())).select("file_idx", F.col("end_rune").alias("hi"), F.col("start_rune").alias("lo"))
    return e.filter("hi > lo").select("file_idx", F.col("lo").cast("bigint").alias("first_rune"), (F.col("hi") - 1).cast("bigint").alias("last_rune"))


@query(f"""with {C}, s as (select file_idx // 256 as shard, count(*) as n from c group by 1), o as (select shard, coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base from s)
select c.file_idx, o.shard::bigint as shard, (row_number() over (partition by o.shard order by file_idx) - 1)::bigint as local_idx, (o.base + row_number() over (partition by o.shard order by file_idx) - 1)::bigint as global_idx from c join o on o.shard = c.file_idx // 256""")
def global_file_resolve(spark, sf_dir):
    t = _quarters(spark, sf_dir).select("file_idx", "shard")
    bases = t.groupBy("shard").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = (F.row_number().over(Window.partitionBy("shard").orderBy("file_idx")) - 1).cast("bigint")
    return t.withColumn("local_idx", local).join(bases.select("shard", "base"), "shard").select("file_idx", "shard", "local_idx", (F.col("base") + F.col("local_idx")).cast("bigint").alias("global_idx"))


# ---------------------------------------------------------------- trigrams and postings

#: Documents that an index takes whatever its limits.
ADMITTED = "(strlen(text) = 0 or strlen(text) >= 3 and not contains(text, chr(0)))"


def over_documents(sql: str):
    """Registers f(corpus) for all documents."""

    def register(f: Callable) -> Callable:
        return query(sql)(wraps(f)(lambda spark, sf_dir: f(docs(spark, sf_dir))))

    return register


def over_index(sql: str):
    """Registers f(index) for an index of all documents."""

    def register(f: Callable) -> Callable:
        return query(sql)(wraps(f)(lambda spark, sf_dir: f(_stored(spark, sf_dir))))

    return register


@over_documents(f"with {tri_cte()} select file_idx, tri, pos::bigint as pos, strlen(left(text, pos))::bigint as byte_offset from t")
def trigram_postings(corpus):
    return ix.postings(corpus)


CODE = "((ord(substring(tri, 1, 1))::bigint << 42) | (ord(substring(tri, 2, 1))::bigint << 21) | ord(substring(tri, 3, 1))::bigint)"


@over_documents(f"with {tri_cte()} select distinct tri, {CODE} as ngram from t")
def trigram_encode(corpus):
    return ix.trigrams(corpus).select("tri", ngrams.encoded(F.col("tri")).alias("ngram"))


@over_documents(f"with {tri_cte()}, n as (select distinct {CODE} as ngram from t) select ngram, chr((ngram >> 42)::integer) || chr(((ngram >> 21) & 2097151)::integer) || chr((ngram & 2097151)::integer) as tri from n")
def trigram_decode(corpus):
    n = ix.trigrams(corpus).select(ngrams.encoded(F.col("tri")).alias("ngram"))
    return n.select("ngram", ngrams.decoded(F.col("ngram")).alias("tri"))


#: Case as this engine has it, which for two characters differs from DuckDB's.
LOWER = "case when {0} = 'İ' then 'i' || chr(775) else lower({0}) end"
UPPER = "case when {0} = 'ß' then 'SS' else upper({0}) end"
RUNES = f"unnest(list_distinct([{{0}}] || string_split({LOWER}, '') || string_split({UPPER}, '')))"


@query(f"with {C}, r as (select distinct unnest(string_split(text, '')) as rune from c), v as (select rune, {RUNES.format('rune')} as v from r where rune <> '') select rune, string_agg(v, '|' order by v) as variants from v group by rune")
def case_variants(spark, sf_dir):
    r = docs(spark, sf_dir).select(F.explode(ngrams.runes(F.col("text"))).alias("rune")).distinct()
    return r.select("rune", F.array_join(F.array_sort(ngrams.rune_variants(F.col("rune"))), "|").alias("variants"))


@query(f"""with {tri_cte()}, d as (select distinct tri, substring(tri, 1, 1) as a, substring(tri, 2, 1) as b, substring(tri, 3, 1) as c from t),
r as (select distinct unnest([a, b, c]) as rune from d), v as (select rune, {RUNES.format('rune')} as v from r)
select distinct tri, x.v || y.v || z.v as variant from d join v x on x.rune = a join v y on y.rune = b join v z on z.rune = c""")
def case_trigrams(spark, sf_dir):
    t = ix.trigrams(docs(spark, sf_dir))
    return t.select("tri", F.explode(ngrams.trigram_variants(F.col("tri"))).alias("variant"))


@query(f"with {tri_cte()} select tri, count(*) as freq, count(distinct file_idx) as docs from t group by tri")
def posting_sizes(spark, sf_dir):
    return ix.tri_stats(docs(spark, sf_dir))


@over_documents(f"with {tri_cte()} select file_idx, tri, count(*) as n, string_agg(pos::varchar, ',' order by pos) as positions from t group by 1, 2")
def posting_lists(corpus):
    return ix.joined_lists(corpus)


WORD = "therea"
GRAMS = ", ".join(f"({i}, '{t}')" for i, t in px.pattern_trigrams(WORD))


@query(f"with {tri_cte()}, g(idx, tri) as (values {GRAMS}), f as (select g.idx::bigint as idx, g.tri, count(t.tri) as freq from g left join t using (tri) group by 1, 2) select * from (select * from f order by freq, idx limit 2)")
def selective_pair(spark, sf_dir):
    """The two rarest trigrams of a literal; the earlier wins ties."""
    g = spark.createDataFrame(px.pattern_trigrams(WORD), "idx bigint, tri string")
    p = ix.positions(docs(spark, sf_dir), [t for _, t in px.pattern_trigrams(WORD)])
    n = p.groupBy("tri").agg(F.count("*").alias("n"))
    return g.join(n, "tri", "left").select("idx", "tri", F.coalesce("n", F.lit(0)).alias("freq")).orderBy("freq", "idx").limit(2)


@query(f"with {tri_cte()}, g(idx, tri) as (values {GRAMS}), f as (select g.idx, g.tri, count(*) as freq from g join t using (tri) group by 1, 2) select arg_min(tri, freq * 100 + idx) as tri, min(freq) as freq from f")
def rarest_trigrams(spark, sf_dir):
    g = spark.createDataFrame(px.pattern_trigrams(WORD), "idx bigint, tri string")
    p = ix.positions(docs(spark, sf_dir), [t for _, t in px.pattern_trigrams(WORD)]).groupBy("tri").agg(F.count("*").alias("freq"))
    return p.join(g, "tri").agg(F.min_by("tri", F.struct("freq", "idx")).alias("tri"), F.min("freq").alias("freq"))


@query(f"with {tri_cte()} select a.file_idx, a.pos::bigint as pos from t a join t b on a.file_idx = b.file_idx and a.pos + 2 = b.pos where a.tri = 'the' and b.tri = 'ere'")
def distance_join(spark, sf_dir):
    p = ix.positions(docs(spark, sf_dir), ["the", "ere"])
    return px.distance_join(p.filter("tri = 'the'"), p.filter("tri = 'ere'"), 2)


@query(f"with {tri_cte()} select file_idx, pos::bigint as pos from t where tri = 'the' union select file_idx, pos::bigint from t where tri in ('The', 'THE')")
def posting_or_merge(spark, sf_dir):
    p = ix.positions(docs(spark, sf_dir), ["the", "The", "THE"])
    return px.merge(p.filter("tri = 'the'"), p.filter(F.col("tri").isin("The", "THE")))


@query(f"with {tri_cte()} select file_idx, pos::bigint as pos from t where tri in ({', '.join(repr(v) for v in posting_variants('the'))})")
def posting_case_union(spark, sf_dir):
    return ix.positions(docs(spark, sf_dir), posting_variants("the")).select("file_idx", "pos")


@over_documents(f"with {tri_cte()}, d as (select file_idx, tri, pos, pos - coalesce(lag(pos) over (partition by file_idx, tri order by pos), 0) as delta from t) select file_idx, tri, pos::bigint as pos, delta::bigint as delta from d")
def posting_deltas(corpus):
    return ix.posting_deltas(corpus)


@over_documents(f"with {tri_cte()} select file_idx, tri, string_agg(pos::varchar, ',' order by pos) as positions from t group by 1, 2")
def delta_roundtrip(corpus):
    return ix.joined_lists(corpus, stored_form=True).select("file_idx", "tri", "positions")


@over_documents(f"with {tri_cte()}, d as (select tri, pos - coalesce(lag(pos) over (partition by file_idx, tri order by pos), 0) as delta from t) select tri, sum(case when delta < 128 then 1 when delta < 16384 then 2 else 3 end)::bigint as bytes from d group by tri")
def posting_bytes(corpus):
    return ix.posting_bytes(corpus)


@query("select range::bigint * range * 7919 as value, greatest(1, ceil(length(bin(range::bigint * range * 7919)) / 7.0))::bigint as bytes, range::bigint * range * 7919 as decoded from range(0, 3000)")
def varint_roundtrip(spark, sf_dir):
    v = spark.range(3000).select((F.col("id") * F.col("id") * 7919).alias("value"))
    coded = v.withColumn("hex", tx.varint_encode(F.col("value")))
    return coded.select("value", (F.length("hex") / 2).cast("bigint").alias("bytes"), tx.varint_decode(F.col("hex")).alias("decoded"))


@query(f"with {tri_cte()} select distinct file_idx from t where tri = 'thi' intersect select distinct file_idx from t where tri = 'sho'")
def candidate_files_and(spark, sf_dir):
    p = ix.positions(docs(spark, sf_dir), ["thi", "sho"])
    return p.filter("tri = 'thi'").select("file_idx").intersect(p.filter("tri = 'sho'").select("file_idx"))


@query(f"with {tri_cte()} select distinct file_idx from t where tri = 'sch' union select distinct file_idx from t where tri = 'qua'")
def candidate_files_or(spark, sf_dir):
    p = ix.positions(docs(spark, sf_dir), ["sch", "qua"])
    return p.select("file_idx").distinct()


@over_documents(f"with {tri_cte()}, d as (select tri, row_number() over (order by tri) as rn, count(*) over () as n from (select distinct tri from t)) select least((rn - 1) // 256, greatest(0, ceil((n - 512) / 256.0)::bigint))::bigint as bucket, min(tri) as first_tri, count(*) as entries from d group by 1")
def bucket_directory(corpus):
    return ix.bucket_directory(ix.trigrams(corpus), 512)


# ---------------------------------------------------------------- through a stored index

#: No limit on trigrams, and a shard holds the longest admitted document; too small and binary documents stay out.
STORED = source.BuilderOptions(shard_max=16 << 20, file_max=16 << 20, trigram_max=16 << 20)


def _stored(spark, sf_dir):
    """An index of every admitted document, built once a session in the warehouse, which executors share."""
    name = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    tag = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sieveline-{spark.sparkContext.applicationId}-{name}"
    try:
        return ix.Index(spark, [tag])
    except ix.InvalidIndex:
        builder = ix.IndexBuilder(STORED)
        builder.add_extension("word_counts", word_counts)
        builder.build(docs(spark, sf_dir), tag)
        return ix.Index(spark, [tag])


def word_counts(corpus: DataFrame) -> DataFrame:
    """The sample extension: words of each file."""
    return corpus.select("file_idx", F.size(F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")).cast("bigint").alias("words"))


@over_index(literal_sql("there", where=ADMITTED))
def index_literal(index):
    return px.search(index, _q("there"))


@over_index(literal_sql("there", False, where=ADMITTED))
def index_literal_ci(index):
    return px.search(index, _q("there", case_sensitive=False))


@over_index(regex_sql("there[a-z]+ (?:on|of)", where=ADMITTED))
def index_regex(index):
    return px.search(index, _q("there[a-z]+ (on|of)", True))


@over_index(literal_sql("the", where=ADMITTED, tail="order by file_idx, byte_offset limit 40"))
def multi_shard_merge(index):
    return px.search(index, _q("the", max_matches=40))


@over_index(f"with {C} select file_idx, len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> ''))::bigint as words from c where {ADMITTED}")
def extension_section(index):
    return index.table("word_counts").select("file_idx", "words")


@over_index(f"""with {tri_cte(ADMITTED)}, g(idx, tri) as (values {GRAMS}), f as (select g.idx, g.tri, count(t.tri) as freq from g left join t using (tri) group by 1, 2),
two as (select min(idx) as i, max(idx) as j from (select idx from f order by freq, idx limit 2)),
cand as (select distinct a.file_idx, a.pos - two.i as pos from two join t a on a.tri = substring('{WORD}', two.i + 1, 3) join t b on b.tri = substring('{WORD}', two.j + 1, 3) and b.file_idx = a.file_idx and b.pos = a.pos + two.j - two.i where a.pos >= two.i),
d as (select t.tri, t.pos - coalesce(lag(t.pos) over (partition by t.file_idx, t.tri order by t.pos), 0) as delta from t, two where t.tri in (substring('{WORD}', two.i + 1, 3), substring('{WORD}', two.j + 1, 3))),
hits as (select count(*) as n from (select file_idx, text, unnest(generate_series(1, length(text) - {len(WORD) - 1})) as i from c where {ADMITTED} and contains(text, '{WORD}')) where substring(text, i, {len(WORD)}) = '{WORD}')
select {len(WORD) - 2}::bigint as ngram_lookups, (select count(*) from cand) as candidates_checked, (select n from hits) as matches_found, (select sum(case when delta < 128 then 1 when delta < 16384 then 2 else 3 end)::bigint from d) as bytes_loaded, true as used_trigram_filtering""")
def search_stats(index):
    return px.search_stats(index, _q(WORD))


@over_index(f"with {tri_cte(ADMITTED)}, d as (select tri, pos - coalesce(lag(pos) over (partition by file_idx, tri order by pos), 0) as delta from t) select count(distinct tri) as ngram_count, count(*) as posting_count, sum(case when delta < 128 then 1 when delta < 16384 then 2 else 3 end)::bigint as posting_bytes from d")
def index_counters(index):
    return index.counters()


@over_index(regex_sql("there[a-z]+ of", "i", where=ADMITTED))
def index_regex_ci(index):
    return px.search(index, _q("there[a-z]+ of", True, case_sensitive=False))


@over_index(f"with {C} select file_idx, path, md5(text) as text_md5 from c where {ADMITTED}")
def index_contents(index):
    """Every stored document as it is fetched."""
    return index.corpus.select("file_idx", "path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select conv_id * 1048576 + turn as file_idx, sum(1)::bigint as hits from (select conv_id, turn, text, unnest(generate_series(1, length(text) - 2)) as i from conversations where contains(text, 'the')) where substring(text, i, 3) = 'the' group by 1")
def literal_conversations(spark, sf_dir):
    return se.with_hits(source.load(spark, sf_dir, "conversations"), _q("the")).select("file_idx", F.size("hits").cast("bigint").alias("hits"))


@query(f"with {C}, w as (select file_idx, text, case when file_idx % 2 = 0 then text else text || chr(233) end as t from c) select file_idx, (len(string_split(text, 'the')) - 1)::bigint as hits from w where contains(text, 'the')")
def literal_bytes(spark, sf_dir):
    """The literal in documents of which every other one is no UTF-8: a byte E9 ends it."""
    d = docs(spark, sf_dir).filter(F.col("text").isNotNull())
    raw = F.col("text").cast("binary")
    content = F.when(F.col("file_idx") % 2 == 0, raw).otherwise(F.concat(raw, F.unhex(F.lit("E9"))))
    return se.with_hits(source.with_text(d.withColumn("content", content).drop("text")), _q("the")).select("file_idx", F.size("hits").cast("bigint").alias("hits"))
