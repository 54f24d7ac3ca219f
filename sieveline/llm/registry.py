"""The llm queries, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules of the url query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), order="page_id")
    return out.select("page_id", "url", "text", "n_chars")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_counts

    return token_counts.counts(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counted = Scratch(spark, "quality").save(quality.counts(docs).drop("text"), "counts")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), counted=counted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP10_SQL = r"""
with lines as (
  select doc_id, text, md5(text) tie, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from documents where text is not null and doc_id is not null),
filled as (
  select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t,
         row_number() over (partition by doc_id, tie order by i) - 1 as n
  from lines where trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
wins as (
  select doc_id, tie, n, i as b,
         lead(i, 2) over w as e,
         t || chr(10) || lead(t, 1) over w || chr(10) || lead(t, 2) over w as g
  from filled window w as (partition by doc_id, tie order by n)),
ranked as (
  select *, row_number() over (partition by g order by doc_id, n) as k, count(*) over (partition by g) as m from wins where e is not null),
cover as (
  select f.doc_id, f.tie, f.n, f.i, bool_or(r.k = 1) as first from filled f join ranked r
  on r.doc_id = f.doc_id and r.tie = f.tie and r.m > 1 and f.n between r.n and r.n + 2 group by all),
goes as (
  select f.doc_id, f.tie, f.n, f.i, coalesce(not c.first, false) as out,
         lead(f.i) over w as next, lead(coalesce(not c.first, false)) over w as next_out
  from filled f left join cover c on c.doc_id = f.doc_id and c.tie = f.tie and c.n = f.n window w as (partition by f.doc_id, f.tie order by f.n)),
gone as (
  select distinct l.doc_id, l.tie, l.i from lines l join goes g
  on g.doc_id = l.doc_id and g.tie = l.tie and g.out and (l.i = g.i or g.next_out and l.i > g.i and l.i < g.next)),
rest as (
  select l.doc_id, l.tie, count(g.i) as n_removed,
         coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '') as kept
  from lines l left join gone g on g.doc_id = l.doc_id and g.tie = l.tie and g.i = l.i group by 1, 2)
select d.doc_id, coalesce(r.n_removed, 0)::bigint as n_removed,
       length(case when r.n_removed > 0 then r.kept else d.text end)::bigint as n_chars,
       md5(case when r.n_removed > 0 then r.kept else d.text end) as text_md5
from documents d left join rest r on r.doc_id = d.doc_id and r.tie = md5(d.text)
"""


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 75 * (nx.n + ny.n - k)),
e as (select x, y from l union select y, x from l),
r(doc_id, c) as (select x, x from e union select e.y, r.c from r join e on e.x = r.doc_id),
m as (select doc_id, min(c) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""

OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_ngram_jaccard, op3_url_filter, op4_topk, op5_byte_bpe, op6_toxicity, op7_html_text, op8_token_counts, op9_quality, op10_line_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op4_topk": OP4_SQL, "op10_line_dedup": OP10_SQL}
