"""URL filters by rules and link-graph propagation (DataFrame functions only).

A rule (action, host, path prefix) fits its host and all subdomains if the url's path starts with its path; of those
that fit the longest wins (host and path together; then the longer host, then the first listed). Pages without a rule
get their host's verdict: host edges are the absolute links in the pages' html, and weak edges of `kinship` links both
ways between a host and its parent domain (www.a.example.com, a.example.com, example.com), as who holds the domain runs
the hosts below it. Trust flows along links from hosts with allowed pages (personalised PageRank, seeded with the allowed
share of the host's pages), distrust flows against them from hosts with blocked pages, so who links to blocked hosts is
distrusted. A host is blocked if its distrust is at least `threshold` and more than its trust, both in units of the
teleport share.

Edges are counted per pair of hosts before anything is joined, so a host with a third of all pages is one row with
partial sums; a domain with very many hosts is a sum too, combined before the shuffle. A round is one join and one sum
over host edges; UNROLL rounds are one job, written to the shared folder. Rounds end when the largest change of a job is
below `tolerance`, which is so after log(tolerance / seed mass) / log(damping) rounds at most, as all changes of a round
add up to no more than `damping` of the last one's. Without edges there is no round.

Nulls and edges: a null url or one without :// has an empty host and path, fits no rule and is allowed; the empty host
is no node. A null html has no links, and the last of a very long one counts like its first. Repeated pages count each.
An empty table gives no rows. Extra columns pass through; host, path, rule and verdict are replaced.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: A host's parent domain: what follows its first label, if that has two labels or more and is no number.
PARENT = r"^[^.]+\.([^.]+(?:\.[^.]+)*\.[^.:0-9]+(?::[0-9]+)?)$"
#: Rules are part of the plan; beyond so many they belong in a table.
MAX_RULES = 1000
#: Rounds of one job.
UNROLL = 4


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matched(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, action) of the rule that wins, or null. rules: (action, host, path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    best = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<rule:string,action:string>")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, w): links from pages of one host to another."""
    links = pages.select(host_of(quoted(url)).alias("src"), F.explode(F.regexp_extract_all(quoted(html), F.lit(HREF), F.lit(1))).alias("to"))
    absolute = F.when(F.startswith(F.col("to"), F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    links = links.select("src", host_of(absolute).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("w"))


def kin_edges(hosts: DataFrame, weight: float = 1.0) -> DataFrame:
    """(src, dst, w): both ways between hosts (host) and their parent domains, and those domains and theirs."""
    up = hosts.filter("host <> ''").select("host").distinct()
    parent = lambda c: F.nullif(F.regexp_extract(c, PARENT, 1), F.lit(""))
    one = up.select(F.col("host").alias("a"), parent(F.col("host")).alias("b")).filter("b is not null")
    two = one.select(F.col("b").alias("a"), parent(F.col("b")).alias("b")).filter("b is not null")
    both = one.unionByName(two).distinct()
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(both.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("w", F.lit(weight))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust). edges: (src, dst, w), a row for each link or with their sum. seeds: (host, good, bad), shares from 0 to 1."""
    edges = scratch.save(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
    state = scratch.save(seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "state0")
    if edges.isEmpty():
        return state
    out_w = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    in_w = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    flow = edges.join(out_w, "src").join(in_w, "dst").select("src", "dst", (F.col("w") / F.col("out_w")).alias("along"), (F.col("w") / F.col("in_w")).alias("against"))
    # a row for each end: what flows into `host` from `peer`
    flow = flow.select(F.col("dst").alias("host"), F.col("src").alias("peer"), F.col("along").alias("t_share"), F.lit(0.0).alias("d_share")).unionByName(
        flow.select(F.col("src").alias("host"), F.col("dst").alias("peer"), F.lit(0.0).alias("t_share"), F.col("against").alias("d_share")))
    flow = scratch.save(flow.groupBy("host", "peer").agg(F.sum("t_share").alias("t_share"), F.sum("d_share").alias("d_share")), "flow")
    start = seeds.select("host", (F.col("good") / damping).alias("t"), (F.col("bad") / damping).alias("d"))
    mass = seeds.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 0.0
    most = ceil(log(tolerance / max(1.0, mass)) / log(damping)) + 1
    for k in range(1, ceil(most / UNROLL) + 1):
        new = state
        for _ in range(UNROLL):
            here = new.select(F.col("host").alias("peer"), "trust", "distrust")
            came = flow.join(here, "peer").select("host", (F.col("t_share") * F.col("trust")).alias("t"), (F.col("d_share") * F.col("distrust")).alias("d"))
            new = came.unionByName(start).groupBy("host").agg((damping * F.sum("t")).alias("trust"), (damping * F.sum("d")).alias("distrust"))
        new = scratch.save(new, f"state{k}")
        old = state.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = new.join(old, "host", "left").agg(F.max(F.greatest(F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0)))))).first()[0]
        scratch.drop(f"state{k - 1}")
        state = new
        if moved is None or moved < tolerance:
            break
    return state


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html", threshold: float = 0.5, kinship: float = 1.0, **kw) -> DataFrame:
    """pages without html, with host, path, rule and verdict. kinship: weight of a weak edge, in links; 0 for none."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    own = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c not in (*own, html)]
    match, bad_host, bad_verdict = unused([*pages.columns, *own], "_match", "_host", "_verdict")
    kept = [quoted(c) for c in names]
    parts = pages.select(*kept, host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path"))
    ruled = parts.withColumn(match, matched(rules, F.col("host"), F.col("path")))
    share = lambda a: F.avg(F.when(F.col(f"{match}.action") == a, 1.0).otherwise(0.0))
    hosts = scratch.save(ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "hosts")
    edges = host_edges(pages, url, html)
    if kinship:
        edges = edges.unionByName(kin_edges(hosts.select("host").unionByName(edges.select(F.col("dst").alias("host"))), kinship))
    score = propagate(edges, hosts.filter("good > 0 or bad > 0"), scratch, **kw)
    bad = score.filter((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias(bad_host), F.lit("block").alias(bad_verdict))
    joined = ruled.join(bad, F.col("host") == F.col(bad_host), "left")
    return joined.select(*kept, "host", "path", F.col(f"{match}.rule").alias("rule"), F.coalesce(F.col(f"{match}.action"), F.col(bad_verdict), F.lit("allow")).alias("verdict"))
