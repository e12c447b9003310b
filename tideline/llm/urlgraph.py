"""URL filters: rules first, then trust and distrust over the host graph.

A page whose url fits a rule gets the longest fitting rule's verdict. For the
others the host decides: edges run from the host of a page to the hosts of its
absolute links (links inside a host are left out). Trust is personalised
PageRank along the edges from hosts with allowed pages; distrust is the same
along reversed edges from hosts with blocked pages, so it reaches those that
link to them. A seed's weight is the share of the host's pages with that
verdict. A host is blocked where distrust exceeds trust by ``margin``.

All of it is DataFrame operations. Links are pre-aggregated by pair of hosts,
scores are joined to edges (hosts with very many edges or pages dealt over
several parts) and summed with map-side combining, and each round is
checkpointed. Only blocked hosts are joined back to pages without a rule.

Null urls and urls without ``://`` have empty host and path, fit no rule and
are allowed. Null or empty html has no links, and a very long one is searched
whole. Of equally long rules that fit, the later in the alphabet counts.
Repeated rows are judged alike (and count as pages each); ids may be null. An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, heavy_keys, spread_join

# Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    at = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return at.select("*", rule.alias("rule"), verdict.alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): numbers of links between different hosts."""
    links = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(link).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, kind, score): kind 0 flows along the edges, kind 1 against them. ``seeds``: (host, kind, seed).

    A round shrinks the summed change by ``damping``, so the number of rounds
    after which no score can move by ``tolerance`` is known from the seeds; it
    stops earlier where none did.
    """
    rest = round(1 - damping, 12)  # 0.15 as SQL has it: 1 - 0.85 lies above it, which would tip ties at the margin
    edges = durable(edges)
    if edges.isEmpty():
        return seeds.select("host", "kind", (rest * F.col("seed")).alias("score"))
    along = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(0).alias("kind"), "n")
    flow = durable(along.union(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(1).alias("kind"), "n")))
    heavy = heavy_keys(flow, ["host", "kind"], flow.count())
    none = F.lit(0.0)
    start = flow.select("host", "kind", none.alias("seed"), "n").union(flow.select(F.col("to"), "kind", none, F.lit(0).cast("long"))).union(seeds.select("host", "kind", "seed", F.lit(0).cast("long")))
    start = durable(start.groupBy("host", "kind").agg(F.sum("seed").alias("seed"), F.sum("n").alias("links")))
    scores = start.select("host", "kind", "links", (rest * F.col("seed")).alias("score"))
    mass = start.agg(F.sum("seed")).first()[0] or 0.0
    rounds = max(1, math.ceil(math.log(tolerance / mass) / math.log(damping)) + 1) if mass > tolerance else 1
    for _ in range(rounds):
        sent = spread_join(flow, scores.select("host", "kind", F.try_divide("score", "links").alias("each")), ["host", "kind"], heavy)
        got = sent.groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("n") * F.col("each")).alias("got"))
        new = scores.select("host", "kind", F.col("score").alias("last")).join(start, ["host", "kind"]).join(got, ["host", "kind"], "left")
        new = durable(new.select("host", "kind", "links", "last", (rest * F.col("seed") + damping * F.coalesce("got", none)).alias("score")))
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("last")))).first()[0]
        scores = new.drop("last")
        if moved is None or moved < tolerance:
            break
    return scores.drop("links")


def judge(pages: DataFrame, rules=RULES, margin: float = 0.05, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    at = parsed(pages, rules)
    share = lambda what: F.avg(F.when(F.col("by_rule") == what, 1.0).otherwise(0.0))
    hosts = at.filter("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("seed")))).alias("s")).select("host", "s.kind", "s.seed").filter("seed > 0")
    scores = propagate(host_edges(pages), durable(seeds), damping)
    bad = scores.groupBy(F.col("host").alias("bad_host")).agg(F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(-F.col("score"))).alias("excess")).filter(F.col("excess") >= margin).select("bad_host")
    fitting = at.filter("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"))
    free = at.filter("by_rule is null").select("page_id", "host", "path", "rule")
    known = bad.select(F.col("bad_host").alias("host"), F.lit(True).alias("bad"))
    others = spread_join(free, known, ["host"], heavy_keys(free, ["host"], at.count()), "left").select("page_id", "host", "path", "rule", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    return fitting.unionByName(others)
