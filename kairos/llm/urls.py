"""URL filters: rules first, then trust and distrust carried along host links.

A rule (host, path) judges the urls of its host and all subdomains whose path
starts with the rule's; the longest rule wins. Pages no rule judges get their
host's verdict, which comes from the link graph:

* Nodes are hosts, edges links between them: from a page's host to each host
  its html refers to (once per page), and between a host and its parent domain.
* Trust is personalised PageRank along the edges, seeded by the pages that
  rules allow. Distrust is the same on the reversed edges, seeded by the pages
  that rules block: who links to blocked hosts is distrusted. Both seeds are
  scaled to the same sum, the number of pages (0 if no page was judged so);
  pages no rule judges say nothing for their host. Every host receives. What a
  host without a way on holds goes back to the seeds: a rank is scaled up to
  its seeds' sum at the end, which is the same as dealing it out by the seeds
  in every round.
* ``ROUNDS`` follows from ``TOLERANCE``: a round leaves ``DAMPING`` of what is
  not settled, so after all rounds that is at most TOLERANCE of the sum, for
  any graph, and mass has gone as many links far.
* A host is blocked if its distrust is more than ``THRESHOLD`` of the sum; a
  host that neither rank reaches is allowed.

Edges are summed up per host pair before the first round and ranks are one row
per host, so a round is one join and one combined sum; every few rounds a
table is written.

Defined cases: null urls and urls without ``://`` have host and path '' and
follow the verdict of host '', which links nowhere; a null html has no links;
repeated rows count each; columns besides page_id, url and html are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import lower_ascii, materialize, pick

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)[ \t]*=[ \t]*["']?(?:https?:)?//([^/?#"'<>\\ \t\r\n]+)"""
PARENT = r"^[^.]+\.([^.]+\..+)$"  # of a host of three labels or more
# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, ROUNDS_A_TABLE = 0.85, 1e-3, 4
ROUNDS = ceil(log(TOLERANCE) / log(DAMPING))
THRESHOLD = 0.5


def by_length(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null: none)."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in reversed(by_length(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _last_labels(n: Column) -> Column:
    return F.call_function("substring_index", F.col("host"), F.lit("."), n)


def host_edges(pages: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: links between different hosts, summed up. ``pages`` has ``host`` and ``html``."""
    linked = pages.select(F.col("host").alias("a"), F.explode(F.array_distinct(
        F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lower_ascii))).alias("b"))
    links = linked.where("a <> '' AND b <> '' AND a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    links = materialize(links, "links")
    # every host and its parents up to a domain of two labels; depth is the labels of a host name, 127 at most
    hosts = pages.select("host").where("host <> ''").distinct().unionByName(links.select(F.col("b").alias("host"))).distinct()
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.struct(
        _last_labels(-(i + 1)).alias("a"), _last_labels(-i).alias("b"))),
        lambda e: (e["a"] != e["b"]) & e["b"].contains("."))
    family = hosts.select(F.inline(above)).distinct()
    both = family.select("a", "b", F.lit(1).alias("n")).unionByName(family.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("n")))
    return links.unionByName(both).groupBy("a", "b").agg(F.sum("n").alias("n"))


def host_scores(pages: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host. ``pages`` has ``host``, ``html`` and ``judged`` (verdict of a rule or null)."""
    edges = materialize(host_edges(pages), "edges")
    flow = edges.select(F.lit("trust").alias("kind"), "a", "b", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    out = flow.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    flow = materialize(flow.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("part")), "flow")
    say = {"trust": "allow", "distrust": "block"}
    said = materialize(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), *[
        F.count(F.when(F.col("judged") == v, 1)).alias(k) for k, v in say.items()]), "said")
    sums = said.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", *say)]).first()
    scale = {k: sums["pages"] / sums[k] if sums[k] else 0.0 for k in say}
    seeds = said.select(F.col("host").alias("a"), F.explode(F.create_map(*[
        x for k in say for x in (F.lit(k), F.col(k) * F.lit(scale[k]))])).alias("kind", "seed"))
    nodes = flow.select("kind", "a").unionByName(flow.select("kind", F.col("b").alias("a"))).distinct()
    seeds = materialize(seeds.join(nodes, ["kind", "a"], "full").select("kind", "a", F.coalesce("seed", F.lit(0.0)).alias("seed")), "seeds")
    ranks = seeds.select("kind", "a", F.col("seed").alias("mass"))
    for r in range(1, ROUNDS + 1):
        came = flow.join(ranks, ["kind", "a"]).groupBy("kind", "b").agg(F.sum(F.col("mass") * F.col("part")).alias("came"))
        ranks = seeds.join(came.withColumnRenamed("b", "a"), ["kind", "a"], "left").select(
            "kind", "a", ((1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce("came", F.lit(0.0))).alias("mass"))
        if r % ROUNDS_A_TABLE == 0 or r == ROUNDS:
            ranks = materialize(ranks, "ranks")
    # two numbers: what of either rank has gone to hosts without a way on
    held = {r["kind"]: r["held"] for r in ranks.groupBy("kind").agg(F.sum("mass").alias("held")).collect()}
    up = {k: sums["pages"] / held[k] if sums[k] and held.get(k) else 0.0 for k in say}
    ranks = ranks.withColumn("mass", F.col("mass") * F.when(F.col("kind") == "trust", up["trust"]).otherwise(up["distrust"]))
    return ranks.groupBy(F.col("a").alias("host")).agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in say])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the host's ``trust`` and ``distrust``, for every row."""
    p = pick(pages, "page_id", "url", "html")
    host, path = split_url(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"), "html")
    text, verdict = match_rule(F.col("host"), F.col("path"), rules)
    p = p.select("*", text.alias("rule"), verdict.alias("judged"))
    scores = host_scores(p)
    blocked = F.round(F.col("distrust") - THRESHOLD * (F.col("trust") + F.col("distrust")), 9) > 0
    return p.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("judged", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
