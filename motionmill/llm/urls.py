"""Allow and block verdicts for urls: rules first, then trust and distrust over the link graph of hosts.

Hosts under an allow rule seed a personalised PageRank along the links; hosts under a block rule seed the same walk
against the links, since who links to a blocked host is to be distrusted. A url that no rule fits is blocked where its
host's distrust exceeds its trust by more than ``margin``, else allowed; a host that neither walk reaches has 0 of
both. Mass that reaches a host without links ends there. Scores shrink as the table grows, so they are compared and
tested for convergence relative to themselves.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed. Null html has no links.
Repeated rows count as often as they appear. Only the columns page_id, url and html are read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motionmill.llm._shared import cut, table

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rules are a short list of the caller's, compiled into one expression.
MAX_RULES = 256
#: Walks end when no host's score changes by more than this share of it in four rounds; scores closer than ``TIE`` are equal.
CHANGE = 1e-6
TIE = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Relative links stay on their host and are left out."""
    target = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    links = pages.select(url_host(F.col("url")).alias("src"), target.alias("to"))
    whole = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    found = links.select("src", url_host(whole).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) after ``rounds``, or when they no longer change. ``seeds``: host, trust, distrust, each at least 0; each kind is scaled to sum 1.

    Both walks run in one table, told apart by ``kind``. What a host has handed on is summed before the exchange.
    """
    kinds = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out = kinds.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    edges = cut(kinds.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share")))
    long = seeds.select("host", F.expr("stack(2, 'trust', cast(trust as double), 'distrust', cast(distrust as double)) as (kind, mass)")).where("mass > 0")
    total = long.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = cut(long.join(F.broadcast(total), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass")))
    rank = before = start
    for k in itertools.count() if not edges.isEmpty() else ():
        if k == rounds:
            break
        passed = rank.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        rank = passed.unionByName(start.withColumn("mass", F.col("mass") * (1 - damping))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % 4 == 3 or k + 1 == rounds:
            rank = cut(rank)
            old = before.withColumnRenamed("mass", "old")
            if rounds is None and rank.join(old, ["kind", "host"], "left").where(F.abs(F.col("mass") - F.coalesce("old", F.lit(0.0))) > CHANGE * F.col("mass")).isEmpty():
                break
            before = rank
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], margin: float = 0.0, rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    counted = lambda v: F.count(F.when(F.col("hit.verdict") == v, 1))
    seeds = urls.where("host <> '' and hit is not null").groupBy("host").agg(counted("allow").alias("trust"), counted("block").alias("distrust"))
    scores = propagate(host_links(pages), seeds, rounds=rounds)
    distrusted = cut(scores.where(F.col("distrust") > F.col("trust") * (1 + TIE) + margin).select("host", F.lit("block").alias("own")))
    return urls.join(distrusted, "host", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "own", F.lit("allow")).alias("verdict")
    )


def op9_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)
