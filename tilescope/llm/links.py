"""URL filters: host and path rules first, then trust and distrust spread over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import drop, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?([^"'>\x20\x09-\x0D]+)"""
DAMPING = 0.85
#: Verdicts round to nine decimals; no value is further off than this.
ERROR = 5e-10
FOLD = 8
MAX_DISTRUST = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def link_host(link: Column, own: Column) -> Column:
    """Host that a link on host ``own`` leads to; empty for schemes that lead to no host."""
    absolute = F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
    return (F.when(absolute.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), split_url(absolute)[0])
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit("")).otherwise(own))


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): each host with the rules (rule, path, verdict) of it and its parent domains, longest first.

    Only parents of as many labels as some rule's host has are made, so a host costs its length.
    """
    if not rules:
        return hosts.where("false").select("host", F.array(F.struct(*[F.lit("").alias(c) for c in ("rule", "path", "verdict")])).alias("rules"))
    table = hosts.sparkSession.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(h).alias("_rule_host"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules])))
    parents = hosts.select("host", F.explode(F.array_distinct(F.array(*[
        F.substring_index("host", ".", -k) for k in sorted({h.count(".") + 1 for _, h, _ in rules})]))).alias("_rule_host"))
    ordered = F.sort_array(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "path", "verdict")), asc=False)
    return parents.join(F.broadcast(table), "_rule_host").groupBy("host").agg(ordered.alias("rules"))  # as many rows as rules


def first_rule(rules: Column, path: Column) -> Column:
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, error: float = ERROR) -> DataFrame:
    """(host, trust, distrust) from (host, allowed, blocked) seeds over (source, target, n) host edges.

    Personalised PageRank as a sum of walks: trust moves along links, distrust against them, each in
    proportion to the number of links; every step keeps ``damping`` of it. Mass that reaches a host
    without links ends there. Steps go on until all moving mass together is below ``error``: what is left could
    add no more than that to any host, so every value is right within ``error``. Seeds of mass m take at most
    log(m / error) / log(1 / damping) steps. What hosts have received is summed up every FOLD steps.
    """
    def shares(kind, start, end):
        total = edges.groupBy(F.col(start).alias("_from")).agg(F.sum("n").alias("_all"))
        return (edges.join(total, F.col(start) == F.col("_from"))
                .select(F.lit(kind).alias("kind"), F.col("_from").alias("from"), F.col(end).alias("to"), (F.col("n") / F.col("_all") * damping).alias("share")))

    def summed(parts):
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("host", "kind").agg(F.sum("mass").alias("mass"))

    moves = keep(shares("trust", "source", "target").unionByName(shares("distrust", "target", "source")), "moves")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("allowed").cast("double"), F.lit("distrust"), F.col("blocked").cast("double"))).alias("kind", "mass"))
    step = keep(start.where("mass > 0"), "mass")
    held = [step]
    while True:
        step = keep(step.join(moves, (step["kind"] == moves["kind"]) & (step["host"] == moves["from"]))
                    .groupBy(moves["kind"], F.col("to").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("mass")).select("host", "kind", "mass"), "mass")
        if (step.agg(F.sum("mass")).first()[0] or 0.0) < error:
            drop(step)
            break
        held.append(step)
        if len(held) > FOLD:
            folded = keep(summed(held[:-1]), "mass")
            for t in held[:-1]:
                drop(t)
            held = [folded, step]
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)) * (1 - damping)
    out = keep(summed(held).groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust")), "spread")
    for t in (moves, *held):
        drop(t)
    return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], max_distrust: float = MAX_DISTRUST,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page.

    ``rules`` are (allow or block, host, path): a rule fits its host and all subdomains where the path
    starts with its path; the longest wins. Where none fits, the host decides: pages that rules allow
    are its trusted, pages that rules block its distrusted seeds, both spread over links between hosts
    (href values resolved against the page's host), and a host is blocked where distrust is more than
    ``max_distrust`` of both. A host that nothing reaches, and urls without a host (null or no ``://``),
    are allowed. Null html has no links. Repeated rows stay; other columns are not read.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    links = (pages.select(host.alias("source"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)).alias("link"))
             .select("source", link_host(F.col("link"), F.col("source")).alias("target"))
             .where("source <> '' and target <> '' and source <> target"))
    edges = keep(links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")), "links")
    fitting = keep(host_rules(rows.select("host").distinct(), rules), "rules")
    ruled = rows.where("host <> ''").join(fitting, "host").select("host", first_rule(F.col("rules"), F.col("path"))["verdict"].alias("verdict"))
    seeds = keep(ruled.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")), "seeds")
    masses = spread(seeds, edges, **how)
    blocked = F.round("distrust", 9) > F.round((F.col("trust") + F.col("distrust")) * max_distrust, 9)
    hosts = keep(fitting.join(masses.select("host", blocked.alias("blocked")), "host", "full"), "hosts")
    rule = first_rule(F.col("rules"), F.col("path"))
    return (rows.join(hosts, "host", "left")
            .select("page_id", "host", "path", rule["rule"].alias("rule"),
                    F.coalesce(rule["verdict"], F.when(F.col("blocked"), F.lit("block")).otherwise("allow")).alias("verdict")))
