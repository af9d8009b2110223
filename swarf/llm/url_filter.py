"""URL verdicts: host and path rules first, then trust and distrust propagated over the link graph of hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed, unpacked, with_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""

#: Rounds of propagation between two comparisons.
ROUNDS = 3
#: (rule, verdict) of the registered query; a rule is a host and a path prefix.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), null without one; the rule list is configuration, not data."""

    def fits(rule: str) -> Column:
        name, _, prefix = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    found = [F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for rule, verdict in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Distinct links between different hosts as (_from, _to, _links); counts are combined before the shuffle.

    Links without a host stay within their page's host and so add no edge.
    """
    links = pages.select(host_of(F.col(url_col)).alias("_from"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("_link"))
    full = F.when(F.col("_link").startswith("//"), F.concat(F.lit("x:"), F.col("_link"))).otherwise(F.col("_link"))
    pairs = links.select("_from", host_of(full).alias("_to")).filter("_from != '' AND _to != '' AND _from != _to")
    return pairs.groupBy("_from", "_to").agg(F.count(F.lit(1)).alias("_links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank per kind: seeds (_kind, _host, _seed) over edges (_kind, _from, _to, _share).

    Mass that reaches a host without outgoing edges ends there.  Each round is one join and one combined sum; the frame
    of ranks has at most one row per kind and host.  After every ROUNDS rounds the ranks are written and compared with
    those before; it ends when all masses together moved by at most ``tolerance``.  The moving mass shrinks by
    ``damping`` a round, so that takes at most log(tolerance) / log(damping) rounds and a few more; without edges two
    comparisons suffice.
    """
    ranks = seeds.select("_kind", "_host", F.col("_seed").alias("_mass"))
    base = seeds.select("_kind", "_host", (F.col("_seed") * (1 - damping)).alias("_mass"))
    while True:
        before = ranks
        for _ in range(ROUNDS):
            flow = ranks.withColumnRenamed("_host", "_from").join(edges, ["_kind", "_from"]).select("_kind", F.col("_to").alias("_host"), (F.col("_mass") * F.col("_share") * damping).alias("_mass"))
            ranks = base.unionByName(flow).groupBy("_kind", "_host").agg(F.sum("_mass").alias("_mass"))
        ranks = checkpointed(ranks)
        both = ranks.unionByName(before.withColumn("_mass", -F.col("_mass")))
        moved = both.groupBy("_kind", "_host").agg(F.abs(F.sum("_mass")).alias("_moved")).agg(F.sum("_moved")).first()[0]
        if not moved or moved <= tolerance:
            return ranks


def host_trust(ruled: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Per host: _trust from hosts with allowed pages along links, _distrust from hosts with blocked pages against them.

    ``ruled`` has _host and _verdict of the pages that a rule decided; a host's seed is its part of those pages, so the two
    masses of one host can be compared.
    """
    counted = ruled.groupBy("_host", "_verdict").agg(F.count(F.lit(1)).alias("_pages"))
    total = counted.agg(F.sum("_pages")).first()[0] or 1
    seeds = checkpointed(counted.select(F.when(F.col("_verdict") == "allow", "trust").otherwise("distrust").alias("_kind"), "_host", (F.col("_pages") / F.lit(float(total))).alias("_seed")))
    both = reduce(DataFrame.unionByName, [edges.select(F.lit("trust").alias("_kind"), "_from", "_to", "_links"), edges.select(F.lit("distrust").alias("_kind"), F.col("_to").alias("_from"), F.col("_from").alias("_to"), "_links")])
    leaving = both.groupBy("_kind", "_from").agg(F.sum("_links").alias("_all"))
    shares = checkpointed(both.join(leaving, ["_kind", "_from"]).select("_kind", "_from", "_to", (F.col("_links") / F.col("_all")).alias("_share")))
    ranks = propagate(seeds, shares, damping, tolerance)
    mass = lambda kind: F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col("_mass"))), F.lit(0.0))
    return ranks.groupBy("_host").agg(mass("trust").alias("_trust"), mass("distrust").alias("_distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, most_distrust: float = 2 / 3, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages (without html) with _host, _path, _rule, _verdict, _trust and _distrust.

    A page without a rule is blocked when its host's distrust is more than ``most_distrust`` of the host's whole mass;
    hosts without mass are allowed.  The link graph is between hosts: edges are counted before any shuffle, and one hot
    host is one row of it.  Pages meet their host's masses in an ordinary join that Spark may split when skewed.

    Null urls and urls without "://" have an empty host and path, no rule, and are allowed; null html has no links;
    repeated pages count one by one; an empty table gives an empty result; other columns pass through, but those named like an added one.
    """
    kept = pages.drop(html_col)
    parts = with_row(kept, _host=host_of(F.col(url_col)), _path=path_of(F.col(url_col)))
    ruled = parts.withColumn("_found", rule_of(F.col("_host"), F.col("_path"), rules))
    decided = ruled.filter(F.col("_found").isNotNull()).select("_host", F.col("_found.verdict").alias("_verdict"))
    trust = host_trust(decided, host_edges(pages, url_col, html_col))
    joined = ruled.join(trust, "_host", "left").fillna(0.0, ["_trust", "_distrust"])
    bad = F.col("_distrust") > (F.col("_trust") + F.col("_distrust")) * most_distrust
    verdict = F.coalesce(F.col("_found.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    judged = joined.select("_row", "_host", "_path", F.col("_found.rule").alias("_rule"), verdict.alias("_verdict"), "_trust", "_distrust")
    return unpacked(judged, kept, "_host", "_path", "_rule", "_verdict", "_trust", "_distrust")


def op4_url_filter(pages: DataFrame) -> DataFrame:
    judged = judge(pages.select("page_id", "url", "html"))
    return judged.select("page_id", *[F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict", "trust", "distrust")])
