"""URL filters with trust from the link graph.

Rules (host and path) decide the urls they fit. For the others, pages vote
through their links: trust starts from hosts with allowed pages and follows
links forward (personalised PageRank); distrust starts from hosts with blocked
pages and follows links backward, to hosts that point at them. Links between
pages are summed up to weighted edges between hosts first. A host whose share
of distrust among both exceeds a threshold is blocked.

Everything is built-in DataFrame functions; ranks are written in the shared
folder after each round. Edges leave their source summed up for each target,
and ranks meet edges in joins whose large keys Spark splits.

A NULL url, or one without ``://``, has an empty host and path. NULL or empty
html has no links. Rows are judged one by one, so repeated rows each get a
verdict (their links count each time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignals.llm.common import ascii_lower, written

#: Share of a rank that follows links, the other part returns to the seeds.
DAMPING = 0.85
#: Rounds end when no host's trust or distrust changes by more than this share of itself. A host that is reached for
#: the first time changes by all of it, so every host that links reach gets its ranks, however far it is; from the last
#: one on, log(TOLERANCE) / log(DAMPING), about 85, more rounds do.
TOLERANCE = 1e-6
#: Share of distrust above which a host is blocked.
THRESHOLD = 0.5
#: Absolute links in html: the host and what follows.
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s"'<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, verdict) that fits, as text, and its
    verdict; NULL without one. ``rules`` is a parameter, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]], key: str, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src``, ``dst``, ``w``: links between different hosts, as a share of those that leave ``src``."""
    host, _ = host_and_path(F.col(url).cast("string"))
    targets = F.regexp_extract_all(F.col(html).cast("string"), F.lit(LINK), 1)
    links = pages.select(host.alias("src"), F.explode(targets).alias("to")).select(
        "src", ascii_lower(F.regexp_extract("to", r"^[^/?#]*", 0)).alias("dst"))
    links = links.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares_by(edges: DataFrame, end: str) -> DataFrame:
    total = edges.groupBy(end).agg(F.sum("n").alias("total"))
    return edges.join(total, end).select("src", "dst", (F.col("n") / F.col("total")).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
              ) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host that either reaches.

    ``seeds`` has ``host``, ``trust`` and ``distrust`` (each sums to 1, or to
    0). A rank that finds no link to follow is lost, not dealt anew: it could
    only raise all seeds alike.
    """
    forward = shares_by(edges, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), "w")
    backward = shares_by(edges, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), "w")
    links = written(forward.withColumn("kind", F.lit("trust")).union(backward.withColumn("kind", F.lit("distrust"))),
                    "links")
    base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"),
                        (F.col("distrust") * (1 - damping)).alias("distrust"))
    ranks = base
    while True:
        sent = ranks.join(links, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.when(F.col("kind") == "trust", F.col("trust") * F.col("w")).otherwise(0.0) * damping).alias("trust"),
            F.sum(F.when(F.col("kind") == "distrust", F.col("distrust") * F.col("w")).otherwise(0.0) * damping).alias(
                "distrust"))
        after = written(base.union(sent).groupBy("host").agg(
            F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
        old = ranks.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = after.join(old, "host", "left").agg(F.max(F.greatest(*[
            F.when(F.col(now) > 0, F.abs(F.col(now) - F.coalesce(before, F.lit(0.0))) / F.col(now)).otherwise(0.0)
            for now, before in (("trust", "t"), ("distrust", "d"))])))
        ranks, change = after, moved.first()[0]
        if not change or change < tolerance:
            break
    return ranks


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url",
           html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (NULL without one), ``verdict``, and the host's ``trust`` and
    ``distrust`` (0 where nothing reaches it; a page without rule on such a host is allowed)."""
    rows = judged_by_rules(pages, rules, key, url)
    votes = rows.where("rule_verdict IS NOT NULL AND host <> ''").groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("allowed"),
        F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    votes = written(votes, "seeds")
    allowed, blocked = votes.agg(F.sum("allowed"), F.sum("blocked")).first()
    seeds = votes.select("host", (F.col("allowed") / float(allowed or 1)).alias("trust"),
                         (F.col("blocked") / float(blocked or 1)).alias("distrust"))
    edges = written(host_edges(pages, url, html), "edges")
    ranks = propagate(edges, seeds).select(F.col("host").alias("h"), "trust", "distrust")
    both = rows.join(ranks, rows["host"] == F.col("h"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > threshold * (trust + distrust), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(key, "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"),
                       F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
