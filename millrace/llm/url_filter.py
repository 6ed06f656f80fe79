"""URL filters: rules first, then trust and distrust propagated over links between hosts.

Trust is personalised PageRank from the trusted hosts along links; distrust is the same
from the blocked hosts against the links, for who links to bad hosts is suspect. A host is
blocked where its distrust is greater than its trust.

Scores are whole numbers (parts of ``MASS``), rounded down per link, so they are equal
in every run, whatever the order of summation. Rounds go on until scores change by no more than ``TOLERANCE`` of
all there is; what has not arrived by then is less than that in all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh, lower_ascii
from .storage import materialise

MASS = 10**15
DAMPING = 0.85
#: Share of ``MASS`` that scores may still change by, summed over hosts, when the rounds end.
TOLERANCE = 1e-6
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z in lower case; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, ``host/path``) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains, for paths that start with its own.
    """
    entries = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        entries.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*entries) if entries else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame, *, host: str = "host", html: str = "html") -> DataFrame:
    """Links between different hosts, with the number of them: source, target, weight."""
    targets = F.transform(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)), lower_ascii)
    links = pages.select(F.col(host).alias("source"), F.explode(targets).alias("target"))
    links = links.where((F.col("source") != "") & (F.col("source") != F.col("target")))
    return links.groupBy("source", "target").agg(F.count("*").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Scores by ``kind`` and ``host``, when they have settled.

    ``seeds``: kind (``trust`` or ``distrust``), host and share (whole numbers, up to ``MASS`` per kind). Both
    kinds travel in one table, trust along the links and distrust against them. Each
    round is a join on the host and a sum; a host that a third of all links leave or
    enter is split by the skew join or summed before the shuffle.
    """
    along = links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "weight")
    against = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "weight")
    edges = materialise(along.unionByName(against), "host-links")
    if edges.isEmpty():
        return seeds.select("kind", "host", F.col("share").alias("score"))
    out = edges.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    edges = materialise(edges.join(out, ["kind", "host"]), "host-edges")
    base = seeds.select("kind", "host", F.col("share").alias("score"))
    none = F.lit(0).cast("bigint")
    scores = base
    # Each round passes on no more than ``damping`` of what the last one changed, so this many are always enough.
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping)) + 1):
        passed = F.floor(F.col("score").cast("double") * F.lit(damping) * F.col("weight") / F.col("total"))
        moved = edges.join(scores, ["kind", "host"]).select("kind", F.col("to").alias("host"), passed.alias("score"), none.alias("was"))
        kept = base.select("kind", "host", F.floor(F.col("score").cast("double") * F.lit(1 - damping)).alias("score"), none.alias("was"))
        before = scores.select("kind", "host", none.alias("score"), F.col("score").alias("was"))
        summed = moved.unionByName(kept).unionByName(before).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
        summed = materialise(summed, "host-scores")
        change = summed.agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("change")).first()["change"] or 0
        scores = summed.select("kind", "host", "score")
        if change <= tolerance * MASS:
            break
    return scores


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], *, url: str = "url", html: str = "html", seed_share: float = 0.5,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``) to every row.

    The longest rule that fits decides. Other pages take their host's verdict. A host is a
    seed of trust or distrust if rules allow or block more than ``seed_share`` of its pages.
    A host without any score is allowed. A null url, or one without ``://``, has an
    empty host and path, fits no rule and is allowed; null html has no links.
    Repeated rows count as pages of their own. Columns of the four names are replaced.
    """
    pages = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    match, bad_host = fresh(pages, "match", "bad_host")
    pages = pages.withColumn(match, matching_rule(F.col("host"), F.col("path"), rules))
    by_host = pages.where(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(f"{match}.verdict") == "allow").alias("allowed"),
        F.count_if(F.col(f"{match}.verdict") == "block").alias("blocked"),
    )
    of = lambda kind, n: by_host.where(F.col(n) > F.lit(seed_share) * F.col("n")).select(F.lit(kind).alias("kind"), "host")
    seeds = materialise(of("trust", "allowed").unionByName(of("distrust", "blocked")), "url-seeds")
    sizes = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}  # at most two rows
    share = F.when(F.col("kind") == "trust", MASS // sizes.get("trust", 1)).otherwise(MASS // sizes.get("distrust", 1))
    scores = propagate(host_links(pages, html=html), seeds.withColumn("share", share))
    bad = scores.groupBy(F.col("host").alias(bad_host)).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0)).alias("distrust"),
    )
    bad = bad.where(F.col("distrust") > F.col("trust")).select(bad_host)
    judged = pages.join(bad, F.col("host") == F.col(bad_host), "left")
    method = F.when(F.col(bad_host).isNotNull(), "block").otherwise("allow")
    return judged.withColumns(
        {"rule": F.col(f"{match}.rule"), "verdict": F.coalesce(F.col(f"{match}.verdict"), method)}
    ).drop(match, bad_host)
