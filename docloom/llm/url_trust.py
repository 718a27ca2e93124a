"""URL filters: rules first, then trust and distrust spread over the host graph.

Personalised PageRank runs from trusted hosts along links, and from blocked
hosts against them (who links to a blocked host earns distrust). The host edges
are counted in Spark before anything iterates, so a page or host with very many
links is one weighted edge per target.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is allowed; a null html has no links; repeated pages are
judged alike; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower

Rule = tuple[str, str, str]

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: So many hosts' scores (some 100 bytes each) are sent to all tasks.
MOST_BROADCAST = 200_000
SALTS = 16
#: Rounds of a walk in one job.
ROUNDS = 8
LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    none = F.lit(None).cast("string")
    name = reduce(lambda rest, r: F.when(_fits(r, host, path), F.lit(r[1] + r[2])).otherwise(rest), reversed(ordered), none)
    verdict = reduce(lambda rest, r: F.when(_fits(r, host, path), F.lit(r[0])).otherwise(rest), reversed(ordered), none)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted. ``pages`` has host and html."""
    links = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("link")).select("src", host_of(target).alias("dst"))
    return found.where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def personalised_rank(hosts: DataFrame, edges: DataFrame, seed: str, damping: float = 0.85, tol: float = 1e-4) -> DataFrame:
    """(host, rank, mass): what spreads from ``seed`` weights along ``edges`` (src, dst, weight); ``hosts`` has (host, seed weight), each host of an edge among them.

    ``mass`` is a host's seed and ``damping`` times what its links bring, so it
    depends on the hosts that lead to a host alone, however many others there are.
    ``rank`` is its share of all mass: the personalised PageRank with restart, and
    the mass of hosts without links, on the seeds.

    Rounds move on what the round before brought, until that is less than ``tol``
    for each host. A round moves ``damping`` times as much as the one before at
    most, so they come to an end. ``ROUNDS`` of them are one job, whose outcome is
    checkpointed.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    stay = hosts.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))
    steps = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")).unionByName(stay).checkpoint()
    now = hosts.select("host", F.col(seed).alias("mass"), F.col(seed).alias("moving"))
    brought = damping * F.col("share") * F.col("moving")
    while (now.agg(F.max("moving")).first()[0] or 0) >= tol:
        for _ in range(ROUNDS):
            met = now.withColumnRenamed("host", "src").join(steps, "src")
            now = met.groupBy(F.col("dst").alias("host")).agg(F.sum(F.coalesce(brought, "mass")).alias("mass"), F.sum(F.coalesce(brought, F.lit(0.0))).alias("moving"))
        now = now.checkpoint()
    total = now.agg(F.sum("mass")).first()[0]
    return now.select("host", (F.col("mass") / F.lit(total) if total else F.lit(0.0)).alias("rank"), "mass")


def with_scores(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """``pages`` left joined with ``scores`` by host. A host may have very many pages: few scores go to all tasks, more meet their pages in ``SALTS`` places."""
    if scores.count() <= MOST_BROADCAST:
        return pages.join(F.broadcast(scores), "host", "left")
    every = scores.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(every, ["host", "__salt"], "left").drop("__salt")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 1e-2, damping: float = 0.85, tol: float = 1e-4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits gets the rule's verdict. Any other page gets its
    host's: block if the host's mass of distrust is at least ``threshold`` and
    above its mass of trust, else allow. Seeds are the hosts of pages that allow
    rules (trusted) or block rules (blocked) fit, weighted by their numbers of such
    pages, so masses are in pages and a host with one blocked page has one at
    least, whatever the other hosts are. ``trust`` and ``distrust`` are the ranks.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    pages = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = pages.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    edges = host_edges(pages).checkpoint()
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").cast("double").alias("allowed"), F.count_if(F.col("ruled") == "block").cast("double").alias("blocked")
    )
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = seeds.join(linked, "host", "full_outer").select("host", F.coalesce("allowed", F.lit(0.0)).alias("allowed"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")).checkpoint()
    trust = personalised_rank(hosts, edges, "allowed", damping, tol)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(hosts, against, "blocked", damping, tol)
    scores = trust.withColumnsRenamed({"rank": "trust", "mass": "good"}).join(distrust.withColumnsRenamed({"rank": "distrust", "mass": "ill"}), "host").checkpoint()
    bad = (F.col("ill") >= threshold) & (F.col("ill") > F.col("good"))
    return with_scores(ruled, scores).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust"
    )
