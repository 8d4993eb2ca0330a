"""URL filter: host and path rules, and link-graph propagation where no rule fits.

Rules are few and come with the call; the longest rule whose host is the url's host or a parent domain of it and whose
path starts the url's path decides.  A url without a rule gets its host's verdict from the link graph:

* edges are absolute links between different hosts, weighted by their number;
* trust is personalised PageRank along the edges from hosts whose pages the rules mostly allow;
* distrust is personalised PageRank against the edges from hosts whose pages the rules mostly block (who links to
  blocked hosts is suspect);
* a host is blocked if distrust / (trust + distrust) exceeds ``threshold``; a host that neither reaches is allowed.

Ranks are DataFrames keyed by host; each round joins them with the edges and sums with map-side partial aggregation,
and is written to the shared folder.  Rounds end when the ranks move less than ``tolerance`` in sum.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is allowed; null html has no
links; repeated pages are judged each and count each; an empty table gives an empty result; extra columns pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

# The rules of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host tables up to this many rows (some 50 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_HOSTS = 250_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``(src, dst, n)``: absolute links between different hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    out = pages.select(F.col(host).alias("src"), F.explode(links).alias("url"))
    dst, _ = host_and_path(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url")))
    out = out.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """``(host, rank)`` by power iteration until the ranks move less than ``tolerance`` in sum (about 60 rounds on long
    paths at this damping; an error if ``rounds`` are not enough); ``seeds`` is ``(host, weight)`` and the restart distribution.

    Mass of hosts without outgoing edges returns to the seeds.  Hosts that get no mass have no row."""
    whole = seeds.agg(F.sum("weight").alias("w")).first()["w"]
    if not whole:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    start = materialise(seeds.select("host", (F.col("weight") / whole).alias("rank")), "seeds")
    outgoing = edges.groupBy("src").agg(F.sum("n").alias("total"))
    moves = materialise(edges.join(outgoing, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "moves")
    linked = materialise(moves.select(F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True)), "linked")
    rank = start.select("host", "rank", F.lit(0.0).alias("old"))
    for _ in range(rounds):
        state = rank.join(linked, "host", "left").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved"), F.sum(F.when(F.col("linked"), F.col("rank"))).alias("live")).first()
        if state["moved"] < tolerance:
            return rank.where("rank > 0").select("host", "rank")
        zero = F.lit(0.0)
        passed = moves.join(rank, moves.src == rank.host).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"), zero.alias("old"))
        back = start.select("host", (F.col("rank") * (1.0 - damping * (state["live"] or 0.0))).alias("rank"), zero.alias("old"))
        before = rank.select("host", zero.alias("rank"), F.col("rank").alias("old"))
        rank = passed.unionByName(back).unionByName(before).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))
        rank = materialise(rank, "rank")
    raise RuntimeError("ranks did not settle")


def filter_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``."""
    results = ("host", "path", "rule", "verdict", "trust", "distrust")
    keep = [c for c in pages.columns if c.lower() not in results]
    says, trust, distrust = fresh(pages.select(*keep), "_says", "_trust", "_distrust")
    host, path = host_and_path(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(*[F.col(c) for c in keep], F.col("host"), F.col("path"), rule.alias("rule"), verdict.alias(says), *([F.col(html_col)] if html_col not in keep else []))
    stats = rows.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(says) == "allow").alias("good"), F.count_if(F.col(says) == "block").alias("bad")
    )
    stats = materialise(stats, "hosts")
    edges = materialise(host_edges(rows, "host", html_col), "edges")
    good = stats.where(F.col("good") * 2 > F.col("n")).select("host", F.col("good").cast("double").alias("weight"))
    bad = stats.where(F.col("bad") * 2 > F.col("n")).select("host", F.col("bad").cast("double").alias("weight"))
    t = personalised_rank(edges, good).withColumnRenamed("rank", trust)
    d = personalised_rank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), bad).withColumnRenamed("rank", distrust)
    scores = materialise(t.join(d, "host", "full"), "scores")
    if scores.count() <= BROADCAST_HOSTS:
        scores = F.broadcast(scores)
    zero = F.lit(0.0)
    a, b = F.coalesce(F.col(trust), zero), F.coalesce(F.col(distrust), zero)
    by_graph = F.when(b > (a + b) * threshold, "block").otherwise("allow")
    out = rows.join(scores, "host", "left")
    return out.select(*[F.col(c) for c in keep], "host", "path", "rule", F.coalesce(F.col(says), by_graph).alias("verdict"), a.alias("trust"), b.alias("distrust"))
