"""URL filters: host rules, and propagation of trust and distrust over the host graph.

DataFrame functions only. Trust is a personalised PageRank that starts from trusted hosts and
follows links; distrust starts from blocked hosts and follows links backwards, so a host that
links to blocked hosts is distrusted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltrace.session import checkpoint, stored

TIE = 1e-9
SALTS = 16  # tasks that share the pages of one host
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else nulls.

    A rule fits its host and all subdomains where the path begins with its own. Rules are a
    list in the program, so they become one expression; of equally long ones the longer host
    wins, then a block.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", suffixes: Sequence[str] = ()) -> DataFrame:
    """``src, dst, n``: links between different hosts.

    Links are ``href`` values with a host. A host also gets an edge to each domain above it
    that has a dot, and back, so that ``www`` and other subdomains share the standing of
    their site where pages link nowhere. Such a domain is a node whether a page or link has
    it or not. ``suffixes`` are domains under which unrelated sites register (``co.uk``) and
    are no nodes. Addresses made of digits, and names of over 253 characters, have no domain
    above them. Counted links are stored, so ``html`` is read once.
    """
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'<>\s]+)"), 1)
    out = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    counted = stored(out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").count(), "links")
    hosts = pages.select(host_of(F.col(url_col)).alias("h")).union(counted.select("dst")).where("h <> ''").distinct()
    labels = F.split("h", r"\.")
    join = lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    named = ~F.col("h").rlike(r"^[0-9.]+(:[0-9]*)?$|^\[") & (F.length("h") <= 253) & (F.size(labels) > 2)
    above = F.filter(F.transform(F.sequence(F.lit(2), F.size(labels) - 1), join), lambda d: d.rlike(r"[^.]\.[^.]") & ~d.isin(*suffixes))
    up = hosts.where(named).select(F.col("h").alias("a"), F.explode(F.array_distinct(above)).alias("b"))
    family = up.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*", F.lit(1).cast("bigint").alias("count"))
    return counted.union(family).groupBy("src", "dst").agg(F.sum("count").alias("n"))


def rule_seeds(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: Sequence[str] = (), url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """``trusted, blocked``, each with a column ``host``: where the rules allow, or block, a page.

    ``blocked`` also has the hosts in ``listed`` and their subdomains. A host can be in both,
    if rules on paths allow some of its pages and block others.
    """
    host = host_of(F.col(url_col))
    seen = pages.select(host.alias("host"), best_rule(host, path_of(F.col(url_col)), rules)[1].alias("verdict")).where("host <> ''")
    bad = F.col("verdict") == "block"
    for h in listed:
        bad = bad | (F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))
    return seen.where("verdict = 'allow'").select("host").distinct(), seen.where(bad).select("host").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 6, damping: float = 0.5) -> DataFrame:
    """``host, rank``: a personalised PageRank over ``src, dst, n`` from the hosts of ``seeds``.

    Nodes may be of any type that can be joined on. Each seed restarts with equal weight, so ranks are scaled to a seed's restart weight of 1.
    Sums are combined before each shuffle; the result is checkpointed every third round.
    """
    start = seeds.select("host").distinct().withColumn("rank", F.lit(1.0))
    share = checkpoint(edges.join(edges.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")))
    rank = start
    for k in range(rounds):
        moved = rank.join(share, rank.host == share.src).select(F.col("dst").alias("host"), (F.col("rank") * F.col("w") * damping).alias("rank"))
        rank = moved.union(start.select("host", (F.col("rank") * (1 - damping)).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % 3 == 2:
            rank = checkpoint(rank)
    return rank


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], trusted: DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.01, suffixes: Sequence[str] = ()) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` for each page.

    The longest rule that fits decides; else a host is blocked if its distrust is over
    ``threshold`` and over its trust, and allowed otherwise. ``trusted`` and ``blocked`` hold
    the seeds' hosts in a column ``host``. A null url, or one without ``://``, has an empty
    host and path, no rule and no seed, and is allowed. Null pages link nowhere; repeated
    rows are judged one by one; an empty table gives no rows, texts of any length are read
    whole, and other columns are not used. ``suffixes`` are those of ``host_edges``. Distrust
    within ``TIE`` of trust is no more than it, so the order of sums decides nothing.

    On a site of n hosts without other links, one blocked host gives each of the others a distrust of
    0.172 / n. The default ``threshold`` therefore blocks them where more than one host in 18 is blocked. Both
    ranks are found in one propagation, over nodes named by way and host.
    """
    edges = stored(host_edges(pages, url_col, html_col, suffixes), "edges")
    node = lambda way, host: F.struct(F.lit(way).alias("way"), F.col(host).alias("host"))
    arrow = lambda way, a, b: F.struct(node(way, a).alias("src"), node(way, b).alias("dst"), "n")
    both = edges.select(F.explode(F.array(arrow("trust", "src", "dst"), arrow("distrust", "dst", "src"))).alias("e")).select("e.*")
    seeds = trusted.select(node("trust", "host").alias("host")).union(blocked.select(node("distrust", "host").alias("host")))
    of = lambda way: F.max(F.when(F.col("host.way") == way, F.col("rank"))).alias(way)
    ranks = propagate(both, seeds).groupBy("host.host").agg(of("trust"), of("distrust"))
    read = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((d > threshold) & (d - t > TIE), F.lit("block")).otherwise(F.lit("allow"))
    salted = read.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)))
    known = ranks.select("host", "trust", "distrust", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return salted.join(known, ["host", "salt"], "left").select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), t.alias("trust"), d.alias("distrust"))
