"""URL filters: rules by host and path, and trust and distrust carried along host links."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z as lower case, and the path before ``?`` and ``#``; both empty for null or other urls."""
    host = F.translate(F.regexp_extract(url, _URL, 1), ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Rules are (verdict, ``host/path``)."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def host_links(pages: DataFrame, url_col: str, html_col: str, affiliation: float = 1.0) -> DataFrame:
    """(src, dst, w): links between different hosts, counted per pair, and ties between a host and the domains above it.

    Links without a host stay on their page's host and carry nothing between hosts, so they are left out in the scan. A domain of two
    labels or more is a node of its own where it is a host of pages or two hosts lie below it; hosts and the domains above them are tied both ways with
    weight ``affiliation``, so that what is known of some hosts of a domain reaches the others.
    """
    host, _ = host_and_path(F.col(url_col))
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)).alias("link"))
    target, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    links = found.select("src", target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select(host.alias("h")).where("h <> ''").distinct()
    labels = F.split("h", r"\.")
    above = hosts.select("h", F.explode(F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), "."))).alias("up"))
    above = above.where("h <> up AND instr(up, '.') > 0")
    # hosts are counted before the shuffle, so a domain of a third of all hosts is a row per task
    shared = above.groupBy("up").agg(F.count("*").alias("n")).where("n > 1").select("up")
    ties = above.join(shared.union(hosts.select(F.col("h").alias("up"))).distinct(), "up", "left_semi")
    both = ties.select(F.explode(F.array(F.struct(F.col("h").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("h").alias("dst")))).alias("e"))
    both = both.select("e.src", "e.dst", F.lit(float(affiliation)).alias("w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(
    links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds_per_write: int = 4, max_rounds: int = 60,
) -> DataFrame:
    """(kind, host, rank): personalised PageRank of trust along links, and of distrust against them.

    ``seeds`` are (kind, host, s) with kind trust or distrust and shares that add up to one per kind. Weights of a host's links are
    shares of its total. Mass that reaches a host without further links goes back to the seeds: that only rescales the
    result, so it is left to leak and the ranks are normalised at the end. Rounds end when a kind's ranks move by less than
    ``tolerance`` in sum; a round is one join and one aggregation that combines before its shuffle, and every few rounds the
    ranks are written to the shared folder.
    """
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "w")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    edges = forward.unionByName(backward)
    totals = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    edges = stage(edges.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total")).alias("p")), "host-edges")
    start = seeds.select("kind", "host", (F.col("s") * (1 - damping)).alias("rank"))
    ranks, done, settled = stage(start, "ranks"), 0, edges.isEmpty()
    while not settled:
        if done >= max_rounds:
            raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
        before = ranks
        for _ in range(rounds_per_write):
            moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank"))
            ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks = stage(ranks, "ranks")
        done += rounds_per_write
        change = ranks.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("d"))
        settled = (change.agg(F.sum(F.abs("d"))).first()[0] or 0.0) < tolerance
    sums = ranks.groupBy("kind").agg(F.sum("rank").alias("total"))
    return ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))  # two kinds


def url_verdicts(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = 0.85, ratio: float = 1.0, affiliation: float = 1.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per row of ``pages``.

    The longest fitting rule decides a page; a rule fits its host and all hosts below it where the path starts with the rule's. Pages
    that rules allow make their hosts trusted seeds, those that rules block make them distrusted ones, each with the number of such pages.
    Trust flows along the links between hosts, distrust against them. A host is blocked where its distrust is over ``ratio`` times
    its trust, and its pages without a rule get that verdict; hosts that neither reaches, and pages without a host, are allowed.

    Null urls and urls without ``://`` have empty host and path and no rule. A null html has no links. Repeated rows each give a row
    and count as pages. An empty table gives no rows. Host ranks stay in Spark, however many hosts there are.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = stage(parsed.withColumns({"rule": rule, "ruled": verdict}), "urls")
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    counts = parsed.where("ruled IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("s"))  # two kinds
    ranks = propagate(stage(host_links(pages, url_col, html_col, affiliation), "host-links"), stage(seeds, "seeds"), damping)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    judged = stage(ranks.groupBy("host").agg(of("trust"), of("distrust")), "host-ranks")
    out = parsed.join(judged, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
