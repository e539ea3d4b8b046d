"""URL filters: rules first, link-graph propagation for the rest.

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's; the longest fitting rule decides. Urls without a rule
are judged by their host: trust is personalised PageRank from hosts that rules
allow, along links; distrust runs from hosts that rules block, against the
links. A host without a link onward gives its rank back to the seeds. Both walks
share one join and one aggregation a step, over edges summed per pair of hosts,
and stop when the ranks of a step moved by ``tol`` at most, measured over all
hosts, or at once where there are no edges. A host is blocked if its distrust is
over ``ratio`` times its trust; if both are equal it is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path
and is allowed by default, as is a host nothing is known of; null html has no
links; links of a host to itself do not count; repeated rows are judged alike;
an empty table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import ascii_lower, keep, sized

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column | str) -> Column:
    url = url if isinstance(url, Column) else F.col(url)
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    url = url if isinstance(url, Column) else F.col(url)
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host, path) with rule and rule_verdict; null where none fits.

    Each host meets its rules by an equi-join on its suffixes, once per distinct
    host; a url then tries its host's rules, longest first.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").filter("host <> ''").distinct().select("host", F.explode(suffix).alias("rule_host"))
    text = F.concat("rule_host", "rule_path")
    fit = hosts.join(sized(rules), "rule_host").groupBy("host").agg(
        F.sort_array(F.collect_set(F.struct(F.length(text).alias("n"), text.alias("rule"), "rule_path", "rule_verdict")), asc=False).alias("fits")
    )
    out = urls.join(sized(fit, 100_000), "host", "left")
    best = F.element_at(F.filter("fits", lambda r: F.startswith(F.col("path"), r.rule_path)), 1)
    best = F.when(F.size(F.filter("fits", lambda r: F.startswith(F.col("path"), r.rule_path))) > 0, best)
    return out.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict")).drop("best", "fits")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed per pair."""
    to = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(host_of("url").alias("src"), to.alias("to"))
    dst = ascii_lower(F.regexp_extract("to", r"^[^/]*//([^/?#]*)", 1))
    links = links.select("src", dst.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.7, tol: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trusted, blocked: weights) over ``edges``."""
    away = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "n", F.lit(True).alias("ahead"))
    both = away.unionByName(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "n", F.lit(False).alias("ahead")))
    out = both.groupBy("host", "ahead").agg(F.sum("n").alias("out"))
    steps = keep(both.join(out, ["host", "ahead"]).select("host", "to", "ahead", (F.col("n") / F.col("out")).alias("share")), "steps")
    total = seeds.agg(F.sum("trusted"), F.sum("blocked")).first()
    part = lambda c, t: F.col(c) / t if t else F.lit(0.0)
    seeds = keep(seeds.select("host", part("trusted", total[0]).alias("s"), part("blocked", total[1]).alias("b")), "seeds")
    ranks = seeds.select("host", F.col("s").alias("trust"), F.col("b").alias("distrust"))
    moved = 0.0 if steps.isEmpty() else 1.0
    z = lambda c: F.coalesce(c, F.lit(0.0))
    while moved > tol:
        given = steps.join(ranks, "host").select(
            F.col("to").alias("host"), F.when(F.col("ahead"), F.col("trust") * F.col("share")).otherwise(0.0).alias("trust"),
            F.when(~F.col("ahead"), F.col("distrust") * F.col("share")).otherwise(0.0).alias("distrust"),
        )
        given = keep(given.groupBy("host").agg((F.sum("trust") * damping).alias("t"), (F.sum("distrust") * damping).alias("d")), "given")
        went = given.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("d"), F.lit(0.0))).first()
        # What was not handed on goes to the seeds; each walk's ranks sum to one.
        base = seeds.select("host", (F.col("s") * (1 - went[0])).alias("s"), (F.col("b") * (1 - went[1])).alias("b"))
        new = base.join(given, "host", "full").select("host", (z("s") + z("t")).alias("trust"), (z("b") + z("d")).alias("distrust"))
        old = ranks.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        new = keep(new.join(old, "host", "left").select("host", "trust", "distrust", (F.abs(F.col("trust") - z("t")) + F.abs(F.col("distrust") - z("d"))).alias("change")), "ranks")
        moved = new.agg(F.coalesce(F.sum("change"), F.lit(0.0))).first()[0]
        ranks = new.drop("change")
    return ranks


def judge(pages: DataFrame, rules: DataFrame | None = None, ratio: float = 1.0) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust."""
    rules = rule_table(pages.sparkSession) if rules is None else rules
    urls = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    urls = keep(with_rules(urls, rules), "urls")
    is_ = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    seeds = urls.filter("host <> ''").groupBy("host").agg(is_("allow").alias("trusted"), is_("block").alias("blocked"))
    ranks = propagate(seeds, keep(host_edges(pages), "edges"))
    rows = urls.join(sized(ranks), "host", "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > F.lit(ratio) * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
