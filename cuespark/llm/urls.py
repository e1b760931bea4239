"""URL filters: allow and block rules, and a path-template tree for what they leave open.

Each host has a tree of path segments. Segments that vary (numbers and other codes by their
shape, others where a node has many children of which none is common) become wildcards; a leaf is a
template. Labelled URLs give each template a share of good ones; sibling templates whose shares do not
differ by a two-proportion test are merged and judged together; a template whose smoothed share
is too low is rejected. Shares are smoothed towards that of the templates of the same parent, this one
towards the host's, and the host's towards that of all hosts, in which templates and hosts count
once whatever their size. A template without a label is never rejected.

A host may hold most of the table: counting goes by path first and is combined before every shuffle,
and joins are on host and path together. SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import free_name

DEPTH = 8               # deeper segments belong to the template as one open tail
MANY = 8                # children of a node with variable segments
COMMON = 0.05           # share of its node from which a child is no variable
Z = 1.96                # siblings that differ by less are alike
PRIOR = 2.0             # labelled URLs (templates, hosts) that the share one level above counts as
REJECT = 0.5
FEW_WORDS, ENOUGH_WORDS = 10, 50        # words of a page's text: fewer are a bad page, so many may be a good one
SYMBOLS, FEW_SYMBOLS = 0.03, 0.01       # share of symbols in it from which a page is bad, below which it may be good

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str        # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def ruled(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """The pages' columns and host, path, rule (name of the longest rule that fits), ruled (its verdict)."""
    host, path = host_and_path(F.col(url))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):        # longer rules are tried before
        fits = r.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": name, "ruled": verdict})


def page_evidence(html: Column) -> Column:
    """True for a page that reads as prose, false for one with hardly any text or full of symbols, else null."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?(?:</\1|\z)|<!--.*?(?:-->|\z)|<[^<>]*>", " ")
    text = F.trim(F.regexp_replace(F.replace(bare, F.lit("&amp;"), F.lit("&")), r"\s+", " "))

    def told(t: Column) -> Column:
        n = F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))
        share = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")) / F.greatest(F.length(t), F.lit(1))
        seen = F.struct(n.alias("n"), share.alias("share"))
        return F.get(F.transform(F.array(seen), lambda x: F.when((x["n"] < FEW_WORDS) | (x["share"] >= SYMBOLS), False)
                                 .when((x["n"] >= ENOUGH_WORDS) & (x["share"] < FEW_SYMBOLS), True)), F.lit(0))

    return F.get(F.transform(F.array(text), told), F.lit(0))        # the text is made once


def shaped(segment: Column) -> Column:
    """Codes by their shape: runs of digits, and long words of digits and letters; null for other segments."""
    code = r"^[0-9A-Fa-f-]{16,}$"
    return (F.when(segment.rlike(code), F.lit("{code}"))
            .when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "{n}")))


def templates(paths: DataFrame) -> DataFrame:
    """host, path, n, good, bad and template, parent: the tree walked level by level."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    p = paths.withColumn("segments", segments).withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    p = settle(p, "url-paths")
    deepest = min(DEPTH, p.agg(F.max(F.size("segments"))).first()[0] or 0)
    for d in range(deepest):        # a level is read three times by the next: it is written
        segment = F.get("segments", F.lit(d))
        p = p.withColumn("segment", segment)
        child = (p.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("child_n")))
        node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("child_n").alias("node_n"))
        variable = (child.join(node, ["host", "template"])
                    .where((F.col("children") >= MANY) & (F.col("child_n") < COMMON * F.col("node_n")))
                    .select("host", "template", "segment", F.lit(True).alias("varies")))
        p = p.join(variable, ["host", "template", "segment"], "left")
        mark = F.coalesce(shaped(F.col("segment")), F.when(F.col("varies"), F.lit("{*}")), F.col("segment"))
        p = p.withColumn("next", F.when(F.col("segment").isNotNull(), F.concat("template", F.lit("/"), mark)))
        p = (p.withColumn("parent", F.when(F.col("next").isNotNull(), F.col("template")).otherwise(F.col("parent")))
             .withColumn("template", F.coalesce("next", "template")).drop("next", "varies", "segment"))
        p = settle(p, "url-paths")
    tail = F.when(F.size("segments") > DEPTH, F.lit("/**")).otherwise(F.when(F.col("path").endswith("/"), F.lit("/")).otherwise(F.lit("")))
    return p.withColumn("template", F.concat("template", tail)).drop("segments")


def judged(paths: DataFrame) -> DataFrame:
    """host, path, template, purity (smoothed share of good among the labelled URLs of the merged template), verdict."""
    t = templates(paths)
    leaf = settle(t.groupBy("host", "parent", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-leaves")
    pool = leaf.groupBy("host", "parent").agg(F.sum("good").alias("pool_good"), F.sum("bad").alias("pool_bad"))
    labelled = leaf.where("good + bad > 0").select("host", "parent", (F.col("good") / (F.col("good") + F.col("bad"))).alias("share"))
    parents = labelled.groupBy("host", "parent").agg(F.sum("share").alias("p_sum"), F.count("*").alias("p_n"))
    hosts = parents.groupBy("host").agg(F.sum("p_sum").alias("h_sum"), F.sum("p_n").alias("h_n"))
    prior = hosts.agg(((F.coalesce(F.sum(F.col("h_sum") / F.col("h_n")), F.lit(0.0)) + 1) / (F.count("*") + 2)).alias("prior")).first()["prior"]
    zero = F.lit(0)
    of_host = (F.coalesce("h_sum", zero) + PRIOR * prior) / (F.coalesce("h_n", zero) + PRIOR)
    of_parent = (F.coalesce("p_sum", zero) + PRIOR * F.col("of_host")) / (F.coalesce("p_n", zero) + PRIOR)
    n, rest = F.col("good") + F.col("bad"), F.col("pool_good") + F.col("pool_bad") - F.col("good") - F.col("bad")
    share = (F.col("pool_good") + 0.5) / (F.col("pool_good") + F.col("pool_bad") + 1)
    differs = (F.col("good") / n - (F.col("pool_good") - F.col("good")) / rest) / F.sqrt(share * (1 - share) * (1 / n + 1 / rest))
    alike = (n > 0) & ((rest == 0) | (F.abs(differs) < Z))
    j = leaf.join(pool, ["host", "parent"]).withColumn("branch", F.when(alike, F.lit("")).otherwise(F.col("template")))
    merged = j.groupBy("host", "parent", "branch").agg(F.sum("good").alias("m_good"), F.sum("bad").alias("m_bad"))
    above = (leaf.select("host", "parent").distinct().join(parents, ["host", "parent"], "left").join(hosts, "host", "left")
             .withColumn("of_host", of_host).select("host", "parent", of_parent.alias("above")))
    m = F.col("m_good") + F.col("m_bad")
    purity = (F.col("m_good") + PRIOR * F.col("above")) / (m + PRIOR)
    verdicts = (j.select("host", "parent", "template", "branch").join(merged, ["host", "parent", "branch"]).join(above, ["host", "parent"])
                .select("host", "parent", "template", purity.alias("purity"), (m > 0).alias("known")))
    block = F.col("known") & (F.col("purity") < REJECT)
    return (t.join(verdicts, ["host", "parent", "template"])
            .select("host", "path", "template", "purity", F.when(block, "block").otherwise("allow").alias("judged")))


def filter_urls(pages: DataFrame, rules: list[Rule], label: Column | None = None, url: str = "url") -> DataFrame:
    """The pages' columns and host, path, rule, template, purity, verdict.

    `label` is an expression over host, path, ruled and the pages' columns with true for good, false for bad and null for
    unlabelled URLs; by default the rules' verdicts are the labels. A null URL, or one without `://`,
    has empty host and path, which make a host like any other. Repeated URLs count each. A result
    replaces an input column of its name. Without any label everything the rules leave open is allowed.
    """
    if label is None:
        label = F.when(F.col("ruled") == "allow", True).when(F.col("ruled") == "block", False)
    own, end = free_name(pages, "own_ruled"), free_name(pages, "judged")       # `ruled` in a label is the rules' verdict
    p = ruled(pages.withColumnsRenamed({"ruled": own}), rules, url)
    paths = p.withColumn("good_url", label).groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("good_url"), 1)).alias("good"), F.count(F.when(~F.col("good_url"), 1)).alias("bad"))
    made = judged(paths).withColumnRenamed("judged", end)
    return (p.drop("template", "purity", "verdict").join(made, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("ruled", end)).drop("ruled", end).withColumnsRenamed({own: "ruled"}))
