"""URL filters: host and path rules, then templates of a path tree.

Per host, paths form a tree of segments.  Segments that vary (numbers, hashes,
or more siblings than ``branches``) become wildcards.  From the root on, the
children of a node whose labels (of all pages below them) do not differ
significantly from those of the others of their group, taken together, are merged, and the next level goes on with the merged nodes; the
names of a merged node are joined with ``//``, which no path has.  A template is
rejected when its smoothed share of good labels is low.

Paths are first reduced to shapes and counted, so that a host with a third of
all pages is a handful of rows from then on.

Defined results: a url that is null or has no ``://`` has an empty host and
path; a page whose branch has no labels follows the overall share; repeated
rows each get their result; columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Templates:
    """``branches``: siblings beyond which a level is a wildcard; ``z``: standard errors at which branches
    differ; ``strength``: labels that the overall share counts as."""

    branches: int = 20
    z: float = 1.96
    strength: float = 10.0
    reject: float = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path prefix)`` that fits, as ``struct(rule, verdict)``; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of a path with variable ones as ``*``: those with a digit run, long hexadecimal ones, by their ending."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^(?:[^.]*\d[^.]*|[0-9a-fA-F-]{16,})(\.[A-Za-z]{1,5})?$", "*"))


def _merged(named: DataFrame, prior: float, cfg: Templates) -> DataFrame:
    """``(host, node, last, child)`` of one level to the ``name`` of the group that a child is merged into.

    In the order of their shares, a child joins the group before it unless it differs significantly from that group's pooled share; so
    small steps do not chain.  Children that end a path and children that lead on are compared among their own kind.
    """
    kids = named.groupBy("host", "node", "last", "child").agg(F.sum("good").alias("good"), F.sum("seen").cast("double").alias("seen"))
    share = lambda good, seen: (good + cfg.strength * prior) / (seen + cfg.strength)
    kids = kids.withColumn("share", share(F.col("good"), F.col("seen")))
    # at most `branches` siblings of a kind
    row = F.struct("share", "child", "good", "seen")
    sorted_ = kids.groupBy("host", "node", "last").agg(F.array_sort(F.collect_list(row)).alias("kids"))
    group = lambda names, good, seen: F.struct(names.alias("names"), good.alias("good"), seen.alias("seen"))

    def join(groups: Column, kid: Column) -> Column:
        now = F.element_at(groups, -1)
        pooled, own = share(now["good"], now["seen"]), kid["share"]
        error = F.sqrt(pooled * (1 - pooled) / (now["seen"] + cfg.strength) + own * (1 - own) / (kid["seen"] + cfg.strength))
        alone = group(F.array(kid["child"]), kid["good"], kid["seen"])
        grown = group(F.concat(now["names"], F.array(kid["child"])), now["good"] + kid["good"], now["seen"] + kid["seen"])
        apart = (F.size(groups) == 0) | (own - pooled > cfg.z * error)
        return F.when(apart, F.concat(groups, F.array(alone))).otherwise(F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(grown)))

    # an empty group to begin with, so that there is a last one; it is taken out again
    none = F.expr("array(named_struct('names', cast(array() as array<string>), 'good', 0.0D, 'seen', 0.0D))")
    first = lambda groups, kid: F.when(F.size(F.element_at(groups, -1)["names"]) == 0, F.array(group(F.array(kid["child"]), kid["good"], kid["seen"]))).otherwise(join(groups, kid))
    groups = sorted_.select("host", "node", "last", F.explode(F.aggregate("kids", none, first)).alias("g"))
    names = F.sort_array("g.names")
    return groups.select("host", "node", "last", F.explode("g.names").alias("child"), F.concat(F.lit("/"), F.array_join(names, "//")).alias("name"))


def templates(pages: DataFrame, cfg: Templates = Templates()) -> DataFrame:
    """``pages(host, shape, good)`` (``good`` 1, 0 or null) to ``(host, shape, template, purity, reject)`` per shape.

    What all paths of a node share is taken in one step, so rounds are as many as there are places where paths part, one below the other.
    """
    good, seen = F.sum(F.col("good").cast("double")), F.count("good")
    leaf = written(pages.groupBy("host", "shape").agg(F.coalesce(good, F.lit(0.0)).alias("good"), seen.alias("seen")), "shapes")
    prior = leaf.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("seen"), F.lit(0)) + 2)).first()[0]  # one number
    key = ["host", "node", "last", "child"]
    done = leaf.filter(F.size("shape") == 0).select("host", "shape", "good", "seen", F.lit("").alias("template"))
    tree, k = leaf.filter(F.size("shape") > 0).withColumn("node", F.lit("")).withColumn("rest", F.col("shape")), 0
    after = lambda n: F.slice("rest", n + 1, F.size("rest"))
    while not tree.isEmpty():
        # the least and the greatest of the paths that are left agree as far as all of them do; the last segment of the shortest stays
        nodes = tree.groupBy("host", "node").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.min(F.size("rest")).alias("short"), (F.count(F.lit(1)) == 1).alias("alone"))
        first = F.array_position(F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
        same = F.least(F.when(first == 0, F.size("low")).otherwise(first - 1), F.col("short") - 1)
        step = tree.join(nodes.select("host", "node", "alone", same.alias("same")), ["host", "node"])
        step = step.withColumn("node", F.concat("node", F.when(F.col("same") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("same")), "/"))).otherwise(F.lit("")))).withColumn("rest", after(F.col("same")))
        step = written(step.withColumn("child", F.get("rest", F.lit(0))).withColumn("last", F.size("rest") == 1), "level")
        # what is left of a path that shares its node with no other has no siblings
        ended = step.filter("alone").select("host", "shape", "good", "seen", F.concat_ws("/", "node", F.array_join("rest", "/")).alias("template"))
        several = step.filter("not alone")
        wide = several.groupBy("host", "node").agg((F.count_distinct("child") > cfg.branches).alias("wide"))
        several = several.join(wide, ["host", "node"]).withColumn("child", F.when(F.col("wide"), F.lit("*")).otherwise(F.col("child")))
        level = several.join(_merged(several, prior, cfg), key).withColumn("node", F.concat("node", "name"))
        level = written(level.select("host", "shape", "good", "seen", "node", "last", after(F.lit(1)).alias("rest")), "level")
        done = done.unionByName(ended).unionByName(level.filter("last").select("host", "shape", "good", "seen", F.col("node").alias("template")))
        tree, k = level.filter("not last").drop("last"), k + 1
        if k % 8 == 0:
            done = written(done, "done")

    purity = (F.sum("good") + cfg.strength * prior) / (F.sum("seen") + cfg.strength)
    judged = done.groupBy("host", "template").agg(purity.alias("purity"))
    out = done.select("host", "shape", "template").join(judged, ["host", "template"])
    return out.select("host", "shape", "template", "purity", (F.col("purity") < cfg.reject).alias("reject"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], cfg: Templates = Templates()) -> DataFrame:
    """``pages(page_id, url, good)`` to ``(page_id, host, path, rule, verdict, template, purity)``."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good")
    base = base.withColumn("shape", shape(F.col("path"))).withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    tree = written(templates(base, cfg), "templates")
    out = base.join(tree, ["host", "shape"], "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
