"""URL filter: rules first, then a tree of path templates per host.

Per host the paths form a tree. Segments that look variable (numbers, long or hexadecimal tokens)
become wildcards at once, keeping a file ending. Level by level a remaining segment becomes a
wildcard too if it is rare below its parent, or if the share of good pages below it is statistically
the same as that of all its siblings: such branches are merged. What is left are the templates.
A template is rejected by its purity, the share of good pages among its labelled pages, smoothed
towards the share in all labelled pages.

The tree is built over shapes (host and path after the first step) with page counts, not over
pages; counting combines before the shuffle, so a host with a third of all pages is one of many
rows. Pages find their template again by shape, where frequent shapes are looked up by broadcast of
at most 4,096 rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm.tables import lower_ascii
from rowkin.operators.lookup import hot_keys, lookup
from rowkin.session import stage

RARE_PAGES = 3  # fewer pages cannot have labels enough to differ from their siblings
SAME_WITHIN = 1.96  # standard errors
PRIOR_PAGES = 20.0
LEAST_PURITY = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # with its leading slash

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host in lower case (A-Z), path as written; both empty without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 0)
    has = after != ""
    take = lambda group: F.when(has, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group)).otherwise("")
    return lower_ascii(take(1)), take(2)


def rule_for(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``field`` of the longest rule (host and path together) that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, field))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """The path with variable-looking segments as ``*``, a file ending kept."""
    variable = r"(?<=/)(?:[0-9]+|[0-9a-fA-F]{8,}|[^/.]*[0-9]{3,}[^/.]*|[^/.]{25,})(?=\.[A-Za-z0-9]{1,5}(?:/|$)|/|$)"
    return F.regexp_replace(path, variable, "*")


def templates(shapes: DataFrame, good_share: float) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, pages, labelled, good).

    ``good_share`` is the share of good pages among all labelled ones.

    A round moves every node (host, template so far) to where it splits or where one of its shapes
    ends: while all shapes of a node go on alike, each further segment is judged on the same counts.
    A node of fewer pages than ``RARE_PAGES`` has wildcards only from there on and ends at once. So the
    rounds follow the splits along a path and not the segments of the longest path.
    """
    counts = ("pages", "labelled", "good")
    rows = shapes.withColumn("rest", F.split(F.regexp_replace("shape", "^/", ""), "/")).withColumn("template", F.lit(""))
    ended: list[DataFrame] = []
    while True:
        rows = rows.withColumn("segment", F.get("rest", F.lit(0)))
        branch = rows.groupBy("host", "template", "segment").agg(
            *[F.sum(c).alias(c) for c in counts], F.min("rest").alias("low"), F.max("rest").alias("high"))
        parent = branch.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in counts], F.count("*").alias("branches"))
        judged = branch.join(parent, ["host", "template"])
        pooled = (F.col("all_good") + good_share) / (F.col("all_labelled") + 1)
        own = (F.col("good") + pooled) / (F.col("labelled") + 1)
        error = F.sqrt(pooled * (1 - pooled) / F.greatest("labelled", F.lit(1)))
        rare = F.col("pages") < RARE_PAGES
        same = F.abs(own - pooled) <= SAME_WITHIN * error
        differing = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        alike = F.when(differing > 0, differing - 1).otherwise(F.size("low"))  # segments that all shapes between low and high share
        steps = F.when(F.col("all_pages") < RARE_PAGES, F.lit(None)).when(F.col("branches") == 1, alike).otherwise(1)
        chosen = judged.select("host", "template", "segment", (rare | same).alias("wild"), steps.cast("int").alias("steps"))
        rows = rows.join(chosen, ["host", "template", "segment"])
        steps = F.coalesce("steps", F.size("rest"))
        passed = F.transform(F.slice("rest", F.lit(1), steps), lambda s: F.when(F.col("wild"), "*").otherwise(s))
        rows = rows.withColumns({"template": F.concat("template", F.lit("/"), F.array_join(passed, "/")),
                                 "rest": F.slice("rest", steps + 1, F.size("rest"))})
        rows = stage(rows.drop("segment", "wild", "steps"), "templates")
        ended.append(rows.where(F.size("rest") == 0))
        rows = rows.where(F.size("rest") > 0)
        if rows.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, ended)
    totals = rows.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
    purity = (F.col("all_good") + PRIOR_PAGES * good_share) / (F.col("all_labelled") + PRIOR_PAGES)
    return rows.join(totals.withColumn("purity", purity), ["host", "template"]).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per row of ``pages`` (page_id, url).

    ``labels`` is (page_id, good boolean); several labels of a page count as bad if one is, rows with
    nulls are left out, without any label every template is allowed. Null urls and urls without
    ``://`` have an empty host and path and share the template of the empty path.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_for(F.col("host"), F.col("path"), rules, "name"),
                             "ruled": rule_for(F.col("host"), F.col("path"), rules, "verdict"), "shape": shape(F.col("path"))})
    rows = rows.withColumn("key", F.sha2(F.concat_ws("\n", "host", "shape"), 256))
    known = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    marked = rows.select("page_id", "host", "shape", "key").join(known, "page_id", "left")
    shapes = stage(marked.groupBy("key", "host", "shape").agg(
        F.count("*").alias("pages"), F.count("good").alias("labelled"), F.count_if("good").alias("good")), "shapes")
    total = shapes.agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).first()
    good_share = (total["good"] or 0) / total["labelled"] if total["labelled"] else 1.0
    tree = templates(shapes.drop("key"), good_share).withColumn("key", F.sha2(F.concat_ws("\n", "host", "shape"), 256))
    found = lookup(rows, tree.select("key", "template", "purity"), "key", hot_keys(shapes, "key", "pages"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
