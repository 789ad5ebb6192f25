"""A category tree from votes of pages and breadcrumbs, and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.relational import tree_faults, walk


def merchandising(url: Column, name: Column, paths: Sequence[str], names: Sequence[str]) -> Column:
    """Whether a category only sells: its path begins with one of paths, or it is called one of names."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    starts = F.lit(False)
    for prefix in paths:
        starts = starts | path.startswith(prefix)
    return starts | F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*names)


def breadcrumb_votes(breadcrumbs: DataFrame) -> DataFrame:
    """(url, name, parent, seen): every breadcrumb entry with the one before it; breadcrumbs: seen, crumbs array<struct<url,name>>."""
    rows = breadcrumbs.select("seen", "crumbs", F.posexplode("crumbs").alias("at", "crumb"))
    before = F.when(F.col("at") > 0, F.get("crumbs", F.col("at") - 1)["url"])
    return rows.select(F.col("crumb.url").alias("url"), F.col("crumb.name").alias("name"), before.alias("parent"), "seen")


def _favourite(votes: DataFrame, value: str) -> DataFrame:
    """Per url the value with the most votes, the first seen of equals."""
    counted = votes.groupBy("url", value).agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    return counted.groupBy("url").agg(F.max_by(value, F.struct("n", -F.col("first"), F.col(value))).alias(value))


def build_tree(votes: DataFrame, root: str, root_name: str) -> DataFrame:
    """(url, name, parent, depth) of the tree that most votes speak for; cycles raise.

    votes: url, name, parent, seen (a number by which the first of equal votes counts). Nodes that are
    only named as a parent are nodes too; a node without a parent of its own stands under the root; the
    root has none. A url without a name is called by its url.
    """
    named = votes.filter(F.coalesce("name", F.lit("")) != "")
    nodes = votes.select("url").union(votes.filter("parent is not null").select("parent")).distinct().filter(F.col("url") != root)
    parents = votes.filter("parent is not null and parent <> url")
    rows = nodes.join(_favourite(named, "name"), "url", "left").join(_favourite(parents, "parent"), "url", "left")
    rows = rows.select("url", F.coalesce("name", "url").alias("name"), F.coalesce("parent", F.lit(root)).alias("parent"))
    top = rows.sparkSession.createDataFrame([(root, root_name, None)], "url string, name string, parent string")
    rows = rows.unionByName(top)
    walked = walk(rows, "url", "parent").select(F.col("node").alias("url"), F.col("depth").cast("int").alias("depth"), "ended")
    if bad := walked.filter("not ended").limit(5).collect():  # every parent is a node
        raise ValueError("; ".join(f"CYCLE at {r.url}" for r in bad))
    return rows.join(walked.drop("ended"), "url")


def tree_checks(rows: DataFrame, product_urls: DataFrame, breadcrumb_urls: DataFrame, is_merchandising: Column) -> DataFrame:
    """One row of nine counters over a tree (url, name, parent, depth); all but the first two should be 0."""
    known = rows.select(F.col("url").alias("_url"), F.col("depth").alias("_depth"))
    both = rows.join(known, F.col("parent") == F.col("_url"), "left")
    filled = F.col("parent").isNotNull()
    wrong = F.col("depth") != F.when(~filled, 0).otherwise(F.coalesce("_depth", F.lit(-2)) + 1)
    one = both.agg(
        F.count("*").alias("category_nodes"), F.count_if(~filled).alias("root_nodes"), F.count_if(filled & F.col("_url").isNull()).alias("dangling_parents"),
        F.count_if(is_merchandising).alias("merchandising_nodes"), F.count_if(F.col("url") == F.col("parent")).alias("self_parents"), F.count_if(wrong).alias("depth_errors"),
    )
    faults = tree_faults(rows, "url", "parent").agg(F.count_if(F.col("fault") == "CYCLE").alias("cycles"))
    products = rows.join(product_urls.select("url").distinct(), "url", "left_semi").agg(F.count("*").alias("product_urls_in_tree"))
    missing = breadcrumb_urls.select("url").distinct().join(rows, "url", "left_anti").agg(F.count("*").alias("missing_breadcrumb_nodes"))
    return one.crossJoin(faults).crossJoin(products).crossJoin(missing)  # one row each
