"""Connected components of a link table by alternating large-star and small-star
steps: every step is one exchange of link rows and a minimum per node. Links that
come later extend known components by steps over those alone that they join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import written


def _hung(links: DataFrame, both_ways: bool) -> DataFrame:
    """(u, v, m, lead): the distinct links of each node u, seen from both ends or one; m is the
    least of u and its neighbours, and each node has one row that leads."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = links.select(F.inline(ends)) if both_ways else links
    by_node = Window.partitionBy("u").orderBy("v")
    rows = seen.select("u", "v", F.least(F.first("v").over(by_node), "u").alias("m"),
                       F.lag("v").over(by_node).alias("before"))
    return rows.filter("before IS NULL OR before < v").select("u", "v", "m", F.isnull("before").alias("lead"))


def _star(hung: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours of each node on the least of them: the larger ones (large star,
    links seen from both ends) or all smaller ones and the node itself (small star)."""
    if both_ways:
        return hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link to another one; the component
    is its least node. Nulls, self links and repeated links are ignored."""
    hung = written(_hung(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))), True), "links")
    # until every node hangs on one other at most, and none on a node that hangs
    while hung.filter("(v < u AND v <> m) OR (v > u AND m < u)").limit(1).count():
        smaller = _star(_hung(_star(hung, True), False), False)
        hung = written(_hung(smaller, True), "stars")
    return hung.filter("lead").select(F.col("u").alias("node"), F.col("m").alias("component"))


def named(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) whose ends are not in one component of ``found``, with these components
    (ca, cb); a node that ``found`` lacks is its own."""
    return (links.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
            .filter("ca <> cb"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that ``found`` comes from and more ``links`` (a, b): only
    those between two components are followed."""
    merged = components(named(links, found).select("ca", "cb"), "ca", "cb")
    into = merged.select(F.col("node").alias("c"), F.col("component").alias("into"))
    # a component's name is one of its nodes: what only ``into`` has are new nodes
    return found.join(into, found.component == into.c, "full_outer").select(
        F.coalesce("node", "c").alias("node"), F.coalesce("into", "component").alias("component"))
