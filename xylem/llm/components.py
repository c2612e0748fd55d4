"""Connected components of a graph of links, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Staging


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """node and component (the least node) of every node that has a link. links: a, b (long).

    Each round, a node takes the least label among its own, its neighbours' and that of the node it is labelled with; the jump along
    labels makes the number of rounds grow with the logarithm of a chain's length. Each round's labels are a table of their own.
    """
    clean = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = staging.save(clean.union(clean.select("b", "a")).distinct(), f"{name}-edges")
    labels = staging.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        to = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = labels.join(to, "component").select("node", F.col("component").alias("was"), F.col("next").alias("component"))
        seen = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("least"))
        new = staging.save(jumped.join(seen, "node").select("node", F.least("component", "least").alias("component"), "was"), f"{name}-{turn}")
        staging.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            staging.drop(f"{name}-edges")
            return labels


def merged(groups: DataFrame, links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """groups (node, component) after further links (a, b).

    A link counts as one between the groups of its ends, once for each two groups, so what is linked already is not gone through
    again, and many links between two groups are one.
    """
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), staging, f"{name}-moved")
    nodes = groups.unionAll(moved.select("node", F.col("node").alias("component"))).distinct()
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return staging.save(nodes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), name)
