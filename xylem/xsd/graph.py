"""Schema catalogs as DataFrames, and questions about their graphs as joins.

Graphs of schemas are small, but nothing here relies on it: each round joins the newest rows with the edges, and its result is
checkpointed in the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xylem.sources.shared import without_lineage


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of all pairs with a path of one edge or more."""
    edges = edges.select("src", "dst").distinct()
    found = new = without_lineage(edges)
    while not new.isEmpty():
        step = new.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        new = without_lineage(step.join(found, ["src", "dst"], "left_anti"))
        found = without_lineage(found.union(new))
    return found


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node of the roots and of all that paths from them lead to."""
    found = new = without_lineage(roots.select("node").distinct())
    while not new.isEmpty():
        step = new.join(edges, new.node == edges.src).select(F.col("dst").alias("node")).distinct()
        new = without_lineage(step.join(found, "node", "left_anti"))
        found = without_lineage(found.union(new))
    return found


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """node and component: the least node that it is on a cycle with, or itself."""
    paths = closure(edges)
    both = paths.join(paths.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    return nodes_of(edges).join(least, "node", "left").select("node", F.least("node", F.coalesce("least", "node")).alias("component"))


def levels(edges: DataFrame) -> DataFrame:
    """node and level: the longest path that leads on from it, cycles counting as one node."""
    of = cycles(edges)
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = without_lineage(edges.join(a, "src").join(b, "dst").filter("a <> b").select("a", "b").distinct())
    level = without_lineage(of.select("component").distinct().withColumn("level", F.lit(0)))
    while True:
        above = between.join(level, F.col("b") == F.col("component")).groupBy("a").agg((F.max("level") + 1).alias("next"))
        new = level.join(above, F.col("component") == F.col("a"), "left").select("component", F.greatest("level", F.coalesce("next", F.lit(0))).alias("level"), (F.coalesce("next", F.lit(0)) > F.col("level")).alias("moved"))
        new = without_lineage(new)
        level = new.select("component", "level")
        if new.filter("moved").isEmpty():
            return of.join(level, "component").select("node", "component", "level")


def chunks(edges: DataFrame, budget: int) -> DataFrame:
    """node and chunk: nodes after all that they need, cut every budget nodes; a cycle is not cut."""
    order = Window.orderBy("level", "component")
    size = levels(edges).groupBy("level", "component").agg(F.count("*").alias("n"), F.collect_list("node").alias("nodes"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return size.withColumn("chunk", F.floor(before / budget)).select(F.explode("nodes").alias("node"), "chunk")


def chunk_needs(edges: DataFrame, of: DataFrame) -> DataFrame:
    """chunk, needs: pairs of different chunks with an edge between them."""
    a, b = of.select(F.col("node").alias("src"), "chunk"), of.select(F.col("node").alias("dst"), F.col("chunk").alias("needs"))
    return edges.join(a, "src").join(b, "dst").filter("chunk <> needs").select("chunk", "needs").distinct()


def catalog(spark: SparkSession, schema) -> dict[str, DataFrame]:
    """types, fields and edges of a compiled schema."""
    types, fields = schema.rows()
    frames = {
        "types": spark.createDataFrame(types, "name string, kind string, base string, abstract boolean"),
        "fields": spark.createDataFrame(fields, "owner string, ordinal int, name string, kind string, type string, min int, max int"),
    }
    bases = frames["types"].filter("base is not null").select(F.col("name").alias("src"), F.col("base").alias("dst"), F.lit("base").alias("kind"))
    frames["edges"] = frames["fields"].select(F.col("owner").alias("src"), F.col("type").alias("dst"), F.lit("field").alias("kind")).union(bases).distinct()
    return frames
