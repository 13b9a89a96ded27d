"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.shared import HEAVY, checkpoint_folder, join_spread, spread


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of links (a, b).

    Every round, a node takes the least label among its neighbours, and then the
    label of that label, so a path of n links takes about log n rounds. Minima
    are partially aggregated, and the rows of a node with very many links, or of a
    label with very many nodes, are dealt to salts.
    An empty table of links gives an empty result.
    """
    checkpoint_folder(links.sparkSession)
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    n = edges.count()
    often = edges.groupBy("b").agg(F.count("*").alias("__n")).filter(F.col("__n") > max(1, n // HEAVY)).checkpoint()
    dealt, copies = spread(edges, "b", n, F.xxhash64("a"), often)
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node").checkpoint()
    while True:
        near = dealt.join(copies(labels.withColumnRenamed("node", "b")), ["b", "__salt"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        up = low.select(F.col("node").alias("__up"), F.col("low").alias("top")).withColumnRenamed("__up", "low")
        jumped = join_spread(low, up, "low", n, F.xxhash64("node"), "inner").select("node", F.least("low", "top").alias("new"), "label")
        done = jumped.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")).checkpoint()
        labels = done.select("node", "label")
        if not done.filter("moved").limit(1).collect():
            return labels.withColumnRenamed("label", "component")
