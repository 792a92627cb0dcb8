"""Topic clusters: the local-moving phase of Louvain on the undirected weighted projection.

Nodes move one after another, but a move looks only at neighbours' communities and at the weight of the whole graph. So
components of the graph do not affect one another, and each is a task of its own that gives what one loop over the
whole graph gives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .components import components
from .graph import Graph, weighted_adjacency

PASSES = 20


def move_nodes(order: list, adjacency: dict, m2: int, passes: int = PASSES) -> dict:
    """node -> community. adjacency: node -> {neighbour: weight} in the order in which neighbours came."""
    degree = {u: sum(adjacency[u].values()) for u in order}
    home, total = {u: u for u in order}, dict(degree)
    for _ in range(passes):
        moved = False
        for u in order:
            here = home[u]
            total[here] -= degree[u]
            near: dict = {}
            for v, w in adjacency[u].items():
                near[home[v]] = near.get(home[v], 0) + w
            best, most = here, 0.0
            for c, w in near.items():
                gain = w - total[c] * degree[u] / m2
                if gain > most:
                    best, most = c, gain
            home[u] = best
            total[best] += degree[u]
            moved |= best != here
        if not moved:
            break
    return home


def concept_clusters(graph: Graph) -> DataFrame:
    """cluster_id (from 0, by size, then by the first node), member. Nodes without neighbours are clusters of one."""
    nodes = cut(graph.nodes.select("id", "first_seen"))
    weights = cut(weighted_adjacency(graph.edges))
    m2 = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("m")).first()["m"]
    labels = components(weights.select("u", "v"))
    seen = nodes.select(F.col("id").alias("u"), F.col("first_seen").alias("node_seen"))
    rows = weights.join(seen, "u").join(labels.withColumnRenamed("node", "u"), "u")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node_seen", "first_seen", "v"], kind="stable")
        adjacency: dict = {}
        for u, v, w in zip(pdf["u"], pdf["v"], pdf["weight"], strict=True):
            adjacency.setdefault(u, {})[v] = int(w)
        home = move_nodes(list(adjacency), adjacency, m2)
        return pd.DataFrame({"id": list(home), "community": list(home.values())})

    homes = rows.groupBy("label").applyInPandas(kernel, "id string, community string")
    all_nodes = nodes.join(homes, "id", "left").withColumn("community", F.coalesce("community", "id"))
    groups = all_nodes.groupBy("community").agg(F.count("*").alias("n"), F.min("first_seen").alias("first"))
    # Communities, not nodes, are numbered by one task.
    numbered = groups.select("community", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("cluster_id"))
    return all_nodes.join(numbered, "community").select("cluster_id", F.col("id").alias("member"))


def members(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("member")).alias("members")).orderBy("cluster_id")
