"""PageRank with a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .graph import Graph, simple_links


def pagerank(graph: Graph, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """id, first_seen, score after exactly `rounds` rounds. Uniform start; what nodes without links hold is spread over
    all nodes.

    A round maps ranks r to b + damping * P r, where P follows the links and b, the same for every node, holds the
    teleport and what link-less nodes lost. Unrolled, the result is a sum of b's times powers of P applied to ones. The
    powers need no b, so a round is one join and one sum with nothing global in it; b's follow on the driver from one
    number a round. Where no mass is left to flow (no cycles) the rest of the rounds cost nothing.
    """
    nodes = cut(graph.nodes.select("id", "first_seen"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    links = simple_links(graph.edges)
    out = links.groupBy("source").agg(F.count("*").alias("out"))
    ends = out.select(F.col("source").alias("target"), F.lit(False).alias("ends"))
    links = links.join(out, "source").join(ends, "target", "left")
    links = cut(links.select(F.col("source").alias("id"), "target", "out", F.coalesce("ends", F.lit(True)).alias("ends")))
    ends = nodes.select("id").join(out.withColumnRenamed("source", "id"), "id", "left")
    power = cut(ends.select("id", F.lit(1.0).alias("x"), F.col("out").isNull().alias("ends")))
    powers, lost = [power], [float(power.where("ends").count())]
    while len(powers) <= rounds:
        flow = links.select("id", "target", "out", F.col("ends").alias("target_ends")).join(power.select("id", "x"), "id")
        flow = flow.groupBy(F.col("target").alias("id"), F.col("target_ends").alias("ends"))
        power = cut(flow.agg(F.sum(F.col("x") / F.col("out")).alias("x")).select("id", "x", "ends"))
        one = power.agg(F.count("*").alias("n"), F.sum(F.when(F.col("ends"), F.col("x"))).alias("lost")).first()
        if not one["n"]:
            break
        powers.append(power)
        lost.append(one["lost"] or 0.0)
    d, base = damping, []
    at = lambda k: lost[k] if k < len(lost) else 0.0
    for t in range(rounds):
        gone = sum(base[t - 1 - k] * d**k * at(k) for k in range(min(t, len(lost)))) + d**t * at(t) / n
        base.append((1 - d + d * gone) / n)
    total = None
    for k, power in enumerate(powers):
        weight = d**k * (base[rounds - 1 - k] if k < rounds else 1 / n)
        part = power.select("id", (F.col("x") * weight).alias("x"))
        total = part if total is None else total.unionByName(part)
    return nodes.join(total.groupBy("id").agg(F.sum("x").alias("score")), "id")


def central_entities(graph: Graph, top: int = 10, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """rank, entity, score of the first `top`; sums that differ by rounding tie, and ties go to the node seen first."""
    scores = pagerank(graph, damping, rounds)
    best = scores.orderBy(F.desc(F.round("score", 12)), "first_seen", "id").limit(top)
    place = F.row_number().over(_order())  # over `top` rows
    return best.select(place.cast("long").alias("rank"), F.col("id").alias("entity"), "score").orderBy("rank")


def _order():
    from pyspark.sql import Window

    return Window.orderBy(F.desc(F.round("score", 12)), "first_seen", "id")
