"""The concept graph and its projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    nodes: DataFrame  #: id, mention_count, degree, first_seen
    edges: DataFrame  #: seq, source, target, relation, confidence, source_note_id, source_quote, extracted_at


def build_edges(triples: DataFrame, canonical_map: DataFrame | None = None) -> DataFrame:
    """Facts between canonical names; a mention that is not in the map stands for itself. Parallel edges stay."""
    source, target = F.col("subject_text"), F.col("object_text")
    if canonical_map is not None:
        s = canonical_map.select(F.col("mention_text").alias("subject_text"), F.col("canonical_name").alias("s_name"))
        o = canonical_map.select(F.col("mention_text").alias("object_text"), F.col("canonical_name").alias("o_name"))
        triples = triples.join(s, "subject_text", "left").join(o, "object_text", "left")
        source, target = F.coalesce("s_name", "subject_text"), F.coalesce("o_name", "object_text")
    return triples.select(
        "seq",
        source.alias("source"),
        target.alias("target"),
        "relation",
        "confidence",
        "source_note_id",
        "source_quote",
        "extracted_at",
    )


def _ends(edges: DataFrame) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("id")), F.struct(F.lit(1).alias("side"), F.col("target").alias("id"))))
    return edges.select("seq", sides.alias("e")).select(F.col("e.id").alias("id"), (F.col("seq") * 2 + F.col("e.side")).alias("place"))


def degrees(edges: DataFrame) -> DataFrame:
    """Every edge counts at both ends, a loop twice."""
    return _ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.min("place").alias("first_seen"))


def build_nodes(edges: DataFrame, canonical_map: DataFrame | None = None) -> DataFrame:
    nodes = degrees(edges)
    if canonical_map is None:
        return nodes.withColumn("mention_count", F.lit(1).cast("long"))
    counts = canonical_map.groupBy(F.col("canonical_name").alias("id")).agg(F.count("*").alias("mention_count"))
    return nodes.join(counts, "id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(1).cast("long")))


def build_graph(triples: DataFrame, canonical_map: DataFrame | None = None) -> Graph:
    edges = build_edges(triples, canonical_map)
    return Graph(build_nodes(edges, canonical_map), edges)


def simple_links(edges: DataFrame) -> DataFrame:
    """Distinct directed links without loops."""
    return edges.where("source <> target").select("source", "target").distinct()


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    """u, v, weight, first_seen in both directions: parallel edges add one each, confidence does not count."""
    plain = edges.where("source <> target")
    both = plain.select("seq", F.col("source").alias("u"), F.col("target").alias("v")).unionByName(
        plain.select("seq", F.col("target").alias("u"), F.col("source").alias("v"))
    )
    return both.groupBy("u", "v").agg(F.count("*").alias("weight"), F.min("seq").alias("first_seen"))


def neighbours(edges: DataFrame) -> DataFrame:
    """u, v in both directions, once each."""
    links = edges.where("source <> target")
    both = links.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def neighbour_order(edges: DataFrame) -> DataFrame:
    """id, first_seen among edges that are no loops."""
    return _ends(edges.where("source <> target")).groupBy("id").agg(F.min("place").alias("first_seen"))
