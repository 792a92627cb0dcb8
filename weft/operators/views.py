"""What the views show: facts of an entity, neighbourhoods, the drawn graph, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import counted, relation_label, short_date, short_label
from .graph import Graph


def with_titles(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """facts with the title of their note; an unknown note shows its id."""
    titles = notes.select(F.col("note_id").alias("source_note_id"), "title")
    return facts.join(titles, "source_note_id", "left").withColumn("title", F.coalesce("title", "source_note_id"))


def outgoing(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where(F.col("source") == entity)


def incoming(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where(F.col("target") == entity)


def inspector(edges: DataFrame, notes: DataFrame, entity: str) -> DataFrame:
    """Facts from and to an entity with labels, dates and note titles; a loop shows on both sides."""
    out = outgoing(edges, entity).select(F.lit("out").alias("side"), F.col("target").alias("other"), *_FACT)
    into = incoming(edges, entity).select(F.lit("in").alias("side"), F.col("source").alias("other"), *_FACT)
    facts = with_titles(out.unionByName(into), notes)
    return facts.select(
        "side", "other", relation_label(F.col("relation")).alias("label"), short_date(F.col("extracted_at")).alias("day"), "title"
    )


_FACT = ("relation", "extracted_at", "source_note_id")


def cluster_of(clusters: DataFrame, entity: str) -> DataFrame:
    """Shown only where there is more than one mention."""
    return clusters.where((F.col("canonical_name") == entity) & (F.size("all_mentions") > 1))


def merged(clusters: DataFrame) -> DataFrame:
    return clusters.where(F.size("all_mentions") > 1)


def singletons(clusters: DataFrame) -> DataFrame:
    return clusters.where(F.size("all_mentions") == 1)


def triples_per_note(notes: DataFrame, triples: DataFrame) -> DataFrame:
    """note_id, n_triples; notes without facts have 0."""
    counts = triples.groupBy(F.col("source_note_id").alias("note_id")).agg(F.count("*").alias("n"))
    return notes.select("note_id").join(counts, "note_id", "left").select("note_id", F.coalesce("n", F.lit(0)).alias("n_triples"))


def neighbourhood(edges: DataFrame, entity: str) -> DataFrame:
    """The entity and what is one edge away."""
    out = edges.where(F.col("source") == entity).select(F.col("target").alias("id"))
    into = edges.where(F.col("target") == entity).select(F.col("source").alias("id"))
    itself = edges.sparkSession.range(1).select(F.lit(entity).alias("id"))
    return out.unionByName(into).unionByName(itself).distinct()


def active(df: DataFrame, column: str, near: DataFrame | None) -> DataFrame:
    """df with `active`: in the neighbourhood, or all where nothing is selected."""
    if near is None:
        return df.withColumn("active", F.lit(True))
    marks = near.select(F.col("id").alias(column), F.lit(True).alias("hit")).distinct()
    return df.join(marks, column, "left").withColumn("active", F.coalesce("hit", F.lit(False))).drop("hit")


def layout_links(edges: DataFrame) -> DataFrame:
    """One link for each unordered pair (loops too): source, target and relation of its first edge."""
    pair = edges.groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
    return pair.agg(F.min_by(F.struct("source", "target", "relation"), "seq").alias("e")).select("e.*")


def node_view(graph: Graph, clusters: DataFrame, central: DataFrame) -> DataFrame:
    """id, label, cluster (0 if none), radius 7 to 23 by score (0 outside the top), colour."""
    scores = central.select(F.col("entity").alias("id"), "score")
    top = F.broadcast(central.agg(F.max("score").alias("m")).select(F.when(F.coalesce("m", F.lit(0.0)) == 0, 1.0).otherwise(F.col("m")).alias("top")))
    view = graph.nodes.join(clusters.withColumnRenamed("member", "id"), "id", "left").join(F.broadcast(scores), "id", "left").crossJoin(top)
    cluster = F.coalesce("cluster_id", F.lit(0)).cast("long")
    return view.select(
        "id",
        short_label(F.col("id")).alias("label"),
        cluster.alias("cluster_id"),
        (F.lit(7.0) + F.lit(16.0) * F.coalesce("score", F.lit(0.0)) / F.col("top")).alias("radius"),
        (cluster % 8).alias("colour"),
    )


def cluster_cards(clusters: DataFrame) -> DataFrame:
    """cluster_id, members, n_members of the clusters that have members."""
    found = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return found.withColumn("n_members", F.size("members").cast("long")).where("n_members > 0")


def legend(clusters: DataFrame, top: int = 5) -> DataFrame:
    """cluster_id, colour and label (`3 nodes`) of the first clusters."""
    found = clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy("cluster_id").limit(top)
    return found.select("cluster_id", (F.col("cluster_id") % 8).cast("long").alias("colour"), counted(F.col("n"), "node").alias("label"))


def leaderboard(central: DataFrame) -> DataFrame:
    """Scores with their width against the best."""
    best = F.broadcast(central.agg(F.max("score").alias("best")))
    return central.crossJoin(best).withColumn("width", F.when(F.col("best") > 0, F.col("score") / F.col("best") * 100).otherwise(0.0)).drop("best")
