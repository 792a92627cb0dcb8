"""Facts that should have one value and have several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ontology import is_functional


def latest_values(edges: DataFrame) -> DataFrame:
    """The latest edge of each (entity, relation, value), the earliest entered of those with equal time."""
    facts = edges.where(is_functional(F.col("relation")))
    best = F.max_by(
        F.struct("extracted_at", "source_note_id", "source_quote"), F.struct(F.col("extracted_at"), -F.col("seq"))
    )
    one = facts.groupBy(F.col("source").alias("entity"), "relation", F.col("target").alias("value"))
    return one.agg(best.alias("e"), F.min("seq").alias("first_seen")).select("entity", "relation", "value", "e.*", "first_seen")


def contradictions(edges: DataFrame) -> DataFrame:
    """entity, relation, values (by time, then first seen), n_values, first_seen."""
    one = latest_values(edges)
    value = F.struct("extracted_at", "first_seen", "value", "source_note_id", "source_quote")
    many = one.groupBy("entity", "relation").agg(
        F.array_sort(F.collect_list(value)).alias("values"), F.count("*").alias("n_values"), F.min("first_seen").alias("first_seen")
    )
    return many.where("n_values > 1")


def in_order(found: DataFrame) -> DataFrame:
    first = found.groupBy("entity").agg(F.min("first_seen").alias("entity_seen"))
    return found.join(first, "entity").orderBy("entity_seen", "first_seen").drop("entity_seen")


def long_form(found: DataFrame) -> DataFrame:
    rows = found.select("entity", "relation", "n_values", F.posexplode("values").alias("pos", "v"))
    return rows.select(
        "entity",
        "relation",
        F.col("pos").cast("long").alias("pos"),
        F.col("v.value").alias("value"),
        F.col("v.extracted_at").alias("extracted_at"),
        F.col("v.source_note_id").alias("source_note_id"),
        (F.col("pos") == F.col("n_values") - 1).alias("is_latest"),
    )
