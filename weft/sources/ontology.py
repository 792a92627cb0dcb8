"""Relation ontologies: `core` for the analytics, `typed` (domains and ranges) for validating facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation, may it have one value only, meaning.
CORE = (
    ("owns", False, "the subject answers for the object"),
    ("works_on", False, "the subject contributes to the object"),
    ("depends_on", False, "the subject waits for the object"),
    ("blocks", False, "the subject holds up the object"),
    ("part_of", False, "the subject belongs to the object"),
    ("scheduled_for", True, "the object is the subject's date"),
    ("located_in", True, "the object is the subject's place"),
    ("reports_to", True, "the object is the subject's manager"),
    ("uses", False, "the subject makes use of the object"),
    ("related_to", False, "any other relation"),
)
# Entity types of the typed profile.
TYPES = ("person", "project", "concept", "tool", "event", "organisation", "date", "unknown")
# Relation, domain, range, may it have one value only; * is any type.
TYPED = (
    ("owns", ("person",), ("project", "concept", "tool"), False),
    ("reports_to", ("person",), ("person",), True),
    ("depends_on", ("project", "concept"), ("project", "concept", "tool"), False),
    ("implements", ("project", "person"), ("concept", "tool"), False),
    ("scheduled_for", ("project", "event"), ("date",), True),
    ("uses", ("person", "project"), ("tool", "concept"), False),
    ("part_of", ("*",), ("project", "organisation"), False),
    ("related_to", ("*",), ("*",), False),
    ("blocks", ("project", "event", "concept"), ("project", "event"), False),
    ("created_by", ("project", "tool", "concept"), ("person", "organisation"), False),
)
RELATIONS = tuple(r for r, _, _ in CORE)
FUNCTIONAL = tuple(r for r, one, _ in CORE if one)


def core_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORE, "name string, functional boolean, description string")


def typed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPED, "name string, domain array<string>, range array<string>, functional boolean")


def is_relation(relation: Column) -> Column:
    return relation.isin(*RELATIONS)


def is_functional(relation: Column) -> Column:
    """core profile; an unknown relation is not functional."""
    return F.coalesce(relation.isin(*FUNCTIONAL), F.lit(False))


def typed_functional(triples: DataFrame, spark: SparkSession) -> DataFrame:
    rules = F.broadcast(typed_table(spark).select(F.col("name").alias("relation"), "functional"))  # ten rows
    return triples.join(rules, "relation", "left").withColumn("functional", F.coalesce("functional", F.lit(False)))


def validate_typed(triples: DataFrame) -> DataFrame:
    """triples with `valid`: the relation is known and takes the subject's and the object's type."""
    rules = F.broadcast(typed_table(triples.sparkSession).drop("functional"))  # ten rows

    def fits(types: str, value: str) -> Column:
        return F.array_contains(types, "*") | F.array_contains(F.col(types), F.col(value))

    joined = triples.join(rules, triples.relation == rules.name, "left")
    ok = F.coalesce(fits("domain", "subject_type") & fits("range", "object_type"), F.lit(False))
    return joined.withColumn("valid", ok).drop("name", "domain", "range")


def prompt_lines() -> str:
    return "\n".join(f"- {name}: {meaning}" for name, _, meaning in CORE)
