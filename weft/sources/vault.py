"""The seed vault: eight notes and their facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .schemas import NOTES, TRIPLES

# The seed facts (subject, relation, object, confidence, note, extracted at), in order of entry.
SEED_TRIPLES = [
    ("Sarah", "owns", "the auth migration", 0.95, "n1", "2024-02-01 09:05:00"),
    ("the auth migration", "scheduled_for", "March 15", 0.92, "n1", "2024-02-01 09:05:00"),
    ("Sarah", "reports_to", "Mei Lin", 0.88, "n1", "2024-02-01 09:05:00"),
    ("the auth migration", "uses", "Postgres", 0.80, "n1", "2024-02-01 09:05:00"),
    ("the SSO rollout", "depends_on", "the auth migration", 0.94, "n2", "2024-02-08 14:35:00"),
    ("Sarah K.", "works_on", "the SSO rollout", 0.90, "n2", "2024-02-08 14:35:00"),
    ("the SSO rollout", "uses", "Redis", 0.85, "n2", "2024-02-08 14:35:00"),
    ("Sarah", "works_on", "the SSO rollout", 0.87, "n3", "2024-02-20 11:05:00"),
    ("Sarah Khan", "reports_to", "Raj Patel", 0.86, "n3", "2024-02-20 11:05:00"),
    ("Raj", "located_in", "Berlin", 0.84, "n3", "2024-02-20 11:05:00"),
    ("the auth migration", "scheduled_for", "April 2", 0.93, "n4", "2024-03-05 16:50:00"),
    ("the SSO rollout", "depends_on", "the auth migration", 0.90, "n4", "2024-03-05 16:50:00"),
    ("the dashboard redesign", "part_of", "PromptlyBI", 0.91, "n5", "2024-02-12 10:20:00"),
    ("PromptlyBI", "uses", "Postgres", 0.88, "n5", "2024-02-12 10:20:00"),
    ("PromptlyBI", "uses", "Redis", 0.88, "n5", "2024-02-12 10:20:00"),
    ("Raj P.", "works_on", "PromptlyBI", 0.86, "n5", "2024-02-12 10:20:00"),
    ("Mei Lin", "owns", "the BI project", 0.89, "n6", "2024-02-25 13:25:00"),
    ("the billing service", "depends_on", "the auth migration", 0.90, "n6", "2024-02-25 13:25:00"),
    ("the billing service", "part_of", "Promptly BI", 0.87, "n6", "2024-02-25 13:25:00"),
    ("Mei", "located_in", "London", 0.85, "n6", "2024-02-25 13:25:00"),
    ("Raj Patel", "located_in", "London", 0.90, "n7", "2024-03-10 08:05:00"),
    ("Raj P.", "works_on", "the SSO rollout", 0.85, "n7", "2024-03-10 08:05:00"),
    ("Raj", "works_on", "the dashboard redesign", 0.84, "n7", "2024-03-10 08:05:00"),
    ("the dashboard redesign", "uses", "Postgres", 0.83, "n8", "2024-03-12 17:35:00"),
    ("the billing service", "uses", "Redis", 0.83, "n8", "2024-03-12 17:35:00"),
    ("Tom", "works_on", "the billing service", 0.82, "n8", "2024-03-12 17:35:00"),
]
# When each seed note was last edited.
SEED_NOTES = [
    ("n1", "2024-02-01 09:00:00"),
    ("n2", "2024-02-08 14:30:00"),
    ("n3", "2024-02-20 11:00:00"),
    ("n4", "2024-03-05 16:45:00"),
    ("n5", "2024-02-12 10:15:00"),
    ("n6", "2024-02-25 13:20:00"),
    ("n7", "2024-03-10 08:00:00"),
    ("n8", "2024-03-12 17:30:00"),
]


def seed_triples(spark: SparkSession) -> DataFrame:
    rows = [
        (i, f"t{i + 1}", s, "unknown", r, o, "unknown", c, None, n, datetime.fromisoformat(t))
        for i, (s, r, o, c, n, t) in enumerate(SEED_TRIPLES)
    ]
    return spark.createDataFrame(rows, TRIPLES)


def seed_notes(spark: SparkSession) -> DataFrame:
    """The notes; each one's content is its facts in words."""
    rows = []
    for n, edited in SEED_NOTES:
        facts = [f"{s} {r.replace('_', ' ')} {o}." for s, r, o, _, note, _ in SEED_TRIPLES if note == n]
        rows.append((n, f"Note {n}", " ".join(facts), datetime.fromisoformat(edited), None, "done"))
    return spark.createDataFrame(rows, NOTES)
