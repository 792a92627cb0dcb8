"""Schemas of the data model."""

from pyspark.sql import types as T


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


S, D, L, TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()

NOTES = _schema(
    ("note_id", S, False),
    ("title", S, False),
    ("content", S, False),
    ("last_edited", TS, True),
    ("last_synced", TS, True),
    ("extraction_status", S, False),
)
#: seq orders facts by entry; every tie downstream is broken by it.
TRIPLES = _schema(
    ("seq", L, False),
    ("triple_id", S, False),
    ("subject_text", S, False),
    ("subject_type", S, False),
    ("relation", S, False),
    ("object_text", S, False),
    ("object_type", S, False),
    ("confidence", D, False),
    ("source_quote", S, True),
    ("source_note_id", S, True),
    ("extracted_at", TS, False),
)
CANONICAL_MAP = _schema(("mention_text", S, False), ("canonical_name", S, False), ("cluster_id", L, False))
MERGE = _schema(("a", S, False), ("b", S, False), ("method", S, False), ("score", D, False))
CLUSTERS = _schema(
    ("cluster_id", L, False),
    ("canonical_name", S, False),
    ("all_mentions", T.ArrayType(S), False),
)
GRAPH_CACHE = _schema(("id", L, False), ("built_at", TS, False), ("graph_json", S, False), ("stats_json", S, False))
#: What an extractor must answer with.
RESPONSE = _schema(
    (
        "triples",
        T.ArrayType(
            _schema(("subject", S, True), ("relation", S, True), ("object", S, True), ("confidence", D, True), ("source_quote", S, True))
        ),
        True,
    )
)
STATUSES = ("pending", "done", "error")
