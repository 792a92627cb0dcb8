"""Sessions: tables loaded from a store or the seed, notes added by hand, and runs that are kept in the store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import note_title, trimmed
from ..sources import schemas, vault
from ..sources.extract import Extractor, parse, respond, rule_extractor, to_triples
from ..sources.store import Store
from ..streaming.incremental import extract_pending
from .pipeline import PipelineResult, run_pipeline


def load(spark: SparkSession, store: Store | None) -> tuple[DataFrame, DataFrame, bool]:
    """Notes, facts and whether they are the store's. Without a store, or where it cannot be read or holds no notes, the
    seed stands in. A note without a time of its last edit keeps null."""
    try:
        if store and not store.read("notes").isEmpty():
            return store.read("notes"), store.read("raw_triples"), True
    except Exception:  # unreachable or not made yet
        pass
    return vault.seed_notes(spark), vault.seed_triples(spark), False


def backend_view(notes: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables under the names that clients use; a note that was never edited has its id as lastEdited."""
    edited = F.coalesce(F.date_format("last_edited", "yyyy-MM-dd'T'HH:mm:ss"), "note_id")
    n = notes.select(F.col("note_id").alias("id"), "title", "content", edited.alias("lastEdited"), F.col("extraction_status").alias("extractionStatus"))
    t = triples.select(
        F.col("triple_id").cast("string").alias("id"),
        F.col("subject_text").alias("subjectText"),
        "relation",
        F.col("object_text").alias("objectText"),
        "confidence",
        F.col("source_quote").alias("sourceQuote"),
        F.col("source_note_id").alias("sourceNoteId"),
        F.col("extracted_at").alias("extractedAt"),
    )
    return n, t


def build_note(spark: SparkSession, note_id: str, title: str | None, content: str, now) -> DataFrame | None:
    """A note as it is entered by hand: trimmed, with a title in any case, done at once; none where there is no content."""
    row = spark.createDataFrame([(note_id, title, content, now)], "note_id string, title string, content string, last_edited timestamp")
    row = row.select("note_id", note_title(F.col("title")).alias("title"), trimmed(F.col("content")).alias("content"), "last_edited")
    row = row.withColumns({"last_synced": F.lit(None).cast("timestamp"), "extraction_status": F.lit("done")})
    return None if row.where(F.length("content") > 0).isEmpty() else row.select(*schemas.NOTES.names)


class Session:
    """Notes and facts in hand; adding a note runs everything anew."""

    def __init__(self, notes: DataFrame, triples: DataFrame):
        self.notes, self.triples = notes, triples
        self.result: PipelineResult = run_pipeline(notes, triples)

    def add_note(self, note_id: str, title: str | None, content: str, now, extractor: Extractor = rule_extractor) -> str | None:
        """Extract the note's facts and put both at the end of what is there; the error, if it fails, and nothing changes."""
        spark = self.notes.sparkSession
        note = build_note(spark, note_id, title, content, now)
        if note is None:
            return "no content"
        parsed = parse(respond(note, extractor))
        answer = parsed.first()
        if not answer["ok"]:
            return answer["error"]
        first = self.triples.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m")).first()["m"] + 1
        place = F.substring_index("triple_id", "-x", -1).cast("long") + first
        filled = to_triples(parsed).withColumns(
            {"seq": place, "subject_type": F.lit("unknown"), "object_type": F.lit("unknown"), "extracted_at": F.lit(now).cast("timestamp")}
        )
        self.notes = note.unionByName(self.notes.select(*note.columns))
        self.triples = self.triples.unionByName(filled.select(*self.triples.columns))
        self.result = run_pipeline(self.notes, self.triples)
        return None


def run_store(store: Store, extractor: Extractor = rule_extractor, mode: str = "incremental", top: int = 10) -> PipelineResult:
    """Extract (pending notes, or with `full` all), resolve, build the graph, and keep names, clusters and stats in the
    store. What the cached JSON lists is bounded by `top`; whole tables stay tables."""
    if mode not in ("incremental", "full"):
        raise ValueError(mode)
    if mode == "full":
        store.write("notes", store.read("notes").withColumn("extraction_status", F.lit("pending")))
    extract_pending(store, extractor)
    result = run_pipeline(store.read("notes"), store.read("raw_triples"), top)
    by_hash = F.xxhash64("canonical_name").alias("cluster_id")
    store.replace_canonical_map(result.resolution.clusters.select(by_hash, "canonical_name", "all_mentions"))
    rows = lambda df: [json.loads(x) for x in df.limit(top).toJSON().collect()]
    nodes, edges = result.graph.nodes, result.graph.edges
    stats = {
        "nodes": nodes.count(),
        "edges": edges.count(),
        "central_entities": rows(result.central),
        "concept_clusters": rows(result.clusters.groupBy("cluster_id").agg(F.count("*").alias("n_members")).orderBy("cluster_id")),
        "contradictions": rows(result.contradictions),
        "predicted_links": rows(result.predicted),
        "entity_clusters": rows(result.resolution.clusters.orderBy(F.desc("n_mentions"), "canonical_name").select("canonical_name", "n_mentions")),
    }
    shown = {"nodes": rows(nodes.orderBy(F.desc("degree"), "first_seen")), "edges": rows(edges.orderBy("seq"))}
    store.cache_graph(json.dumps(shown), json.dumps(stats))
    return result
