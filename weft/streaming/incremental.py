"""Notes arriving as a stream: each batch is upserted, its pending notes are extracted, and the facts appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.extract import Extractor, parse, respond, rule_extractor, to_triples
from ..sources.shared import cut
from ..sources.store import Store, drop_triples_of, upsert_notes


def numbered(parsed: DataFrame) -> DataFrame:
    """note_id, first: places left before each note of a batch, so that facts follow one another by note and place.

    Notes are ranked within 64 ranges of their ids, and a range starts after those before it: no task sees all."""
    size = parsed.select("note_id", F.size("triples").cast("long").alias("n"))
    ranged = cut(size.repartitionByRange(64, "note_id").withColumn("part", F.spark_partition_id()))
    total = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # 64 rows at most
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.select("part", start.alias("start"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("note_id").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("before", F.coalesce(before, F.lit(0))).join(total, "part").select("note_id", (F.col("start") + F.col("before")).alias("first"))


def apply_batch(store: Store, batch: DataFrame, extractor: Extractor = rule_extractor) -> None:
    """batch(note_id, title, content, last_edited); of several rows of a note the last edited counts. Applying a batch
    again changes nothing but times and places."""
    one = batch.groupBy("note_id").agg(F.max_by(F.struct("title", "content", "last_edited"), F.coalesce("last_edited", F.lit("1970-01-01").cast("timestamp"))).alias("n"))
    notes = upsert_notes(store.read("notes"), one.select("note_id", "n.*"))
    store.write("notes", notes)
    extract_pending(store, extractor)


def extract_pending(store: Store, extractor: Extractor = rule_extractor) -> None:
    """Facts of all pending notes take the place of those they had; a note whose extraction fails becomes `error` and
    has none."""
    pending = cut(store.read("notes").where("extraction_status = 'pending'"))
    parsed = cut(parse(respond(pending, extractor)))
    facts = to_triples(parsed).join(numbered(parsed.where("ok")).select(F.col("note_id").alias("source_note_id"), "first"), "source_note_id")
    kept = drop_triples_of(store.read("raw_triples"), pending.select("note_id"))
    after = kept.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m")).first()["m"] + 1
    new = facts.select(
        (F.lit(after) + F.col("first") + F.substring_index("triple_id", "-x", -1).cast("long")).alias("seq"),
        "triple_id",
        "subject_text",
        F.lit("unknown").alias("subject_type"),
        "relation",
        "object_text",
        F.lit("unknown").alias("object_type"),
        "confidence",
        "source_quote",
        "source_note_id",
        F.current_timestamp().alias("extracted_at"),
    )
    store.write("raw_triples", kept.unionByName(new))
    status = parsed.select("note_id", F.when(F.col("ok"), "done").otherwise("error").alias("now"))
    notes = store.read("notes").join(status, "note_id", "left")
    store.write("notes", notes.withColumn("extraction_status", F.coalesce("now", "extraction_status")))


def run_stream(store: Store, notes: DataFrame, checkpoint: str, extractor: Extractor = rule_extractor) -> StreamingQuery:
    return (
        notes.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: apply_batch(store, batch, extractor))
        .trigger(availableNow=True)
        .start()
    )
