"""The persistent tables: notes, raw facts, canonical names, clusters, and a cached graph.

Changes are functions from tables to tables (join, union, filter); Store writes each result as a new version and then
moves a pointer, so readers see a whole version or the one before.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


class NotFound(LookupError):
    pass


def upsert_notes(notes: DataFrame, new: DataFrame, now: Column | None = None, mark_pending: bool = True) -> DataFrame:
    """new(note_id, title, content, last_edited), one row a note. A new note is pending (or done); a known one keeps
    its status unless both times of the last edit are known and differ."""
    now = F.current_timestamp() if now is None else now
    fresh = new.select(
        "note_id", F.col("title").alias("t"), F.col("content").alias("c"), F.col("last_edited").alias("e"), F.lit(True).alias("hit")
    )
    hit, old = F.col("hit").isNotNull(), F.col("extraction_status").isNotNull()
    status = (
        F.when(~old, "pending" if mark_pending else "done")
        .when(F.col("e") != F.col("last_edited"), "pending")
        .otherwise(F.col("extraction_status"))
    )
    joined = notes.join(fresh, "note_id", "full_outer")
    return joined.select(
        "note_id",
        F.when(hit, F.col("t")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.col("c")).otherwise(F.col("content")).alias("content"),
        F.when(hit, F.col("e")).otherwise(F.col("last_edited")).alias("last_edited"),
        F.when(hit, now).otherwise(F.col("last_synced")).cast("timestamp").alias("last_synced"),
        status.alias("extraction_status"),
    )


def set_status(notes: DataFrame, note_id: str, status: str) -> DataFrame:
    if status not in schemas.STATUSES:
        raise ValueError(status)
    changed = F.when(F.col("note_id") == note_id, status).otherwise(F.col("extraction_status"))
    return notes.withColumn("extraction_status", changed)


def drop_triples_of(triples: DataFrame, note_ids: DataFrame) -> DataFrame:
    """Facts of other notes, and those of none."""
    gone = note_ids.select(F.col("note_id").alias("source_note_id"))
    return triples.join(gone, "source_note_id", "left_anti").select(*triples.columns)


def delete_notes(notes: DataFrame, triples: DataFrame, note_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return notes.join(note_ids, "note_id", "left_anti").select(*notes.columns), drop_triples_of(triples, note_ids)


def with_defaults(new: DataFrame, now: Column | None = None) -> DataFrame:
    """Facts to insert: types unknown, confidence 1, no quote and note unless given; one time for the whole batch."""
    now = F.current_timestamp() if now is None else now
    have = set(new.columns)
    for c in ("subject_text", "relation", "object_text"):
        if c not in have:
            raise KeyError(c)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default).alias(name) if name in have else default.alias(name)

    return new.select(
        "subject_text",
        given("subject_type", F.lit("unknown")),
        "relation",
        "object_text",
        given("object_type", F.lit("unknown")),
        given("confidence", F.lit(1.0)),
        given("source_quote", F.lit(None).cast("string")),
        given("source_note_id", F.lit(None).cast("string")),
        now.cast("timestamp").alias("extracted_at"),
    )


def canonical_rows(clusters: DataFrame) -> DataFrame:
    """mention_text, canonical_name, cluster_id; of clusters that share a mention the last wins."""
    rows = clusters.select("cluster_id", "canonical_name", F.explode("all_mentions").alias("mention_text"))
    last = rows.groupBy("mention_text").agg(F.max_by(F.struct("canonical_name", "cluster_id"), "cluster_id").alias("c"))
    return last.select("mention_text", "c.canonical_name", "c.cluster_id")


def newest_first(notes: DataFrame, status: str | None = None) -> DataFrame:
    rows = notes.where(F.col("extraction_status") == status) if status else notes
    return rows.orderBy(F.desc_nulls_last("last_edited"), "note_id")


def db_stats(notes: DataFrame, triples: DataFrame, clusters: DataFrame, cache: DataFrame) -> DataFrame:
    one = notes.agg(F.count("*").alias("notes_total"), F.count_if(F.col("extraction_status") == "pending").alias("notes_pending"))
    one = one.crossJoin(triples.agg(F.count("*").alias("triples_total")))  # rows of one
    one = one.crossJoin(clusters.agg(F.count("*").alias("entity_clusters")))
    return one.crossJoin(cache.agg((F.count("*") > 0).alias("graph_cached")))


class Store:
    """Versioned parquet tables under one folder."""

    TABLES = {
        "notes": schemas.NOTES,
        "raw_triples": schemas.TRIPLES,
        "canonical_map": schemas.CANONICAL_MAP,
        "entity_clusters": schemas.CLUSTERS,
        "graph_cache": schemas.GRAPH_CACHE,
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.folder}/{table}/current"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def init(self) -> None:
        """Make the tables that are not there yet."""
        for table, schema in self.TABLES.items():
            at, fs = self._fs(self._pointer(table))
            if not fs.exists(at):
                self.write(table, self.spark.createDataFrame([], schema))

    def write(self, table: str, df: DataFrame) -> None:
        schema = self.TABLES[table]
        version = uuid.uuid4().hex
        df.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)).write.parquet(f"{self.folder}/{table}/{version}")
        at, fs = self._fs(self._pointer(table))
        draft, _ = self._fs(f"{self.folder}/{table}/draft-{version}")
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        # One step: a reader finds the old pointer or the new one.
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, how)

    def vacuum(self, table: str) -> int:
        """Remove the versions that the pointer does not name, once no reader uses them; how many went."""
        at, fs = self._fs(f"{self.folder}/{table}")
        current, gone = self._version(table), 0
        for f in fs.listStatus(at):
            if f.isDirectory() and f.getPath().getName() != current:
                gone += fs.delete(f.getPath(), True)
        return gone

    def _version(self, table: str) -> str:
        at, fs = self._fs(self._pointer(table))
        stream = fs.open(at)
        version = bytes(stream.readAllBytes()).decode()
        stream.close()
        return version

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(self.TABLES[table]).parquet(f"{self.folder}/{table}/{self._version(table)}")

    def get_notes(self, status: str | None = None) -> DataFrame:
        return newest_first(self.read("notes"), status)

    def get_note(self, note_id: str):
        return self.read("notes").where(F.col("note_id") == note_id).first()

    def upsert_note(self, note_id: str, title: str, content: str, last_edited: datetime | None = None, mark_pending: bool = True) -> None:
        new = self.spark.createDataFrame(
            [(note_id, title, content, last_edited)], "note_id string, title string, content string, last_edited timestamp"
        )
        self.write("notes", upsert_notes(self.read("notes"), new, mark_pending=mark_pending))

    def create_note(self, note_id: str, title: str, content: str, last_edited: datetime | None = None):
        self.upsert_note(note_id, title, content, last_edited)
        return self.get_note(note_id)

    def mark_note_done(self, note_id: str) -> None:
        self.write("notes", set_status(self.read("notes"), note_id, "done"))

    def mark_note_error(self, note_id: str) -> None:
        self.write("notes", set_status(self.read("notes"), note_id, "error"))

    def delete_triples_for_note(self, note_id: str) -> None:
        self.write("raw_triples", drop_triples_of(self.read("raw_triples"), self._ids(note_id)))

    def delete_note(self, note_id: str) -> None:
        if self.get_note(note_id) is None:
            raise NotFound(note_id)
        notes, triples = delete_notes(self.read("notes"), self.read("raw_triples"), self._ids(note_id))
        self.write("raw_triples", triples)
        self.write("notes", notes)

    def _ids(self, note_id: str) -> DataFrame:
        return self.spark.createDataFrame([(note_id,)], "note_id string")

    def insert_triples(self, rows: list[dict]) -> None:
        """Append a batch; facts must name a known note or none."""
        if not rows:
            return
        for r in rows:
            for c in ("subject_text", "relation", "object_text"):
                if r.get(c) is None:
                    raise KeyError(c)
        fields = [f for f in schemas.TRIPLES.fields if f.name not in ("seq", "triple_id", "extracted_at")]
        old = self.read("raw_triples")
        first = (old.agg(F.max("seq").alias("m")).first()["m"] or 0) + 1 if not old.isEmpty() else 0
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        values = [(first + i, *(r.get(f.name) for f in fields)) for i, r in enumerate(rows)]
        new = self.spark.createDataFrame(values, f"seq long, {types}")
        known = self.read("notes").select(F.col("note_id").alias("source_note_id"))
        strays = new.where("source_note_id IS NOT NULL").join(known, "source_note_id", "left_anti")
        if not strays.isEmpty():
            raise ValueError("a fact names an unknown note")
        now = F.lit(datetime.now(timezone.utc))
        filled = with_defaults(new, now).columns
        batch = new.select("seq", F.concat(F.lit("t"), F.col("seq") + 1).alias("triple_id"), *_filled(filled, now))
        self.write("raw_triples", old.unionByName(batch))

    def get_all_triples(self) -> DataFrame:
        return self.read("raw_triples").orderBy(F.desc("extracted_at"), "triple_id")

    def replace_canonical_map(self, clusters: DataFrame) -> None:
        self.write("entity_clusters", clusters)
        self.write("canonical_map", canonical_rows(self.read("entity_clusters")))

    def get_canonical_map(self) -> DataFrame:
        return self.read("canonical_map").select("mention_text", "canonical_name")

    def get_entity_clusters(self) -> DataFrame:
        return self.read("entity_clusters")

    def cache_graph(self, graph_json: str, stats_json: str) -> None:
        row = [(1, datetime.now(timezone.utc), graph_json, stats_json)]
        self.write("graph_cache", self.spark.createDataFrame(row, schemas.GRAPH_CACHE))

    def get_cached_graph(self):
        return self.read("graph_cache").first()

    def get_graph(self) -> dict:
        """The cached graph with its time and stats; where none is cached, one without nodes."""
        found = self.get_cached_graph()
        if found:
            return {"built_at": found["built_at"], "graph": json.loads(found["graph_json"]), "stats": json.loads(found["stats_json"])}
        lists = ("central_entities", "concept_clusters", "contradictions", "predicted_links", "entity_clusters")
        return {"built_at": None, "graph": {"nodes": [], "edges": []}, "stats": {"nodes": 0, "edges": 0} | {k: [] for k in lists}}

    def stats(self) -> dict:
        return db_stats(*(self.read(t) for t in ("notes", "raw_triples", "entity_clusters", "graph_cache"))).first().asDict()


def _filled(columns: list[str], now: Column) -> list[Column]:
    defaults = {"subject_type": F.lit("unknown"), "object_type": F.lit("unknown"), "confidence": F.lit(1.0)}
    out = []
    for c in columns:
        if c == "extracted_at":
            out.append(now.cast("timestamp").alias(c))
        else:
            out.append(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c))
    return out
