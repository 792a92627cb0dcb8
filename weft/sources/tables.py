"""Facts, notes and mentions derived from star-schema tables. Every adapter has the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(df: DataFrame, seq: Column, subject: Column, relation: str, obj: Column, **more: Column) -> DataFrame:
    return df.select(
        seq.cast("long").alias("seq"),
        subject.alias("subject_text"),
        F.lit(relation).alias("relation"),
        obj.alias("object_text"),
        more.get("confidence", F.lit(1.0)).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("source_quote"),
        more.get("note", F.lit(None)).cast("string").alias("source_note_id"),
        more.get("at", F.lit("2024-01-01")).cast("timestamp").alias("extracted_at"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order scheduled_for ship date. seq counts within an order, so no global sort: order key * 1000 + place."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    df = table(spark, sf_dir, "lineitem")
    df = df.select("l_orderkey", "l_shipdate", "l_discount", F.row_number().over(w).alias("n"))
    return _facts(
        df,
        F.col("l_orderkey") * 1000 + F.col("n"),
        F.concat(F.lit("order-"), F.col("l_orderkey")),
        "scheduled_for",
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        confidence=1 - F.col("l_discount"),
        note=F.col("l_orderkey"),
        at=F.col("l_shipdate"),
    )


ORDER_FACTS = """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate) AS seq, 'order-' || l_orderkey AS subject_text,
  'scheduled_for' AS relation, strftime(l_shipdate, '%Y-%m-%d') AS object_text, 1 - l_discount AS confidence,
  CAST(l_orderkey AS VARCHAR) AS source_note_id, l_shipdate AS extracted_at FROM lineitem"""


def geo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier located_in nation, nation part_of region. seq: the key times four and a kind."""
    nation = table(spark, sf_dir, "nation")
    names = F.broadcast(nation.select("n_nationkey", "n_name"))  # 25 rows
    region = F.broadcast(table(spark, sf_dir, "region"))  # 5 rows
    customer = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    nation = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = _facts(customer, F.col("c_custkey") * 4 + 1, F.col("c_name"), "located_in", F.col("n_name"))
    out = out.unionByName(_facts(supplier, F.col("s_suppkey") * 4 + 2, F.col("s_name"), "located_in", F.col("n_name")))
    return out.unionByName(_facts(nation, F.col("n_nationkey") * 4, F.col("n_name"), "part_of", F.col("r_name")))


GEO_FACTS = """SELECT c_custkey * 4 + 1 AS seq, c_name AS subject_text, 'located_in' AS relation, n_name AS object_text
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_suppkey * 4 + 2, s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_nationkey * 4, n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""


def supply_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier uses part, part part_of brand, supplier located_in nation.

    seq: suppliers' uses by (supplier, part, order, line), then the parts, then the places; ties have equal facts."""
    line = table(spark, sf_dir, "lineitem")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    names = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    supplier = supplier.join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    pair = F.col("l_suppkey") * 10**9 + F.col("l_partkey") * 8 + F.lit(1)
    out = _facts(line, pair, F.concat(F.lit("supplier-"), "l_suppkey"), "uses", F.concat(F.lit("part-"), "l_partkey"))
    out = out.unionByName(
        _facts(part, F.lit(4 * 10**17) + F.col("p_partkey"), F.concat(F.lit("part-"), "p_partkey"), "part_of", F.col("p_brand"))
    )
    return out.unionByName(
        _facts(
            supplier,
            F.lit(8 * 10**17) + F.col("s_suppkey"),
            F.concat(F.lit("supplier-"), "s_suppkey"),
            "located_in",
            F.col("n_name"),
        )
    )


SUPPLY_FACTS = """SELECT l_suppkey * 1000000000 + l_partkey * 8 + 1 AS seq, 'supplier-' || l_suppkey AS subject_text,
  'uses' AS relation, 'part-' || l_partkey AS object_text FROM lineitem
UNION ALL SELECT 400000000000000000 + p_partkey, 'part-' || p_partkey, 'part_of', p_brand FROM part
UNION ALL SELECT 800000000000000000 + s_suppkey, 'supplier-' || s_suppkey, 'located_in', n_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user related_to event type."""
    df = table(spark, sf_dir, "events")
    return _facts(
        df, F.col("event_id"), F.concat(F.lit("user-"), "user_id"), "related_to", F.col("event_type"), at=F.col("ts"), note=F.col("user_id")
    )


EVENT_FACTS = """SELECT event_id AS seq, 'user-' || user_id AS subject_text, 'related_to' AS relation,
  event_type AS object_text, CAST(user_id AS VARCHAR) AS source_note_id, ts AS extracted_at FROM events"""


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part name part_of the kind that its first word names: the workload of entity resolution."""
    df = table(spark, sf_dir, "part")
    return _facts(df, F.col("p_partkey"), F.col("p_name"), "part_of", F.substring_index("p_name", " ", 1))


PART_MENTIONS = """SELECT p_partkey AS seq, p_name AS subject_text, 'part_of' AS relation,
  split_part(p_name, ' ', 1) AS object_text FROM part"""


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: the first line is the title; ids stand for the time of the last edit."""
    df = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 3 == 0, "pending").when(F.col("doc_id") % 3 == 1, "done").otherwise("error")
    edited = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    return df.select(
        F.concat(F.lit("doc-"), "doc_id").alias("note_id"),
        F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.col("doc_id") % 7 != 0, edited).alias("last_edited"),
        F.lit(None).cast("timestamp").alias("last_synced"),
        status.alias("extraction_status"),
    )


DOCUMENT_NOTES = """SELECT 'doc-' || doc_id AS note_id, coalesce(split_part(text, chr(10), 1), '') AS title,
  coalesce(text, '') AS content,
  CASE WHEN doc_id % 7 <> 0 THEN 1700000000 + doc_id * 60 END AS edited,
  CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'error' END AS extraction_status FROM documents"""
