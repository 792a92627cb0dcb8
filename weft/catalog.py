"""Every registered query of the concept-graph engine, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity, text
from .operators import contradictions as conflicts
from .operators import graph as graphs
from .operators import links, louvain, pagerank, resolve, views
from .plans.pipeline import run_pipeline
from .sources import extract, ontology, store
from .sources import tables as T
from .sources.shared import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Edges of the order facts and of the supply facts, as the reference graph builds them without a canonical map.
_FUNCTIONAL = "('scheduled_for', 'located_in', 'reports_to')"
_ENDS = "SELECT subject_text AS id, 2 * seq AS place FROM f UNION ALL SELECT object_text, 2 * seq + 1 FROM f"
_PLAIN = "SELECT * FROM f WHERE subject_text <> object_text"
_NEAR = f"SELECT DISTINCT u, v FROM (SELECT subject_text AS u, object_text AS v FROM ({_PLAIN}) UNION ALL SELECT object_text, subject_text FROM ({_PLAIN}))"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return graphs.build_edges(T.supply_facts(spark, d))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return graphs.build_edges(T.order_facts(spark, d))


# Contradictions.


@query(
    f"""WITH f AS ({T.ORDER_FACTS}), one AS (
  SELECT subject_text, relation, object_text, max(extracted_at) AS tm, min(seq) AS first_seen FROM f
  WHERE relation IN {_FUNCTIONAL} GROUP BY ALL)
SELECT subject_text AS entity, relation, count(*) AS n_values,
  string_agg(object_text, '|' ORDER BY tm, first_seen) AS facts FROM one GROUP BY ALL HAVING count(*) > 1"""
)
def contradictions(spark, d):
    found = conflicts.contradictions(_orders(spark, d))
    values = F.array_join(F.transform("values", lambda v: v["value"]), "|")
    return found.select("entity", "relation", "n_values", values.alias("facts"))


@query(
    f"""WITH f AS ({T.ORDER_FACTS}), one AS (
  SELECT subject_text AS entity, relation, object_text AS value, max(extracted_at) AS tm, min(seq) AS first_seen,
    arg_max(source_note_id, (extracted_at, -seq)) AS source_note_id
  FROM f GROUP BY ALL), pos AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY entity, relation) AS n FROM one
  WINDOW w AS (PARTITION BY entity, relation ORDER BY tm, first_seen))
SELECT entity, relation, pos, value, strftime(tm, '%b %-d, %Y') AS day, source_note_id, pos = n - 1 AS is_latest
FROM pos WHERE n > 1"""
)
def contradiction_latest(spark, d):
    rows = conflicts.long_form(conflicts.contradictions(_orders(spark, d)))
    return rows.select("entity", "relation", "pos", "value", text.long_date(F.col("extracted_at")).alias("day"), "source_note_id", "is_latest")


# Notes and persistence.


@query(
    f"""SELECT note_id, title, extraction_status, edited, length(content) AS n_content
FROM ({T.DOCUMENT_NOTES}) WHERE extraction_status = 'pending'"""
)
def notes_by_status(spark, d):
    rows = store.newest_first(T.document_notes(spark, d), "pending")
    return rows.select("note_id", "title", "extraction_status", F.unix_timestamp("last_edited").alias("edited"), F.length("content").cast("long").alias("n_content"))


_NEW_NOTES = """SELECT 'doc-' || doc_id AS note_id, 'again' AS title, coalesce(text, '') || lang AS content,
  CASE WHEN doc_id % 5 <> 0 THEN 1700000000 + doc_id * 60 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 9 END END AS edited
  FROM (SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, text, lang FROM documents)"""


def _new_notes(spark, d):
    docs = T.table(spark, d, "documents")
    docs = docs.select("text", F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), "lang")
    later = F.when(F.col("doc_id") % 2 == 0, 0).otherwise(9)
    edited = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60 + later)
    return docs.select(
        F.concat(F.lit("doc-"), "doc_id").alias("note_id"),
        F.lit("again").alias("title"),
        F.concat(F.coalesce("text", F.lit("")), "lang").alias("content"),
        F.when(F.col("doc_id") % 5 != 0, edited).alias("last_edited"),
    )


@query(
    f"""WITH o AS ({T.DOCUMENT_NOTES}), n AS ({_NEW_NOTES})
SELECT coalesce(o.note_id, n.note_id) AS note_id, CASE WHEN n.note_id IS NULL THEN o.title ELSE n.title END AS title,
  md5(CASE WHEN n.note_id IS NULL THEN o.content ELSE n.content END) AS content_md5,
  CASE WHEN n.note_id IS NULL THEN o.edited ELSE n.edited END AS edited,
  CASE WHEN o.note_id IS NULL THEN 'pending' WHEN n.edited <> o.edited THEN 'pending' ELSE o.extraction_status END AS status
FROM o FULL JOIN n ON o.note_id = n.note_id"""
)
def upsert_note(spark, d):
    out = store.upsert_notes(T.document_notes(spark, d), _new_notes(spark, d))
    return out.select(
        "note_id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.unix_timestamp("last_edited").alias("edited"), F.col("extraction_status").alias("status")
    )


@query(
    f"""WITH n AS ({T.DOCUMENT_NOTES}), f AS ({T.EVENT_FACTS}), gone AS (SELECT note_id FROM n WHERE extraction_status = 'error'),
t AS (SELECT 'doc-' || source_note_id AS source_note_id FROM f)
SELECT 'notes' AS part, count(*) AS n FROM n WHERE note_id NOT IN (SELECT note_id FROM gone)
UNION ALL SELECT 'triples', count(*) FROM t WHERE source_note_id NOT IN (SELECT note_id FROM gone)"""
)
def note_delete_cascade(spark, d):
    notes = T.document_notes(spark, d)
    facts = T.event_facts(spark, d).withColumn("source_note_id", F.concat(F.lit("doc-"), "source_note_id"))
    left, kept = store.delete_notes(notes, facts, notes.where("extraction_status = 'error'").select("note_id"))
    out = left.agg(F.lit("notes").alias("part"), F.count("*").alias("n"))
    return out.unionByName(kept.agg(F.lit("triples").alias("part"), F.count("*").alias("n")))


@query(
    """SELECT 'user-' || user_id AS subject_text, 'unknown' AS subject_type, 'related_to' AS relation, event_type AS object_text,
  'unknown' AS object_type, coalesce(CASE WHEN event_id % 2 = 0 THEN 0.5 END, 1.0)::DOUBLE AS confidence,
  NULL::VARCHAR AS source_quote, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS source_note_id,
  epoch(TIMESTAMP '2024-01-01')::BIGINT AS at FROM events"""
)
def insert_defaults(spark, d):
    rows = T.table(spark, d, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("subject_text"),
        F.lit("related_to").alias("relation"),
        F.col("event_type").alias("object_text"),
        F.when(F.col("event_id") % 2 == 0, 0.5).alias("confidence"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n"), "event_id")).alias("source_note_id"),
    )
    out = store.with_defaults(rows, F.lit("2024-01-01 00:00:00"))
    return out.withColumn("at", F.unix_timestamp("extracted_at")).drop("extracted_at")


@query(
    f"""WITH n AS ({T.DOCUMENT_NOTES}), f AS ({T.ORDER_FACTS})
SELECT (SELECT count(*) FROM n) AS notes_total, (SELECT count(*) FROM n WHERE extraction_status = 'pending') AS notes_pending,
  (SELECT count(*) FROM f) AS triples_total, (SELECT count(DISTINCT p_name) FROM part) AS entity_clusters, true AS graph_cached"""
)
def db_stats(spark, d):
    clusters, cache = T.table(spark, d, "part").select("p_name").distinct(), T.table(spark, d, "region").limit(1)
    return store.db_stats(T.document_notes(spark, d), T.order_facts(spark, d), clusters, cache)


@query(
    f"""WITH f AS ({T.EVENT_FACTS}), n AS ({T.DOCUMENT_NOTES}),
c AS (SELECT 'doc-' || source_note_id AS note_id, count(*) AS n FROM f GROUP BY ALL)
SELECT note_id, coalesce(c.n, 0) AS n_triples, coalesce(c.n, 0) || CASE WHEN coalesce(c.n, 0) = 1 THEN ' triple' ELSE ' triples' END AS label
FROM n LEFT JOIN c USING (note_id)"""
)
def triples_per_note(spark, d):
    facts = T.event_facts(spark, d).withColumn("source_note_id", F.concat(F.lit("doc-"), "source_note_id"))
    out = views.triples_per_note(T.document_notes(spark, d), facts)
    return out.withColumn("label", text.counted(F.col("n_triples"), "triple"))


@query(
    """SELECT mention_text, arg_max(canonical_name, cluster_id) AS canonical_name, max(cluster_id) AS cluster_id FROM (
  SELECT p_name AS mention_text, p_brand AS canonical_name, CAST(substr(p_brand, 7) AS BIGINT) AS cluster_id FROM part) GROUP BY 1"""
)
def canonical_map(spark, d):
    rows = T.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("all_mentions"))
    rows = rows.select(F.substring("p_brand", 7, 9).cast("long").alias("cluster_id"), F.col("p_brand").alias("canonical_name"), "all_mentions")
    return store.canonical_rows(rows)


# Ontology and extraction.


@query(
    f"""WITH f AS ({T.GEO_FACTS}), k AS (SELECT *, CASE seq % 5 WHEN 0 THEN 'knows' WHEN 1 THEN 'reports_to' ELSE relation END AS r FROM f)
SELECT r AS relation, r IN {_FUNCTIONAL} AS functional, count(*) AS n FROM k
WHERE r IN {ontology.RELATIONS} GROUP BY ALL"""
)
def ontology_filter(spark, d):
    rel = F.when(F.col("seq") % 5 == 0, "knows").when(F.col("seq") % 5 == 1, "reports_to").otherwise(F.col("relation"))
    rows = T.geo_facts(spark, d).withColumn("relation", rel).where(ontology.is_relation(F.col("relation")))
    return rows.withColumn("functional", ontology.is_functional(F.col("relation"))).groupBy("relation", "functional").agg(F.count("*").alias("n"))


_TYPED_ROWS = ", ".join(f"('{n}', {list(a)}, {list(b)})" for n, a, b, _ in ontology.TYPED)


@query(
    f"""WITH o(name, dom, ran) AS (VALUES {_TYPED_ROWS}), e AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'owns' WHEN 1 THEN 'part_of' WHEN 2 THEN 'located_in' ELSE 'uses' END AS relation,
    CASE user_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'project' ELSE 'unknown' END AS st,
    CASE event_id % 5 WHEN 0 THEN 'project' WHEN 1 THEN 'tool' ELSE 'date' END AS ot FROM events)
SELECT relation, st AS subject_type, ot AS object_type, coalesce((list_contains(dom, '*') OR list_contains(dom, st))
  AND (list_contains(ran, '*') OR list_contains(ran, ot)), false) AS valid, count(*) AS n
FROM e LEFT JOIN o ON relation = name GROUP BY ALL"""
)
def typed_validation(spark, d):
    pick = lambda c, *vs: F.element_at(F.array(*map(F.lit, vs)), (c + 1).cast("int"))
    rows = T.table(spark, d, "events").select(
        pick(F.col("event_id") % 4, "owns", "part_of", "located_in", "uses").alias("relation"),
        pick(F.col("user_id") % 3, "person", "project", "unknown").alias("subject_type"),
        pick(F.col("event_id") % 5, "project", "tool", "date", "date", "date").alias("object_type"),
    )
    return ontology.validate_typed(rows).groupBy("relation", "subject_type", "object_type", "valid").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'uses' WHEN 1 THEN 'related_to' ELSE 'owns' END AS relation,
    (turn % 7) / 5.0 AS confidence, trim(split_part(coalesce(text, ''), ' ', 1)) AS s FROM conversations),
bad AS (SELECT DISTINCT conv_id FROM r WHERE confidence > 1)
SELECT 'c' || conv_id || '-x' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS triple_id, s AS subject_text,
  relation, role AS object_text, confidence::DOUBLE AS confidence, 'c' || conv_id AS source_note_id
FROM r JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn)
WHERE conv_id NOT IN (SELECT conv_id FROM bad) QUALIFY length(s) > 0"""
)
def extraction_validate(spark, d):
    rel = F.element_at(F.array(F.lit("uses"), F.lit("related_to"), F.lit("owns")), (F.col("turn") % 3 + 1).cast("int"))
    one = F.struct(
        "turn",
        F.concat(F.lit(" "), F.substring_index(F.coalesce("text", F.lit("")), " ", 1), F.lit(" ")).alias("subject"),
        rel.alias("relation"),
        F.col("role").alias("object"),
        ((F.col("turn") % 7) / 5.0).alias("confidence"),
        F.lit("").alias("source_quote"),
    )
    rows = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("triples"))
    responses = rows.select(
        F.concat(F.lit("c"), "conv_id").alias("note_id"), F.to_json(F.struct("triples")).alias("response"), F.lit(None).cast("string").alias("error")
    )
    return extract.to_triples(extract.parse(responses)).drop("source_quote")


# Mentions, similarity, resolution.

_MENTIONS = f"""WITH f AS ({T.PART_MENTIONS}), m AS (
  SELECT mention, min(place) AS first_seen, count(*) AS n FROM (
    SELECT subject_text AS mention, 2 * seq AS place FROM f UNION ALL SELECT object_text, 2 * seq + 1 FROM f) GROUP BY 1)"""
# Jaro-Winkler in SQL halves odd transpositions down, which these names do not have.
_PAIRS = f"""{_MENTIONS}, names AS (SELECT * FROM m), p AS (
  SELECT a.mention AS a, b.mention AS b, a.first_seen AS sa, b.first_seen AS sb FROM names a JOIN names b
    ON substr(lower(a.mention), 1, 2) = substr(lower(b.mention), 1, 2) AND a.first_seen < b.first_seen),
tok AS (SELECT mention, list_filter(string_split_regex(regexp_replace(lower(mention), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
  lambda x: length(x) > 0 AND NOT list_contains({list(similarity.STOPWORDS)}, x)) AS t FROM names),
v AS (SELECT a, b, sa, sb, jaro_winkler_similarity(lower(a), lower(b)) AS jw, ta.t AS ta, tb.t AS tb,
    array_to_string(list_transform(ta.t, lambda x: x[1]), '') AS ca, array_to_string(list_transform(tb.t, lambda x: x[1]), '') AS cb
  FROM p JOIN tok ta ON ta.mention = a JOIN tok tb ON tb.mention = b),
verdict AS (SELECT a, b, sa, sb, jw, CASE WHEN jw > 0.9 THEN 'jaro-winkler'
    WHEN len(ta) > 0 AND len(tb) > 0 AND (list_has_all(tb, ta) OR list_has_all(ta, tb)) THEN 'token-subset'
    WHEN length(ca) >= 2 AND ca = cb THEN 'acronym' ELSE 'none' END AS method,
  CASE WHEN len(ta) > 0 AND len(tb) > 0 AND (list_has_all(tb, ta) OR list_has_all(ta, tb)) THEN
    least(0.85 + 0.1 * len(list_filter(ta, lambda x: list_contains(tb, x))) / greatest(len(list_distinct(ta)), len(list_distinct(tb))), 0.99) END AS subset
  FROM v), scored AS (SELECT *, CASE method WHEN 'jaro-winkler' THEN jw WHEN 'token-subset' THEN subset WHEN 'acronym' THEN 0.86 ELSE jw END AS score
  FROM verdict)"""


def _names(spark, d):
    return resolve.mentions(T.part_mentions(spark, d))


@query(f"{_MENTIONS} SELECT mention, first_seen, n FROM m")
def mention_counts(spark, d):
    return resolve.mentions(T.part_mentions(spark, d))


@query(f"{_PAIRS} SELECT a AS mention_a, b AS mention_b FROM p")
def blocking_pairs(spark, d):
    return resolve.blocking_pairs(_names(spark, d)).select("mention_a", "mention_b")


@query(f"{_PAIRS} SELECT a AS mention_a, b AS mention_b, round(subset, 9) AS score FROM verdict WHERE subset IS NOT NULL")
def token_subset_pairs(spark, d):
    pairs = resolve.blocking_pairs(_names(spark, d)).select("mention_a", "mention_b")
    score = similarity.token_subset(F.col("mention_a"), F.col("mention_b"))
    return pairs.withColumn("score", F.round(score, 9)).where("score IS NOT NULL")


@query(f"{_PAIRS} SELECT a AS mention_a, b AS mention_b FROM v WHERE length(ca) >= 2 AND ca = cb")
def acronym_pairs(spark, d):
    pairs = resolve.blocking_pairs(_names(spark, d)).select("mention_a", "mention_b")
    ac = similarity.acronym(F.col("mention_a"))
    return pairs.where((F.length(ac) >= 2) & (ac == similarity.acronym(F.col("mention_b"))))


# The score of a pair that is not the same is left out: DuckDB adds the common prefix only above a Jaro of 0.7.
@query(
    f"""{_PAIRS} SELECT a AS mention_a, b AS mention_b, method, method <> 'none' AS same,
  CASE WHEN method <> 'none' THEN round(score, 9) END AS score FROM scored"""
)
def similarity_verdicts(spark, d):
    pairs = resolve.verdicts(resolve.blocking_pairs(_names(spark, d)))
    return pairs.select("mention_a", "mention_b", "method", "same", F.when(F.col("same"), F.round("score", 9)).alias("score"))


_CLUSTERED = _PAIRS.replace("WITH f", "WITH RECURSIVE f", 1) + """, e AS (
  SELECT sa AS u, sb AS v FROM verdict WHERE method <> 'none' UNION ALL SELECT sb, sa FROM verdict WHERE method <> 'none'),
reach(u, v) AS (SELECT first_seen, first_seen FROM names UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
label AS (SELECT u AS first_seen, min(v) AS root FROM reach GROUP BY 1),
named AS (SELECT mention, first_seen, n, root FROM names JOIN label USING (first_seen)),
best AS (SELECT root, arg_max(mention, (n, length(mention), -first_seen)) AS canonical_name,
  string_agg(mention, '|' ORDER BY n DESC, first_seen) AS mentions, count(*) AS n_mentions FROM named GROUP BY 1)"""


def _resolved(spark, d):
    return resolve.resolve(T.part_mentions(spark, d))


@query(f"{_CLUSTERED} SELECT mention AS mention_text, canonical_name FROM named JOIN best USING (root)")
def resolve_components(spark, d):
    return _resolved(spark, d).canonical_map


@query(f"{_CLUSTERED} SELECT canonical_name, mentions, n_mentions FROM best")
def resolved_clusters(spark, d):
    rows = resolve.by_size(_resolved(spark, d).clusters)
    return rows.select("canonical_name", F.array_join("all_mentions", "|").alias("mentions"), "n_mentions")


@query(
    f"""{_CLUSTERED} SELECT canonical_name, a, b, method, round(score, 9) AS score
FROM scored JOIN label ON first_seen = sa JOIN best USING (root) WHERE method <> 'none'"""
)
def resolved_merges(spark, d):
    return _resolved(spark, d).merges.withColumn("score", F.round("score", 9))


@query(
    f"""{_CLUSTERED} SELECT (SELECT count(*) FROM m) AS mentions, count(*) AS canonical_entities, count(*) FILTER (n_mentions > 1) AS merged_clusters
FROM best"""
)
def resolution_counts(spark, d):
    return resolve.counts(_resolved(spark, d))


# Graph and projections.


@query(
    f"""WITH f AS ({T.EVENT_FACTS}), map AS (SELECT DISTINCT event_type AS m, upper(event_type) AS c FROM events)
SELECT seq, subject_text AS source, coalesce(c, object_text) AS target, replace(relation, '_', ' ') AS label, source_note_id
FROM f LEFT JOIN map ON m = object_text"""
)
def graph_edges(spark, d):
    facts = T.event_facts(spark, d)
    names = facts.select(F.col("object_text").alias("mention_text"), F.upper("object_text").alias("canonical_name")).distinct()
    edges = graphs.build_edges(facts, names)
    return edges.select("seq", "source", "target", text.relation_label(F.col("relation")).alias("label"), "source_note_id")


@query(
    f"""WITH f AS ({T.SUPPLY_FACTS}), e AS ({_ENDS})
SELECT id, count(*) AS degree, min(place) AS first_seen, 1::BIGINT AS mention_count FROM e GROUP BY 1"""
)
def graph_nodes(spark, d):
    return graphs.build_nodes(_supply(spark, d))


@query(
    f"""{_CLUSTERED} SELECT canonical_name AS id, n_mentions AS mention_count, sum(n)::BIGINT AS degree FROM best JOIN named USING (root)
GROUP BY ALL"""
)
def resolved_nodes(spark, d):
    facts = T.part_mentions(spark, d)
    graph = graphs.build_graph(facts, resolve.resolve(facts).canonical_map)
    return graph.nodes.select("id", "mention_count", "degree")


@query(f"WITH f AS ({T.GEO_FACTS}), e AS ({_ENDS}) SELECT id, count(*) AS degree FROM e GROUP BY 1")
def node_degree(spark, d):
    return graphs.degrees(graphs.build_edges(T.geo_facts(spark, d))).select("id", "degree")


@query(f"WITH f AS ({T.SUPPLY_FACTS}) SELECT DISTINCT subject_text AS source, object_text AS target FROM ({_PLAIN})")
def simple_links(spark, d):
    return graphs.simple_links(_supply(spark, d))


@query(
    f"""WITH f AS ({T.SUPPLY_FACTS}) SELECT u, v, count(*) AS weight, min(seq) AS first_seen FROM (
  SELECT seq, subject_text AS u, object_text AS v FROM ({_PLAIN}) UNION ALL SELECT seq, object_text, subject_text FROM ({_PLAIN})) GROUP BY 1, 2"""
)
def weighted_adjacency(spark, d):
    return graphs.weighted_adjacency(_supply(spark, d))


@query(f"WITH f AS ({T.SUPPLY_FACTS}), near AS ({_NEAR}) SELECT u, v FROM near")
def neighbor_sets(spark, d):
    return graphs.neighbours(_supply(spark, d))


@query(
    f"""WITH f AS ({T.SUPPLY_FACTS}), near AS ({_NEAR}), seen AS (SELECT id, min(place) AS s FROM ({_ENDS}) GROUP BY 1)
SELECT CASE WHEN x.s < y.s THEN a.v ELSE b.v END AS a, CASE WHEN x.s < y.s THEN b.v ELSE a.v END AS b, count(*) AS score
FROM near a JOIN near b ON a.u = b.u AND a.v < b.v JOIN seen x ON x.id = a.v JOIN seen y ON y.id = b.v
WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.u = a.v AND n.v = b.v) GROUP BY ALL HAVING count(*) >= 2"""
)
def candidate_links(spark, d):
    return links.predict_links(_supply(spark, d), top=None)


@query(
    f"""WITH f AS ({T.SUPPLY_FACTS}), near AS ({_NEAR}), seen AS (SELECT id, min(place) AS s FROM ({_ENDS}) GROUP BY 1),
w AS (SELECT x.s AS xs, y.s AS ys, a.v AS a, b.v AS b, count(*) AS score, string_agg(a.u, '|' ORDER BY a.u) AS common
  FROM near a JOIN near b ON a.u = b.u JOIN seen x ON x.id = a.v JOIN seen y ON y.id = b.v AND x.s < y.s
  WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.u = a.v AND n.v = b.v) GROUP BY ALL HAVING count(*) >= 2)
SELECT row_number() OVER (ORDER BY score DESC, xs, ys) AS rank, a, b, score, common FROM w ORDER BY rank LIMIT 10"""
)
def predicted_links(spark, d):
    best = links.predict_links(_supply(spark, d))
    return best.withColumn("common", F.array_join("common_neighbors", "|")).drop("common_neighbors")


# PageRank by recursion: a round is a join and window sums over the whole frontier.
_RANK_ROUNDS = 100
_PAGERANK = f"""WITH RECURSIVE f AS ({T.SUPPLY_FACTS}), nodes AS (SELECT id, min(place) AS s FROM ({_ENDS}) GROUP BY 1),
links AS (SELECT DISTINCT subject_text AS src, object_text AS dst FROM ({_PLAIN})),
deg AS (SELECT src, count(*) AS out FROM links GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes),
hops AS (SELECT src, dst, 1.0 / out AS share FROM links JOIN deg USING (src)
  UNION ALL SELECT id, id, 0.0 FROM nodes),
r(round, id, rank) AS (SELECT 0, id, 1.0::DOUBLE / n FROM nodes, n
  UNION ALL SELECT round + 1, dst, 0.15 / n + 0.85 * (got + lost / n) FROM (
    SELECT round, dst, sum(rank * share) AS got, any_value(lost) AS lost FROM (
      SELECT r.round, h.dst, r.rank, h.share,
        sum(CASE WHEN h.src = h.dst AND h.share = 0.0 AND d.src IS NULL THEN r.rank ELSE 0 END) OVER () AS lost
      FROM r JOIN hops h ON h.src = r.id LEFT JOIN deg d ON d.src = r.id WHERE r.round < {_RANK_ROUNDS}) GROUP BY 1, 2), n)
"""


@query(
    f"""{_PAGERANK} SELECT row_number() OVER (ORDER BY round(rank, 12) DESC, s, id) AS rank, id AS entity, round(rank, 9) AS score
FROM r JOIN nodes USING (id) WHERE round = {_RANK_ROUNDS} ORDER BY 1 LIMIT 10"""
)
def pagerank_top(spark, d):
    edges = cut(_supply(spark, d))
    graph = graphs.Graph(graphs.build_nodes(edges), edges)
    return pagerank.central_entities(graph, rounds=_RANK_ROUNDS).withColumn("score", F.round("score", 9))


@query()
def louvain_clusters(spark, d):
    """Depends on the order of visits, which SQL cannot follow; golden and differential tests hold it."""
    edges = cut(graphs.build_edges(T.geo_facts(spark, d)))
    return louvain.concept_clusters(graphs.Graph(graphs.build_nodes(edges), edges))


# Views.

_ENTITY = "supplier-7"


@query(f"WITH f AS ({T.SUPPLY_FACTS}) SELECT seq, relation, object_text AS target FROM f WHERE subject_text = '{_ENTITY}'")
def entity_outgoing(spark, d):
    return views.outgoing(_supply(spark, d), _ENTITY).select("seq", "relation", "target")


@query(f"WITH f AS ({T.SUPPLY_FACTS}) SELECT seq, relation, subject_text AS source FROM f WHERE object_text = 'part-7'")
def entity_incoming(spark, d):
    return views.incoming(_supply(spark, d), "part-7").select("seq", "relation", "source")


@query(
    f"""WITH f AS ({T.EVENT_FACTS}), n AS ({T.DOCUMENT_NOTES}), t AS (
  SELECT 'out' AS side, object_text AS other, * FROM f WHERE subject_text = 'user-7'
  UNION ALL SELECT 'in', subject_text, * FROM f WHERE object_text = 'user-7')
SELECT side, other, 'related to' AS label, strftime(extracted_at, '%b %-d') AS day, coalesce(title, 'doc-' || source_note_id) AS title
FROM t LEFT JOIN n ON note_id = 'doc-' || source_note_id"""
)
def entity_inspector(spark, d):
    facts = T.event_facts(spark, d).withColumn("source_note_id", F.concat(F.lit("doc-"), "source_note_id"))
    return views.inspector(graphs.build_edges(facts), T.document_notes(spark, d), "user-7")


@query(
    f"""WITH f AS ({T.SUPPLY_FACTS}) SELECT DISTINCT id FROM (SELECT object_text AS id FROM f WHERE subject_text = '{_ENTITY}'
  UNION ALL SELECT subject_text FROM f WHERE object_text = '{_ENTITY}' UNION ALL SELECT '{_ENTITY}')"""
)
def neighborhood(spark, d):
    return views.neighbourhood(_supply(spark, d), _ENTITY)


@query(
    f"""WITH f AS ({T.SUPPLY_FACTS}), near AS (SELECT DISTINCT id FROM (SELECT object_text AS id FROM f WHERE subject_text = '{_ENTITY}'
  UNION ALL SELECT subject_text FROM f WHERE object_text = '{_ENTITY}' UNION ALL SELECT '{_ENTITY}'))
SELECT id, id IN (SELECT id FROM near) AS active FROM (SELECT DISTINCT id FROM ({_ENDS}))"""
)
def active_nodes(spark, d):
    edges = _supply(spark, d)
    return views.active(graphs.build_nodes(edges).select("id"), "id", views.neighbourhood(edges, _ENTITY))


@query(
    f"""WITH f AS ({T.EVENT_FACTS}) SELECT arg_min(subject_text, seq) AS source, arg_min(object_text, seq) AS target,
  arg_min(relation, seq) AS relation FROM f GROUP BY least(subject_text, object_text), greatest(subject_text, object_text)"""
)
def layout_links(spark, d):
    return views.layout_links(graphs.build_edges(T.event_facts(spark, d)))


@query(
    f"""WITH f AS ({T.GEO_FACTS}), e AS (SELECT id, count(*) AS n FROM ({_ENDS}) GROUP BY 1),
top AS (SELECT id, n::DOUBLE AS score FROM e ORDER BY n DESC, id LIMIT 10), m AS (SELECT max(score) AS m FROM top)
SELECT id, CASE WHEN length(id) > 22 THEN substr(id, 1, 21) || '…' ELSE id END AS label,
  (length(id) % 11)::BIGINT AS cluster_id, 7.0 + 16.0 * coalesce(score, 0.0) / m AS radius, (length(id) % 11 % 8)::BIGINT AS colour
FROM e LEFT JOIN top USING (id), m"""
)
def node_view(spark, d):
    edges = graphs.build_edges(T.geo_facts(spark, d))
    nodes = graphs.build_nodes(edges)
    clusters = nodes.select(F.col("id").alias("member"), (F.length("id") % 11).cast("long").alias("cluster_id"))
    top = nodes.orderBy(F.desc("degree"), "id").limit(10).select(F.col("id").alias("entity"), F.col("degree").cast("double").alias("score"))
    return views.node_view(graphs.Graph(nodes, edges), clusters, top)


@query(
    f"""WITH f AS ({T.GEO_FACTS}), e AS (SELECT id, count(*) AS n FROM ({_ENDS}) GROUP BY 1)
SELECT id AS entity, n::DOUBLE AS score, n::DOUBLE / (SELECT max(n)::DOUBLE FROM e) * 100 AS width FROM e"""
)
def leaderboard_width(spark, d):
    nodes = graphs.degrees(graphs.build_edges(T.geo_facts(spark, d)))
    return views.leaderboard(nodes.select(F.col("id").alias("entity"), F.col("degree").cast("double").alias("score")))


@query()
def run_stats(spark, d):
    """The whole run over the part names."""
    facts = T.part_mentions(spark, d)
    result = run_pipeline(T.document_notes(spark, d), facts)
    return spark.createDataFrame(list(result.stats().items()), "stat string, n long")
