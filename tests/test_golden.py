"""The seed vault end to end: values traced by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from weft.operators import contradictions as conflicts
from weft.operators import louvain, resolve, views
from weft.plans.pipeline import run_pipeline
from weft.sources.vault import seed_notes, seed_triples


@pytest.fixture(scope="module")
def result(spark):
    return run_pipeline(seed_notes(spark), seed_triples(spark))


def test_clusters(result):
    rows = [(r.canonical_name, r.all_mentions) for r in resolve.by_size(result.resolution.clusters).collect()]
    assert rows[:4] == [
        ("Raj Patel", ["Raj Patel", "Raj", "Raj P."]),
        ("Sarah", ["Sarah", "Sarah K.", "Sarah Khan"]),
        ("Mei Lin", ["Mei Lin", "Mei"]),
        ("PromptlyBI", ["PromptlyBI", "Promptly BI"]),
    ]
    assert [r[0] for r in rows[4:]] == [
        "April 2", "Berlin", "London", "March 15", "Postgres", "Redis", "the auth migration", "the BI project",
        "the billing service", "the dashboard redesign", "the SSO rollout", "Tom",
    ]
    assert result.resolution.mentions.count() == 22


def test_merges(result):
    got = {(r.a, r.b): (r.method, round(r.score, 4)) for r in result.resolution.merges.collect()}
    assert got == {
        ("Sarah", "Sarah K."): ("jaro-winkler", 0.925),
        ("Sarah", "Sarah Khan"): ("token-subset", 0.9),
        ("Sarah K.", "Sarah Khan"): ("jaro-winkler", 0.915),
        ("Raj Patel", "Raj"): ("token-subset", 0.9),
        ("Raj Patel", "Raj P."): ("acronym", 0.86),
        ("Raj", "Raj P."): ("token-subset", 0.9),
        ("PromptlyBI", "Promptly BI"): ("jaro-winkler", 0.9818),
        ("Mei Lin", "Mei"): ("token-subset", 0.9),
    }


def test_graph(result):
    degree = {r.id: r.degree for r in result.graph.nodes.collect()}
    assert len(degree) == 16 and sum(degree.values()) == 52 and result.graph.edges.count() == 26
    assert degree["the auth migration"] == 7 and degree["the SSO rollout"] == degree["Raj Patel"] == 6
    counts = {r.id: r.mention_count for r in result.graph.nodes.collect()}
    assert counts["Raj Patel"] == 3 and counts["Tom"] == 1


def test_pagerank(result):
    rows = [(r.entity, round(r.score, 6)) for r in result.central.orderBy("rank").collect()]
    assert rows == [
        ("Postgres", 0.113938), ("Redis", 0.112175), ("the auth migration", 0.0852), ("PromptlyBI", 0.081679),
        ("the billing service", 0.067371), ("London", 0.062689), ("March 15", 0.060557), ("April 2", 0.060557),
        ("the BI project", 0.055183), ("the SSO rollout", 0.051662),
    ]


def test_louvain(result):
    rows = [r.members for r in louvain.members(result.clusters).collect()]
    assert rows == [
        ["April 2", "March 15", "Sarah", "the SSO rollout", "the auth migration"],
        ["London", "Mei Lin", "the BI project"],
        ["Postgres", "PromptlyBI", "the dashboard redesign"],
        ["Redis", "Tom", "the billing service"],
        ["Berlin", "Raj Patel"],
    ]


def test_contradictions(result):
    rows = conflicts.in_order(result.contradictions).collect()
    assert [(r.entity, r.relation, [v["value"] for v in r["values"]]) for r in rows] == [
        ("the auth migration", "scheduled_for", ["March 15", "April 2"]),
        ("Sarah", "reports_to", ["Mei Lin", "Raj Patel"]),
        ("Raj Patel", "located_in", ["Berlin", "London"]),
    ]


def test_links(result):
    rows = [(r.a, r.b, r.score, r.common_neighbors) for r in result.predicted.orderBy("rank").collect()]
    assert rows == [
        ("Sarah", "London", 2, ["Mei Lin", "Raj Patel"]),
        ("the auth migration", "Redis", 2, ["the SSO rollout", "the billing service"]),
        ("the auth migration", "Raj Patel", 2, ["Sarah", "the SSO rollout"]),
        ("the auth migration", "PromptlyBI", 2, ["Postgres", "the billing service"]),
        ("Mei Lin", "Raj Patel", 2, ["London", "Sarah"]),
        ("Postgres", "Raj Patel", 2, ["PromptlyBI", "the dashboard redesign"]),
        ("Postgres", "the billing service", 2, ["PromptlyBI", "the auth migration"]),
        ("the SSO rollout", "PromptlyBI", 2, ["Raj Patel", "Redis"]),
        ("the SSO rollout", "the billing service", 2, ["Redis", "the auth migration"]),
        ("Redis", "Raj Patel", 2, ["PromptlyBI", "the SSO rollout"]),
    ]


def test_stats_and_views(result, spark):
    assert result.stats() == {"notes": 8, "triples": 26, "entities": 16, "edges": 26, "contradictions": 3, "predicted": 10}
    per_note = {r.note_id: r.n_triples for r in views.triples_per_note(result.notes, result.triples).collect()}
    assert per_note == {"n1": 4, "n2": 3, "n3": 3, "n4": 2, "n5": 4, "n6": 4, "n7": 3, "n8": 3}
    assert views.cluster_of(result.resolution.clusters, "Tom").isEmpty()
    near = views.neighbourhood(result.graph.edges, "Tom")
    assert {r.id for r in near.collect()} == {"Tom", "the billing service"}
    assert views.active(result.graph.nodes, "id", near).where("active").count() == 2
    assert views.active(result.graph.nodes, "id", None).where("active").count() == 16
    view = views.node_view(result.graph, result.clusters, result.central).where(F.col("id") == "Postgres").first()
    assert view.radius == 23.0 and view.cluster_id == 2
    widths = [r.width for r in views.leaderboard(result.central).orderBy("rank").collect()]
    assert widths[0] == 100.0
