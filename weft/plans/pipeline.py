"""The whole run: resolve, build the graph, analyse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import contradictions as conflicts
from ..operators import graph as graphs
from ..operators import links, louvain, pagerank, resolve
from ..sources.shared import cut


@dataclass
class PipelineResult:
    notes: DataFrame
    triples: DataFrame
    resolution: resolve.Resolution
    graph: graphs.Graph
    central: DataFrame
    clusters: DataFrame
    contradictions: DataFrame
    predicted: DataFrame

    def stats(self) -> dict[str, int]:
        return {
            "notes": self.notes.count(),
            "triples": self.triples.count(),
            "entities": self.graph.nodes.count(),
            "edges": self.graph.edges.count(),
            "contradictions": self.contradictions.count(),
            "predicted": self.predicted.count(),
        }


def run_pipeline(notes: DataFrame, triples: DataFrame, top: int = 10) -> PipelineResult:
    """Always the full run; edges and nodes are written once and read by the four analyses."""
    found = resolve.resolve(triples)
    built = graphs.build_graph(triples, found.canonical_map)
    edges = cut(built.edges)
    graph = graphs.Graph(cut(graphs.build_nodes(edges, found.canonical_map)), edges)
    return PipelineResult(
        notes,
        triples,
        found,
        graph,
        pagerank.central_entities(graph, top),
        louvain.concept_clusters(graph),
        conflicts.contradictions(edges),
        links.predict_links(edges, top),
    )
