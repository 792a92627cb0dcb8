"""Entity resolution: mentions -> blocks -> verdicts -> clusters with a canonical name and the reason of each merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import block_key
from ..sources.shared import cut
from .components import components


@dataclass
class Resolution:
    mentions: DataFrame  #: mention, first_seen, n
    merges: DataFrame  #: canonical_name, a, b, method, score
    canonical_map: DataFrame  #: mention_text, canonical_name
    clusters: DataFrame  #: canonical_name, all_mentions (by count, then first seen), n_mentions


def mentions(triples: DataFrame) -> DataFrame:
    """Distinct subjects and objects with their first place (2 * seq + side) and count; x in both places counts twice."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("subject_text").alias("m")), F.struct(F.lit(1).alias("side"), F.col("object_text").alias("m"))))
    rows = triples.select("seq", sides.alias("s"))
    return rows.groupBy(F.col("s.m").alias("mention")).agg(
        F.min(F.col("seq") * 2 + F.col("s.side")).alias("first_seen"), F.count("*").alias("n")
    )


def blocking_pairs(found: DataFrame) -> DataFrame:
    """Pairs of mentions of one block, the first seen before: mention_a, mention_b, seen_a, seen_b."""
    keyed = found.select("mention", "first_seen", block_key(F.col("mention")).alias("block"))
    left, right = (keyed.select("block", F.col("mention").alias(f"mention_{x}"), F.col("first_seen").alias(f"seen_{x}")) for x in "ab")
    return left.join(right, "block").where("seen_a < seen_b")


def verdicts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("v", similarity.verdict(F.col("mention_a"), F.col("mention_b"))).select("*", "v.*").drop("v")


def same_pairs(pairs: DataFrame) -> DataFrame:
    """Only the pairs that are the same. Jaro-Winkler is left out where lengths already rule it out."""
    a, b = F.col("mention_a"), F.col("mention_b")
    ac = similarity.acronym(a)
    cheap = similarity.token_subset(a, b).isNotNull() | ((F.length(ac) >= 2) & (ac == similarity.acronym(b)))
    return verdicts(pairs.where(similarity.jw_possible(a, b) | cheap)).where("same")


def resolve(triples: DataFrame) -> Resolution:
    found = cut(mentions(triples))
    links = cut(same_pairs(blocking_pairs(found)))
    labels = components(links.select(F.col("seen_a").alias("u"), F.col("seen_b").alias("v")))
    named = found.join(labels.withColumnRenamed("node", "first_seen"), "first_seen", "left")
    named = named.withColumn("root", F.coalesce("label", "first_seen")).drop("label")
    order = F.struct(-F.col("n"), F.col("first_seen"), F.col("mention"))
    clusters = named.groupBy("root").agg(
        F.max_by("mention", F.struct(F.col("n"), F.length("mention"), -F.col("first_seen"))).alias("canonical_name"),
        F.transform(F.array_sort(F.collect_list(order)), lambda s: s["mention"]).alias("all_mentions"),
    )
    clusters = cut(clusters.withColumn("n_mentions", F.size("all_mentions").cast("long")))
    names = clusters.select("root", "canonical_name")
    mapped = named.join(names, "root").select(F.col("mention").alias("mention_text"), "canonical_name", "first_seen")
    by_seen = mapped.select(F.col("first_seen").alias("seen_a"), "canonical_name")
    merges = links.join(by_seen, "seen_a").select(
        "canonical_name", F.col("mention_a").alias("a"), F.col("mention_b").alias("b"), "method", "score"
    )
    return Resolution(found, merges, mapped.select("mention_text", "canonical_name"), clusters.drop("root"))


def counts(found: Resolution) -> DataFrame:
    """mentions, canonical_entities, merged_clusters (of more than one mention)."""
    merged = F.count_if(F.col("n_mentions") > 1).alias("merged_clusters")
    one = found.clusters.agg(F.count("*").alias("canonical_entities"), merged)
    return found.canonical_map.agg(F.count("*").alias("mentions")).crossJoin(one)  # rows of one


def by_size(clusters: DataFrame) -> DataFrame:
    """Merged clusters first, then by name as people sort names."""
    return clusters.orderBy(F.desc("n_mentions"), F.collate("canonical_name", "UNICODE"))
