"""Nearest neighbours by inner product with an inverted multi-index.

A vector is cut into halves, each quantised with its own CELLS centroids, so a pair of centroids is one of CELLS**2
cells. A query visits pairs in the order of its summed half products, which a heap over the two sorted lists yields
one after another, until the cells visited hold FRACTION of all distinct vectors; their entries are reranked by the
exact product.

Centroids are fitted on a bounded sample; every vector is indexed. Rows and queries are dealt into blocks and each pair
of blocks is one task of bounded size, whose best k for each query go on; cells only choose among a block's rows, so a
cell that holds most vectors is no task of its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, ship

#: Centroids for each half.
CELLS = 64
#: Vectors on which the centroids are fitted, and rounds of k-means.
SAMPLE, ROUNDS = 8192, 12
#: Share of the distinct vectors that a query's cells hold at least.
FRACTION = 0.45
ROW_BLOCK, QUERY_BLOCK = 16_384, 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of x; the start is k spread rows, so the result depends on x alone."""
    x = x[np.lexsort(x.T[::-1])]
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        for j in range(len(centers)):
            own = x[near == j]
            if len(own):
                centers[j] = own.mean(axis=0)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * x @ centers.T, axis=1)


def visit(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells (i * CELLS + j) by descending first[i] + second[j] until they hold `enough`."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    n, m, width = len(a), len(b), len(b)
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    out, got = [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        out.append(cell)
        got += int(held[cell])
        # (i, j) leads to (i, j + 1), and from the first of a row also to the next row: each pair is met once.
        if j + 1 < m:
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < n:
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    cells: int = CELLS,
    fraction: float = FRACTION,
    sample: int = SAMPLE,
) -> DataFrame:
    """The k nearest of `vectors` found for each of `queries`, both (vec_id, embedding): query_id, rank, vec_id, score.

    A query's own id is no candidate. Null ids, and vectors that are null, empty, zero, hold null or non-finite
    components or have not the commonest length, take no part. Ties go to the smaller id. A repeated row is a candidate
    each time; a repeated query id is one query (its least vector). Without vectors or queries there are no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        ok = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
        return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)

    rows = valid(vectors)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, half, total = common["d"], common["d"] // 2, common["count"]
    rows = rows.where(F.size("embedding") == dim)
    asked = valid(queries).where(F.size("embedding") == dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).select("embedding").collect()
    drawn = np.array([r[0] for r in drawn], np.float64)
    books = [kmeans(drawn[:, :half], cells), kmeans(drawn[:, half:], cells)] if half else [np.zeros((1, 0)), kmeans(drawn, cells)]
    width = len(books[1])
    n_cells = len(books[0]) * width

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                cell = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "embedding", "cell"])

    indexed = materialize(rows.mapInArrow(index, "vec_id long, embedding array<double>, cell int"))
    held = np.zeros(n_cells, np.int64)
    for r in indexed.groupBy("cell", F.xxhash64("embedding")).agg(F.lit(1)).groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]  # a row a cell
    enough = max(4 * k, int(np.ceil(fraction * held.sum())))  # 4 * k: few vectors still give k neighbours

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                first, second = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
                bits = np.zeros((len(x), n_cells), bool)
                for i in range(len(x)):
                    bits[i, visit(first[i], second[i], held, enough)] = True
                packed = [b.tobytes() for b in np.packbits(bits, axis=1)]
                yield pa.record_batch([*batch.columns, pa.array(packed, pa.binary())], ["query_id", "query", "cells"])

    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    routed = materialize(asked.mapInArrow(route, "query_id long, query array<double>, cells binary"))
    # Small inputs still give every core a block of rows.
    row_blocks = max(-(-total // ROW_BLOCK), min(-(-total // 512), spark.sparkContext.defaultParallelism))
    query_blocks = max(1, -(-routed.count() // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.xxhash64("vec_id", F.monotonically_increasing_id())
    left = indexed.withColumn("rb", F.pmod(own, F.lit(row_blocks)).cast("int")).withColumn("qb", each(query_blocks))
    right = routed.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    right = right.withColumn("rb", each(row_blocks))

    def rerank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and asked.num_rows:
            ids = rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")  # so that ties fall to the smaller id
            ids, cell = ids[order], rows.column("cell").to_numpy()[order]
            x = _matrix(rows.column("embedding").combine_chunks(), dim)[order]
            q = _matrix(asked.column("query").combine_chunks(), dim)
            for i, (qid, bits) in enumerate(zip(asked.column("query_id").to_pylist(), asked.column("cells").to_pylist(), strict=True)):
                may = np.unpackbits(np.frombuffer(bits, np.uint8), count=n_cells).astype(bool)
                at = np.flatnonzero(may[cell] & (ids != qid))
                score = (x[at] * q[i]).sum(axis=1)  # each row summed alike, so equal vectors tie exactly
                if len(at) > k:
                    edge = np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[score >= edge], score[score >= edge]
                best = np.argsort(-score, kind="stable")[:k]
                out[0] += [qid] * len(best)
                out[1] += ids[at[best]].tolist()
                out[2] += score[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    pairs = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb"))
    found = pairs.applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op6_multi_index": op6_multi_index}
SQL: dict[str, str] = {}
