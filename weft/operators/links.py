"""Likely links: pairs that are not linked and share neighbours.

Nodes are numbered by where they were first seen, and dealt into classes by their number. Each two classes are a square
of pairs, and a square is a task: it reads the neighbours of its two classes from the shared folder, counts shared
neighbours row by row, and gives only pairs that are results. So no wedge (a pair with one neighbour that both have)
leaves a task or reaches a disk; what is written is the links, once, as numbers.

Nodes of very many neighbours (hubs) are not expanded into pairs: pairs that share another neighbour look up which
hubs both have, and nodes with so many hubs that these suffice add up their hubs' neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, release, ship
from .graph import neighbour_order

#: Neighbours above which a node is a hub.
HUB = 4096
#: Neighbours of all nodes of a class, about; links of a class below which fewer classes suffice.
CLASS, LITTLE = 2_500_000, 20_000
#: Wedges that are counted at once, and bytes of the table of hubs and nodes of a class.
WEDGES, HUB_BYTES = 1_000_000, 64 << 20
#: Rows of a batch of results.
BATCH = 1 << 16


def _numbered(edges: DataFrame) -> DataFrame:
    """id, h, n: nodes, a hash that no two share, and their place by where they were first seen."""
    seen, seed = cut(neighbour_order(edges)), 0
    while True:
        h = F.xxhash64("id", F.lit(seed))
        if seen.groupBy(h).count().where("count > 1").isEmpty():
            break
        seed += 1
    ordered = seen.repartitionByRange("first_seen").sortWithinPartitions("first_seen", "id")
    ordered = cut(ordered.select("id", h.alias("h"), F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    sizes = {r["p"]: r["c"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}  # one a partition
    at, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    starts = F.broadcast(edges.sparkSession.createDataFrame(starts, "p long, start long"))
    n = (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
    out = ordered.join(starts, part == F.col("p")).select("id", "h", n.alias("n"))
    out._weft_seed, out._weft_size = seed, at
    return out


def _near(edges: DataFrame, names: DataFrame) -> DataFrame:
    """u, v: numbers of neighbours, in both directions, once each."""
    x, y = (F.xxhash64(c, F.lit(names._weft_seed)) for c in ("source", "target"))
    links = edges.where("source <> target").select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    of = lambda h, n: names.select(F.col("h").alias(h), F.col("n").alias(n))
    links = links.distinct().join(of("x", "u"), "x").join(of("y", "v"), "y").select("u", "v")
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return links.select(both.alias("e")).select("e.u", "e.v")


def _read(folder: str, k: int, columns: list[str]) -> pa.Table:
    """Rows of a class, in the order of the first column."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(f"{folder}/k={k}")
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    parts = [pq.read_table(f.path, filesystem=files, columns=columns, partitioning=None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
    if not parts:
        return pa.table({c: pa.array([], pa.string() if c == "id" else pa.int32()) for c in columns})
    out = pa.concat_tables(parts)
    first = out.column(0).to_numpy()
    return out if (first[1:] >= first[:-1]).all() else out.sort_by([(c, "ascending") for c in columns if c != "id"])


def _numbers(folder: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """u and v of a class, in numpy's memory."""
    found = _read(folder, k, ["u", "v"])
    out = tuple(np.array(c.to_numpy()) for c in found.columns)
    del found
    pa.default_memory_pool().release_unused()
    return out


class _Square:
    """Pairs of a node of class i and one of class j, out of `classes` classes of n nodes. wedges: counted at once."""

    def __init__(self, near: str, i: int, j: int, classes: int, n: int, hubs: np.ndarray, least: int, wedges: int):
        self.i, self.j, self.classes, self.least, self.wedges = i, j, classes, least, wedges
        u, self.v = _numbers(near, i)
        w, x = (u.copy(), self.v) if i == j else _numbers(near, j)
        self.width = (n - j + classes - 1) // classes
        # Of each node, its neighbours of class j.
        w //= np.int32(classes)
        self.lists = w[np.argsort(x, kind="stable")]
        self.start = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(x, minlength=n), out=self.start[1:])
        del w, x
        hubs = hubs[: HUB_BYTES // max(1, self.width)]
        self.hub = np.full(n, len(hubs), np.int32)  # the last one is none
        self.hub[hubs] = np.arange(len(hubs))
        self.has = np.zeros((len(hubs) + 1, self.width), np.uint8)
        for k, h in enumerate(hubs.tolist()):
            self.has[k, self.lists[self.start[h] : self.start[h + 1]]] = 1
        self.row_at = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        self.rows = u[self.row_at]
        self.row_at = np.append(self.row_at, len(u))
        of = self.hub[self.v]
        light = of == len(hubs)
        self.degree = np.diff(self.start).astype(np.int32)[self.v]
        self.degree[~light] = 0
        self.upto = np.zeros(len(u) + 1, np.int64)
        np.cumsum(self.degree, out=self.upto[1:])
        hubs_upto = np.zeros(len(u) + 1, np.int32)
        np.cumsum(~light, out=hubs_upto[1:])
        self.n_hubs = np.diff(hubs_upto[self.row_at])
        self.hubs_of, self.hubs_at = of[~light], hubs_upto[self.row_at]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number, number, shared neighbours), the lesser number first."""
        wedges = self.upto[self.row_at]
        big = (self.n_hubs >= self.least) | (np.diff(wedges) > self.wedges)
        most = max(1, ((1 << 31) - 1) // max(1, self.width))  # rows whose pairs have 32-bit keys
        r = 0
        while r < len(self.rows):
            if big[r]:
                a, b, score = self._row(r)
                to = r + 1
            else:
                to = min(max(r + 1, int(np.searchsorted(wedges, wedges[r] + self.wedges, side="right")) - 1), r + most)
                if (stop := np.flatnonzero(big[r:to])).size:
                    to = r + int(stop[0])
                a, b, score = self._rows(r, to)
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b), score
            r = to

    def _expand(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of class j that the neighbours x to y lead to, and how many each."""
        d = self.degree[x:y].astype(np.int64)
        base = self.start[self.v[x:y]] - (np.cumsum(d) - d)
        return self.lists[np.repeat(base, d) + np.arange(int(d.sum()))], d

    def _rows(self, r: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = self.row_at[r], self.row_at[to]
        row = np.repeat(np.arange(to - r, dtype=np.int32), np.diff(self.row_at[r : to + 1]))
        b, d = self._expand(x, y)
        key = np.repeat(row * np.int32(self.width), d) + b
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        score = np.diff(np.append(first, len(key)))
        key = key[first]
        some = int(self.n_hubs[r:to].max(initial=0))
        if some < self.least:  # hubs can add no more
            enough = score >= self.least - some
            key, score = key[enough], score[enough]
        at = key // np.int32(self.width)
        b = key - at * np.int32(self.width)
        for k in range(some):
            hub = np.full(to - r, len(self.has) - 1, np.int32)
            more = np.flatnonzero(self.n_hubs[r:to] > k)
            hub[more] = self.hubs_of[self.hubs_at[r:to][more] + k]
            score = score + self.has[hub[at], b]
        keep = score >= self.least
        linked = self.v[x:y] % self.classes == self.j
        linked = row[linked] * np.int32(self.width) + self.v[x:y][linked] // self.classes
        if len(key) and len(linked):
            place = np.minimum(np.searchsorted(key, linked), len(key) - 1)
            keep[place[key[place] == linked]] = False
        if self.i == self.j:
            keep &= b > (self.rows[r:to] // self.classes)[at]
        return self.rows[r:to][at[keep]], b[keep] * self.classes + self.j, score[keep]

    def _row(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one row, by a count for each node of class j."""
        score = np.zeros(self.width, np.int64)
        x, y = self.row_at[r], self.row_at[r + 1]
        while x < y:
            to = min(y, max(x + 1, int(np.searchsorted(self.upto, self.upto[x] + self.wedges, side="right")) - 1))
            score += np.bincount(self._expand(x, to)[0], minlength=self.width)
            x = to
        for hub in self.hubs_of[self.hubs_at[r] : self.hubs_at[r + 1]].tolist():
            score += self.has[hub]
        v = self.v[self.row_at[r] : y]
        score[v[v % self.classes == self.j] // self.classes] = 0
        if self.i == self.j:
            score[: self.rows[r] // self.classes + 1] = 0
        b = np.flatnonzero(score >= self.least)
        return np.full(len(b), self.rows[r]), b * self.classes + self.j, score[b]


def _best(squares: Iterator, top: int) -> list[np.ndarray]:
    """Of all pairs the `top` ones by score, then numbers."""
    best = [np.zeros(0, np.int64)] * 3
    for pairs in squares:
        if len(best[2]) == top and top:
            hope = pairs[2] >= best[2][-1]
            pairs = [c[hope] for c in pairs]
        both = [np.concatenate([x, y]) for x, y in zip(best, pairs, strict=True)]
        order = np.lexsort((both[1], both[0], -both[2]))[:top]
        best = [c[order] for c in both]
    return best


def predict_links(edges: DataFrame, top: int | None = 10, least: int = 2) -> DataFrame:
    """rank, a, b, score (shared neighbours), common_neighbors (joined by '|'); a was seen before b. With top None all
    pairs: a, b, score. Shared neighbours of all pairs are counted; their names are gathered only for the `top` ones."""
    spark = edges.sparkSession
    ship(spark)
    names = _numbered(edges)
    n, both = names._weft_size, cut(_near(edges, names))
    total = both.count()
    classes = max(min(8, 1 + total // LITTLE), -(-total // CLASS))
    of = lambda c: (F.col(c) % classes).alias("k")
    near = cut(both.select("u", "v", of("u")).repartition(classes, "k").sortWithinPartitions("k", "u", "v"), "k")
    release(both)
    hubs = near.groupBy("u").count().where(F.col("count") > HUB).orderBy(F.desc("count"), "u").limit(HUB_BYTES // 1024)
    hubs = np.array([r["u"] for r in hubs.collect()], np.int64)  # at most HUB_BYTES / 1024 numbers
    folder, near, wedges = near._weft_path, near.select("u", "v"), WEDGES
    squares = [(i, j) for i in range(classes) for j in range(i, classes)]
    square = spark.range(0, len(squares), 1, len(squares))

    def found(batches) -> Iterator[_Square]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield _Square(folder, *squares[k], classes, n, hubs, least, wedges)

    if top is None:
        texts = cut(names.select("n", "id", of("n")).repartition(classes, "k").sortWithinPartitions("k", "n"), "k")._weft_path

        def run(batches):
            for s in found(batches):
                sides = [_read(texts, k, ["n", "id"]).column("id").combine_chunks() for k in (s.i, s.j)]
                ids, width = pa.concat_arrays(sides), len(sides[0])

                def named(c: np.ndarray) -> pa.Array:
                    return ids.take(pa.array(c // classes + np.where(c % classes == s.i, 0, width)))

                for pairs in s.pairs():
                    for at in range(0, len(pairs[0]), BATCH):
                        a, b, score = (c[at : at + BATCH] for c in pairs)
                        yield pa.record_batch([named(a), named(b), pa.array(score.astype(np.int64))], ["a", "b", "score"])

        return square.mapInArrow(run, "a string, b string, score long")

    def lead(batches):
        for s in found(batches):
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in _best(s.pairs(), top)], ["a", "b", "score"])

    best = cut(square.mapInArrow(lead, "a long, b long, score long").orderBy(F.desc("score"), "a", "b").limit(top))
    one = F.broadcast(best.select("a", "b"))  # `top` rows
    mids = near.select(F.col("u").alias("a"), F.col("v").alias("mid")).join(one, "a")
    other = near.join(F.broadcast(best.select(F.col("b").alias("u")).distinct()), "u")  # `top` rows
    mids = mids.join(other.select(F.col("u").alias("b"), F.col("v").alias("mid")), ["b", "mid"])
    mids = mids.join(names.select(F.col("n").alias("mid"), "id"), "mid")
    shared = mids.groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("common_neighbors"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "a", "b")).cast("long")
    out = best.withColumn("rank", place).join(shared, ["a", "b"])
    out = out.join(names.select(F.col("n").alias("a"), F.col("id").alias("a_id")), "a")
    out = out.join(names.select(F.col("n").alias("b"), F.col("id").alias("b_id")), "b")
    return out.select("rank", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score", "common_neighbors").orderBy("rank")
