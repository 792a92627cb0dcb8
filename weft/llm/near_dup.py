"""Near-duplicates by order min hash, verified by banded alignment.

Texts are lower-cased words without ASCII punctuation. Every run of SHINGLE words is labelled with its occurrence
number. For each of SKETCHES seeds the KEPT runs of least hash are kept in the order of the text, and their hash is a
bucket key; two texts meet in a bucket with about the probability that they share those runs in that order, which is
high only if few edits lead from one to the other. Two texts that meet are compared by alignment in a widening band of
diagonals, and are near-duplicates if the edits between their words are at most a fifth of the longer one (similarity
0.8). Classes are the connected components of these links.

Exact copies are one node throughout. In a bucket all nodes are first compared to one of them; buckets whose nodes all
have one class by then are done. Of the others, those of at most SMALL nodes compare all pairs of different classes.

The buckets only settle most classes cheaply; edits spread over a text, short texts and texts that share frequent
passages can fail to meet in them. So at last all texts are compared exactly: each is bucketed by its rarest grams
(three neighbouring words), so many (two of three) that two texts that are alike must have one in twenty of their words
as such grams in common, and all of different classes that do and whose lengths allow it are compared. Grams that many
classes hold are no buckets: texts that could have no others in common are compared in blocks (_heavy).
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, forget, fresh, materialize, read, release, ship, slices
from ..operators.components import components

SHINGLE, SKETCHES, KEPT = 5, 32, 2
#: Sketches whose buckets come first, to settle large classes cheaply.
FIRST = 6
#: Nodes up to which a bucket compares all pairs.
SMALL = 12
#: Words of a gram.
GRAM = 3
#: Classes above which a gram is frequent, and texts of a block of those that share frequent grams alone.
FREQUENT, HEAVY = 256, 500
#: Least count of a frequent gram in the sample of classes that is counted; grams whose counts go to all tasks (12 MB).
SAMPLED, KNOWN = 16, 1 << 20
#: Two texts of n and m words are near-duplicates if EDITS * edits <= max(n, m).
EDITS = 5
#: Pairs that a block of comparisons holds about, and bytes of the texts of its rows or columns.
BLOCK_PAIRS, BLOCK_BYTES = 10_000, 24 << 20
#: Pairs that a task that lets texts meet holds at once.
PAIRS = 500_000
#: Texts of a bucket of the table of all texts, and the most buckets that Spark allows.
BUCKET, BUCKETS = 6000, 100_000

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    MOST = 200_000

    def __init__(self):
        self.keys: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.keys.append(xxhash.xxh3_64_intdigest(word))
        return n


_WORDS = _Words()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_keys(values: list[bytes]) -> list[np.ndarray]:
    """uint64 of each word of each text."""
    global _WORDS
    if len(_WORDS) > _Words.MOST:
        _WORDS = _Words()
    number, parts = _WORDS.__getitem__, []
    for v in values:
        ws = v.decode("utf-8", "replace").lower().encode().translate(None, _PUNCTUATION).split()
        parts.append(np.fromiter(map(number, ws), np.int64, len(ws)))
    keys = np.array(_WORDS.keys, np.uint64)
    return [keys[p] for p in parts]


def runs(words: np.ndarray) -> np.ndarray:
    """uint64 of each run of SHINGLE words; a shorter text is one run."""
    m = max(1, len(words) - SHINGLE + 1)
    run = np.zeros(m, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        run = _scramble(run * np.uint64(31) + words[k : k + m].astype(np.uint64) + np.uint64(k + 1))
    return run


def sketch(words: np.ndarray) -> np.ndarray:
    """SKETCHES bucket keys (int64) of a text; none for a text without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    run = runs(words)
    m = len(run)
    order = np.argsort(run, kind="stable")
    same = run[order]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    if len(first) < m:  # the second occurrence of a run is another run
        nth = np.arange(m) - np.repeat(first, np.diff(np.append(first, m)))
        label = np.empty(m, np.uint64)
        label[order] = nth.astype(np.uint64)
        run = _scramble(run + label * np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros(SKETCHES, np.int64)
    step = max(1, 400_000 // m)
    for at in range(0, SKETCHES, step):
        seeds = _SEEDS[at : at + step]
        h = run[None, :] * seeds[:, None]
        h ^= h >> np.uint64(32)
        h *= _MIX
        rows = np.arange(len(seeds))
        places = []
        for _ in range(min(KEPT, m)):
            places.append(h.argmin(axis=1))
            h[rows, places[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        key = seeds.copy()
        for p in np.sort(np.stack(places), axis=0):  # in the order of the text
            key = _scramble(key * np.uint64(31) + run[p])
        out[at : at + step] = key.view(np.int64)
    return out


def _band(a: np.ndarray, b: np.ndarray, width: int, most: int) -> int | None:
    """Edits between a and b if at most `most` by an alignment that stays within `width` diagonals, else None.

    By furthest reach: after each edit, how far every diagonal of the band gets, sliding over equal words."""
    n, m = len(a), len(b)
    d = np.arange(-width, width + 1)
    limit = np.minimum(n, m - d)  # places of a on each diagonal
    j = np.arange(n)[None, :] + d[:, None]
    inside = (j >= 0) & (j < m)
    differ = ~inside
    differ[inside] = np.broadcast_to(a, j.shape)[inside] != b[j[inside]]
    stop = np.full((len(d), n + 1), n, np.int32)
    stop[:, :n] = np.where(differ, np.arange(n, dtype=np.int32)[None, :], n)
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    rows, goal = np.arange(len(d)), m - n + width
    if not 0 <= goal < len(d):
        return None
    reach = np.full(len(d) + 2, -(1 << 30), np.int64)  # a diagonal beyond the band on either side
    reach[width + 1] = stop[width, 0]
    for edits in range(most + 1):
        if reach[goal + 1] >= n:
            return edits
        t = np.maximum(np.maximum(reach[1:-1] + 1, reach[2:] + 1), reach[:-2])
        t = np.minimum(t, limit)
        ok = (t >= 0) & (t + d >= 0)
        reach[1:-1] = np.where(ok, stop[rows, np.where(ok, t, 0)], -(1 << 30))
    return None


def _rows_band(a: np.ndarray, b: np.ndarray, width: int, most: int) -> int | None:
    """The same by rows, in memory of one row: for long texts and wide bands."""
    n, m, far = len(a), len(b), 1 << 29
    k = np.arange(2 * width + 1)
    row = np.where(k >= width, k - width, far)  # row 0: place k is column k - width
    padded = np.concatenate([np.full(width + 1, -1, np.int64), b.astype(np.int64), np.full(n + width + 1, -1, np.int64)])
    for i in range(1, n + 1):
        column = k + i - width
        cost = (padded[i : i + 2 * width + 1] != int(a[i - 1])).astype(np.int64)
        new = np.minimum(row + cost, np.append(row[1:], far) + 1)
        new = np.where(column == 0, i, new)
        new = np.where((column < 0) | (column > m), far, new)
        row = np.minimum.accumulate(new - k) + k
        row = np.where((column < 0) | (column > m), far, row)
        if row.min() > most:
            return None
    out = int(row[m - n + width]) if 0 <= m - n + width <= 2 * width else far
    return out if out <= most else None


class Bag:
    """A text's words, how often each occurs, and where (a bit a place)."""

    __slots__ = ("words", "known", "times", "_where")

    def __init__(self, words: np.ndarray):
        self.words = words
        self.known, self.times = np.unique(words, return_counts=True)
        self._where = None

    @property
    def where(self) -> dict[int, int]:
        if self._where is None:
            self._where = dict.fromkeys(self.known.tolist(), 0)
            for i, w in enumerate(self.words.tolist()):
                self._where[w] |= 1 << i
        return self._where


def _in_order(x: Bag, y: Bag) -> int:
    """Length of the longest common subsequence of words, a bit of a whole number for each place of x."""
    full = rest = (1 << len(x.words)) - 1
    where = x.where
    for w in y.words.tolist():
        at = where.get(w)
        if at:
            hit = rest & at
            rest = (rest + hit) | (rest - hit)
    return len(x.words) - (rest & full).bit_count()


class _Sets:
    """Which nodes a task has found to be of one class: what links them already needs no further comparison."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def alike(x: Bag, y: Bag) -> bool:
    """Are the edits between the word lists at most a fifth of the longer one?"""
    a, b = x.words, y.words
    n, m = len(a), len(b)
    most = max(n, m) // EDITS
    if abs(n - m) > most:
        return False
    if n == m and (a == b).all():
        return True
    if not most:
        return False
    # Edits are at least the words of the longer list that the other has not.
    at = np.minimum(np.searchsorted(y.known, x.known), len(y.known) - 1)
    apart = max(n, m) - int(np.minimum(x.times, y.times[at])[y.known[at] == x.known].sum())
    if apart > most:
        return False
    # Edits are also at least the words that no common subsequence holds; sought first where few hopes are left.
    ordered = 2 * apart > most
    if ordered and max(n, m) - _in_order(x, y) > most:
        return False
    width = min(most, max(8, abs(n - m) + 4))
    while True:
        method = _band if (2 * width + 1) * n <= 3_000_000 else _rows_band
        if method(a, b, width, most) is not None:
            return True
        if width >= most or not ordered and max(n, m) - _in_order(x, y) > most:
            return False
        width, ordered = min(most, width * 4), True


def _sketches(docs: DataFrame) -> DataFrame:
    """(node, doc_id, h, n, seq, keys) of every row: number, md5 of the text, words, 32 bits a word, bucket keys."""

    def run(batches):
        for batch in batches:
            for part, values in slices(batch, "text", 2 << 20):
                words = word_keys(values)
                seq = [(w & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for w in words]
                keys = [sketch(w) for w in words]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))
                n = pa.array([len(w) for w in words], pa.int32())
                columns = [*part.columns[:3], n, pa.array(seq, pa.binary()), lists]
                yield pa.record_batch(columns, ["node", "doc_id", "h", "n", "seq", "keys"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("h"),
        text.alias("text"),
    )
    return rows.mapInArrow(run, "node long, doc_id long, h binary, n int, seq binary, keys array<long>")


def _verify(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs (u, v) whose texts are alike, as many as join the classes that all pairs that are alike join.

    Nodes are dealt to `side` rows and columns of a square of blocks, and a text goes once to each block in which it has
    pairs, however many these are. The side follows the number of pairs and the bytes of the texts that have some."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    size = ends.join(seqs, "node").agg(F.sum("n")).first()[0] or 0
    side = max(4, isqrt(pairs.count() // BLOCK_PAIRS), -(-8 * size // BLOCK_BYTES))
    deal = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(side))
    dealt = pairs.select("u", "v", (deal("u", 1) * side + deal("v", 2)).alias("block"))
    needs = dealt.select("block", F.col("u").alias("node")).unionByName(dealt.select("block", F.col("v").alias("node"))).distinct()
    needs = needs.join(seqs.select("node", "seq"), "node").select(F.col("block").alias("square"), "node", "seq")

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        seq = dict(zip(texts.column("node").to_pylist(), texts.column("seq").to_pylist(), strict=True))
        bags: dict[int, Bag] = {}

        def bag(node: int) -> Bag:
            if node not in bags:
                if len(bags) >= 4096:
                    bags.clear()
                bags[node] = Bag(np.frombuffer(seq[node], "<u4"))
            return bags[node]

        asked, sets = asked.sort_by([("u", "ascending"), ("v", "ascending")]).select(["u", "v"]), _Sets()

        def link(x: int, y: int) -> bool:
            if sets.find(x) == sets.find(y) or not alike(bag(x), bag(y)):
                return False
            sets.join(x, y)
            return True

        ok = [link(x, y) for x, y in zip(*(c.to_pylist() for c in asked.columns), strict=True)]
        return asked.filter(pa.array(ok, pa.bool_()))

    return needs.groupBy("square").cogroup(dealt.groupBy("block")).applyInArrow(run, "u long, v long")


def _mixed(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries (key, node) of buckets with two classes or more, with label, the bucket's least one (low, and
    lead, its least node) and its number of nodes."""
    if labels is None:
        named = entries.withColumn("label", F.col("node"))
    else:
        named = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = named.groupBy("key").agg(
        F.min(F.struct("label", "node")).alias("first"), F.max("label").alias("high"), F.count("*").alias("n")
    )
    each = each.where("first.label < high").select("key", F.col("first.label").alias("low"), F.col("first.node").alias("lead"), "n")
    # Written, so that the join below deals both sides out by itself and Spark can split the rows of a hot bucket.
    return named.join(materialize(each), "key")


def _all_pairs(found: DataFrame) -> DataFrame:
    """Pairs of different classes of each bucket; buckets of the same nodes count once."""
    sets = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("all")).select("all").distinct()
    first = sets.select("all", F.posexplode("all").alias("i", "x"))
    later = F.filter(F.slice("all", F.col("i") + 2, F.size("all")), lambda y: y["label"] != F.col("x.label"))
    return first.select(F.col("x.node").alias("u"), F.explode(later).alias("y")).select("u", F.col("y.node").alias("v"))


def _nth(grams: np.ndarray) -> np.ndarray:
    """The second occurrence of a gram is another one."""
    order = np.argsort(grams, kind="stable")
    same = grams[order]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    nth = np.empty(len(grams), np.uint64)
    nth[order] = (np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))).astype(np.uint64)
    return _scramble(grams + nth * np.uint64(0xD6E8FEB86659FD93))


def _hash(words: np.ndarray, size: int) -> np.ndarray:
    """uint64 of each `size` neighbouring words."""
    w, m = words.astype(np.uint64), len(words) - size + 1
    out = np.full(m, size, np.uint64)
    for k in range(size):
        out = _scramble(out * np.uint64(65599) + w[k : k + m] + np.uint64(1))
    return out


def _grams_of(words: np.ndarray) -> np.ndarray:
    """uint64 of each GRAM neighbouring words, or of a shorter text.

    Of five words one may differ, and then no gram need be the same: texts of four and five words have all that is left
    of them without one word, or the four words, as grams too."""
    n = len(words)
    grams = _nth(_hash(words, min(GRAM, n)))
    if n not in (EDITS - 1, EDITS):
        return grams
    left = [words] if n < EDITS else [np.delete(words, i) for i in range(n)]
    return np.concatenate([grams, np.unique(np.concatenate([_hash(x, EDITS - 1) for x in left]))])


def _needed(n):
    """Grams that a text of n words shares at least with one not longer that is alike: an edit changes GRAM of them."""
    return np.maximum(1, n - (GRAM - 1) - GRAM * (n // EDITS))


def _least(n):
    """_needed of a text of n words and any that is alike and not shorter."""
    return np.minimum(_needed(n), _needed((n // EDITS + 1) * EDITS))


def _common(n):
    """Rarest grams that a text of n words has in common with one that is alike, if that has as many or more."""
    return 1 + np.maximum(0, np.minimum(_least(n) - 1, n // 20))


def _rarest(words: np.ndarray, known: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest grams of a text (uint64), so many that texts that are alike have _common of them in common, and how
    often each counts. known are the grams with counts, in order; others count 0.

    They share _needed(longer) at least, so all but _common - 1 of these cannot be beyond the first n - (GRAM - 1) -
    _needed + _common in any one order that all texts follow. Texts of up to five words give all their grams."""
    found, n = _grams_of(words), len(words)
    often = np.zeros(len(found), np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        often = np.where(known[at] == found, times[at], 0)
    most = len(found) if n <= EDITS else max(1, n - (GRAM - 1) - int(_least(n)) + int(_common(n)))
    order = np.lexsort((found, often))[:most]
    return found[order], often[order]


def _counts(named: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent grams in a sample of one text a class (a fixed share of all, so that a gram's count follows the
    corpus), their counts, and the count above which they are frequent. At most KNOWN grams, those of largest counts.

    Any grams and counts give the same links: they decide the order of grams and which are no buckets, for all texts
    alike. A class counts once since its members are not compared to one another, however many share a gram."""
    every = max(1, FREQUENT // SAMPLED)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                found = [_grams_of(np.frombuffer(x, "<u4")) for x in batch.column(0).slice(at, 2048).to_pylist()]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

    some = named.where((F.col("node") == F.col("label")) & (F.pmod(F.xxhash64("node"), F.lit(every)) == 0))
    counted = some.select("seq").mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").cast("int").alias("n"))
    counted = materialize(counted.where("n > 1"))
    least, total = 2, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
        total += r["c"]
        if total > KNOWN:
            least = r["n"] + 1
            break
    found = counted.where(F.col("n") >= least).toArrow()
    release(counted)
    gram, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order], FREQUENT // every


def _sharing(seqs: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(u, v): all pairs of texts of different classes that can be alike by their lengths and rarest grams, but for
    those that share frequent grams alone; and the rows of `emit`, among them the texts for _heavy."""
    if labels is None:
        named = seqs.select("node", F.col("node").alias("label"), "seq")
    else:
        named = seqs.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "seq")
    *known, frequent = _counts(named)
    known = seqs.sparkSession.sparkContext.broadcast(known)

    parts = seqs.count() // 6000 + 1

    def row(part: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        cells = [pa.array([part], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)]
        return pa.record_batch(cells, ["part", "key", "times", "node", "label", "n", "hot"])

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                chunk = batch.slice(at, 2048)
                words = [np.frombuffer(x, "<u4") for x in chunk.column(2).to_pylist()]
                size = np.array([len(w) for w in words], np.int32)
                some = [_rarest(w, *known.value) for w in words]
                found, often = [k[t <= frequent] for k, t in some], [k[t > frequent] for k, t in some]
                hot = np.array([len(k) for k in often], np.int32)
                node, label = (chunk.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                heavy = np.flatnonzero(hot >= _common(size))
                for i in heavy:
                    columns = [often[i], words[i], *(c[i : i + 1] for c in (node, label, size, hot))]
                    yield row(-1, columns)
                key, place = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
                part = (key % np.uint64(parts)).astype(np.int64)
                # 32 bits beside the part: grams that fall together only make a pair of texts more to be compared.
                key = (key // np.uint64(parts)).astype(np.uint32)
                order = np.argsort(part, kind="stable")
                key, place = key[order], place[order]
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                for k in range(parts):
                    x, y = ends[k], ends[k + 1]
                    if x < y:
                        some, times = np.unique(place[x:y], return_counts=True)
                        yield row(k, [key[x:y], times.astype(np.int32), node[some], label[some], size[some], hot[some]])

    def meet(batches):
        # Grams with the place of their text, 8 bytes each; what texts have is kept once a text.
        keys, places, texts, count = [], [], [], 0
        for batch in batches:
            for key, times, *of in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                times = np.frombuffer(times, "i4")
                keys.append(np.frombuffer(key, "u4"))
                places.append(np.repeat(np.arange(count, count + len(times), dtype=np.int32), times))
                texts.append([np.frombuffer(x, t) for x, t in zip(of, ("i8", "i8", "i4", "i4"))])
                count += len(times)
        if not keys:
            return
        key, place = np.concatenate(keys), np.concatenate(places)
        node, label, n, hot = (np.concatenate([t[i] for t in texts]) for i in range(4))
        del keys, places, texts
        order = np.argsort(key, kind="stable")
        same = key[order]
        more = np.zeros(len(order), bool)  # rows whose key others have
        more[1:] = same[1:] == same[:-1]
        more[:-1] |= more[1:]
        order = order[more]
        key, place = key[order], place[order]
        del order, same, more
        if not len(key):
            return
        rank = np.empty(count, np.int32)  # of texts by label and node
        rank[np.lexsort((node, label))] = np.arange(count, dtype=np.int32)
        order = np.lexsort((rank[place], key))
        key, place = key[order], place[order]
        del order
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_label = new_key | np.concatenate([[True], label[place[1:]] != label[place[:-1]]])
        end_key, end_label = (np.append(np.flatnonzero(x)[1:], len(key)).astype(np.int32)[np.cumsum(x) - 1] for x in (new_key, new_label))
        del key, new_key, new_label
        times = end_key - end_label  # partners of other classes in the same bucket, each pair once
        del end_key
        upto = np.cumsum(times, dtype=np.int64)
        common, at = _common(n), 0
        while at < len(times):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            t = times[at:to]
            u = np.repeat(place[at:to], t)
            v = place[np.repeat(end_label[at:to] - (np.cumsum(t) - t), t) + np.arange(len(u))]
            longer = np.maximum(n[u], n[v])
            near = longer - np.minimum(n[u], n[v]) <= longer // EDITS
            u, v = u[near], v[near]
            due = np.minimum(common[u], common[v]) - np.minimum(hot[u], hot[v])  # of the rare ones, if all frequent ones are shared
            pairs = np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v]), due])
            pairs = pairs[:, np.lexsort(pairs[:2])]
            start = np.flatnonzero(np.append(True, (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0))) if len(u) else u
            met = np.diff(np.append(start, len(u)))
            yield pa.record_batch([*(pa.array(c.astype(np.int64)) for c in (*pairs[:, start], met))], ["u", "v", "due", "met"])
            at = to

    rows = materialize(named.mapInArrow(emit, "part int, key binary, times binary, node binary, label binary, n binary, hot binary"))
    rare = rows.where("part >= 0").repartition(parts, "part").mapInArrow(meet, "u long, v long, due long, met long")
    pairs = rare.groupBy("u", "v").agg(F.sum("met").alias("met"), F.min("due").alias("due"))
    return pairs.where("met >= due").select("u", "v"), rows


def _heavy(rows: DataFrame) -> DataFrame:
    """(u, v): the links between texts of different classes that have no rare gram in common.

    Such texts hold many frequent grams (passages that many classes hold) and share _common of them at least. They
    are dealt into blocks by length; each two blocks whose lengths allow it are one task, which counts shared
    grams by products of matrices, compares what is left, and returns nothing but links. So no pair leaves a task,
    but the time grows with the square of the number of such texts of about one length."""
    text = rows.where("part = -1").select("key", F.col("times").alias("seq"), "node", "label", (F.octet_length("times") / 4).cast("int").alias("n"))
    count = text.count()
    schema = "u long, v long"
    if count < 2:
        return rows.sparkSession.createDataFrame([], schema)
    blocks = -(-count // HEAVY)
    edges = text.approxQuantile("n", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    edges = sorted({int(e) for e in edges})  # a number for each block
    low = [0, *(e + 1 for e in edges)]
    # Texts of one length can be more than a block holds: such a block is cut further, by hash.
    block = sum((F.col("n") > e).cast("int") for e in edges) if edges else F.lit(0)
    sizes = {r["b"]: r["c"] for r in text.groupBy(block.alias("b")).agg(F.count("*").alias("c")).collect()}
    cut = {b: -(-c // (2 * HEAVY)) for b, c in sizes.items()}
    high = [*edges, 1 << 62]
    places = [(b, k) for b in sorted(cut) for k in range(cut[b])]
    squares: dict[tuple, list[int]] = {p: [] for p in places}
    n_squares = 0
    for i, p in enumerate(places):
        for q in places[i:]:
            if low[q[0]] - high[p[0]] <= low[q[0]] // EDITS or p[0] == q[0]:
                for x in {p, q}:
                    squares[x].append(2 * n_squares + (x == q))
                n_squares += 1
    plan = rows.sparkSession.createDataFrame([(b, k, v) for (b, k), v in squares.items()], "b int, k long, squares array<long>")
    spread = plan.groupBy("b").agg(F.max("k").alias("most"))
    dealt = text.withColumn("b", block.cast("int")).join(spread, "b")
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("node"), F.col("most") + 1)).join(plan, ["b", "k"])
    dealt = dealt.select(F.explode("squares").alias("s"), "key", "seq", "node", "label")
    dealt = dealt.select((F.col("s").bitwiseAND(F.lit(1)) == 1).alias("right"), F.shiftright("s", 1).alias("square"), "key", "seq", "node", "label")

    def run(square: pa.Table) -> pa.Table:
        right = square.column("right").to_numpy()
        node, label = (square.column(c).combine_chunks() for c in ("node", "label"))
        node, label = (np.array([np.frombuffer(x, "i8")[0] for x in c.to_pylist()], np.int64) for c in (node, label))
        keys = [np.frombuffer(x, "u8") for x in square.column("key").to_pylist()]
        words = [np.frombuffer(x, "<u4") for x in square.column("seq").to_pylist()]
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        alone = not len(a)  # a block with itself
        a = b if alone else a
        size = np.array([len(w) for w in words])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        place = np.empty(len(keys), np.int64)
        met = np.zeros((len(a), len(b)), np.float32)
        in_a, in_b = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        in_a[a], in_b[b] = True, True
        both = np.bincount(at, minlength=len(known))[at] > 1  # a gram of one text is no one else's
        known, at = np.unique(at[both], return_inverse=True)
        owner = owner[both]
        for first in range(0, len(known), 4096):
            x, y = np.searchsorted(at, [first, first + 4096])
            sides = []
            for side, member in ((a, in_a), (b, in_b)):
                place[side] = np.arange(len(side))
                own = member[owner[x:y]]
                m = np.zeros((len(side), min(4096, len(known) - first)), np.float32)
                m[place[owner[x:y][own]], at[x:y][own] - first] = 1
                sides.append(m)
            met += sides[0] @ sides[1].T
        longer = np.maximum(size[a][:, None], size[b][None, :])
        near = longer - np.minimum(size[a][:, None], size[b][None, :]) <= longer // EDITS
        common = _common(size)
        near &= met >= np.minimum(common[a][:, None], common[b][None, :])
        near &= label[a][:, None] != label[b][None, :]
        if alone:
            near &= node[a][:, None] < node[b][None, :]
        bags: dict[int, Bag] = {}
        bag = lambda i: bags.get(i) or bags.setdefault(i, Bag(words[i]))
        links, sets = [], _Sets()
        for x, y in ((a[i], b[j]) for i, j in zip(*np.nonzero(near), strict=True)):
            if sets.find(label[x]) != sets.find(label[y]) and alike(bag(x), bag(y)):
                sets.join(label[x], label[y])
                links.append((x, y))
        u, v = (np.array([node[x[i]] for x in links], np.int64) for i in (0, 1))
        return pa.table([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return dealt.groupBy("square").applyInArrow(run, schema)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, label, class_id) for every row of docs(doc_id, text, ...): h is the md5 of the text, label a number of
    the row's class, class_id the least doc_id of the class.

    Null text is empty. Texts without words are alike only if equal. Rows of one doc_id are judged by their texts, so
    they can be in several classes, which then can have one class_id but not one label. A null doc_id takes part like
    any other; a class in which all are null has a hash of its texts as class_id. Repeated rows stay. An empty table
    gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    # In buckets by node, so that no join on nodes moves the words of texts.
    rows = bucketed(_sketches(docs), "node", min(BUCKETS, max(8, docs.count() // BUCKET)))
    # Of equal texts one row, the node, stands for all.
    texts = materialize(rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.min("node").alias("node")))
    # The place of a sketch among the keys is part of its key, so buckets of different sketches stay apart.
    entries = rows.select("node", "keys").join(texts.select("node"), "node").select("node", F.posexplode("keys").alias("sketch", "key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    entries = materialize(entries.join(shared, "key"))
    seqs = rows.select("node", "seq", "n").where("n > 0").join(texts.select("node"), "node")
    ids = materialize(rows.select("doc_id", "h"))
    labels, tested = None, None

    def settle(pairs: DataFrame) -> None:
        """Compare the pairs that have not been compared, and join the classes of those that are alike."""
        nonlocal labels, tested
        pairs = pairs.select("u", "v").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = materialize(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        join_classes(materialize(_verify(pairs, seqs)))

    def join_classes(links: DataFrame) -> None:
        nonlocal labels
        if links.isEmpty():
            return
        if labels is None:
            labels = components(links)
            return
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
        ends = ends.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
        moved = components(ends)
        # A label that moves takes its nodes along; nodes that had no class before come in.
        known = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left")
        known = known.select("node", F.coalesce("now", "label").alias("label"))
        fresh = moved.join(labels.select("node"), "node", "left_anti")
        labels = materialize(known.unionByName(fresh))

    star = lambda m: m.where("label <> low").select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v"))
    settle(star(_mixed(entries.where(F.col("sketch") < FIRST).select("key", "node"), labels)))
    found = materialize(_mixed(entries.select("key", "node"), labels))
    many = found.where(F.col("n") > SMALL)
    settle(_all_pairs(found.where(F.col("n") <= SMALL)).unionByName(star(many)))
    release(entries, found)
    pairs, rows_of = _sharing(seqs, labels)
    settle(pairs)
    join_classes(materialize(_heavy(rows_of)))
    release(rows_of, rows)
    forget(rows)
    named = texts.select("h", "node", "rep")
    named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left")
    named = materialize(named.select("h", "rep", F.coalesce("label", "node").alias("label")))
    first = named.groupBy("label").agg(F.coalesce(F.min("rep"), F.xxhash64(F.min("h"))).alias("class_id"))
    named = named.select("h", "label").join(first, "label")
    return ids.join(named, "h").select("doc_id", "h", "label", "class_id")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document of least id stays (null last; of equal ids, that of least text hash)."""
    columns = docs.columns
    md5_col, id_col = fresh(columns, "h"), fresh(columns, "id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    stay = classes(docs.select("doc_id", "text")).groupBy("label").agg(F.min(order).alias("k"))
    stay = stay.select(F.col("k.doc_id").alias(id_col), F.col("k.h").alias(md5_col))
    marked = docs.withColumn(md5_col, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col(f"s.{id_col}")) & (F.col(f"d.{md5_col}") == F.col(f"s.{md5_col}"))
    kept = marked.join(stay.alias("s"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", md5_col]).select(*(f"`{c}`" for c in columns))


QUERIES = {"op3_order_minhash": op3_order_minhash}
SQL: dict[str, str] = {}
