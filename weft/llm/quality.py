"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio with a deterministic threshold.

Tokens are runs of letters and digits, or single other characters; features are token unigrams and bigrams hashed into
BUCKETS. Two multinomials with add-one smoothing, of the trusted target and of the raw corpus, give each bucket a
log-likelihood ratio; a document's score is the mean over its features, so length does not matter. The raw multinomial
counts all documents. The target is fitted on half of the trusted labelled rows (by hash of the id), and the threshold
is set on the other half and all bad ones, where rejecting a trusted row costs COST times as much as keeping a bad one.
All labelled rows take part. Then every document is scored.

The model is BUCKETS numbers whatever the corpus; counts are added up in each task and by bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, ship, slices

BUCKETS = 1 << 16
#: Labelled rows used to fit the target and set the threshold; None: all.
SAMPLE = None
#: Labelled rows whose roles go to all tasks; more than these meet the documents in a join.
BROADCAST = 1 << 20
COST = 10.0
#: Width of the score bins among which the threshold is sought.
BIN = 0.002
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_INSIDE = (np.arange(256) & 0xC0) == 0x80  # bytes that continue a code point
_CHAR = ~_INSIDE & ~_BLANK


class Words(dict):
    """Number of each word a worker has met, with the hashes of its tokens; forgotten when there are too many."""

    MOST = 200_000

    def __init__(self):
        self.hashes: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        tokens = _TOKEN.findall(word)
        self.hashes += [zlib.crc32(t) for t in tokens]
        self.sizes.append(len(tokens))
        return n


_WORDS = Words()


class Slice:
    """Words and features of some texts, flat, with the text that each belongs to."""

    def __init__(self, values: list[bytes]):
        global _WORDS
        if len(_WORDS) > Words.MOST:
            _WORDS = Words()
        self.values, self.n = values, len(values)
        number = _WORDS.__getitem__
        parts = [np.fromiter(map(number, ws), np.int64, len(ws)) for ws in (v.split() for v in values)]
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.n_words = np.array([len(p) for p in parts], np.int64)
        self.text_of_word = np.repeat(np.arange(self.n), self.n_words)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of every unigram and bigram."""
        sizes = np.array(_WORDS.sizes, np.int64)
        hashes = np.array(_WORDS.hashes, np.uint64)
        size = sizes[self.words]
        to = np.cumsum(size)
        index = np.arange(int(to[-1]) if len(to) else 0)
        index += np.repeat((np.cumsum(sizes) - sizes)[self.words] - (to - size), size)
        token, text = hashes[index], np.repeat(self.text_of_word, size)
        one = (token * _MIX) >> np.uint64(48)
        pair = ((token[:-1] * _MIX) ^ (token[1:] + np.uint64(0x632BE59BD9B4E019))) * _MIX >> np.uint64(48)
        inside = text[:-1] == text[1:]
        return np.concatenate([one, pair[inside]]).astype(np.int64), np.concatenate([text, text[:-1][inside]])

    def repeated(self) -> np.ndarray:
        """Words of each text that lie in a window of WINDOW words found twice or more in it."""
        out, w = np.zeros(self.n, np.int64), self.words.astype(np.uint64)
        m = len(w) - WINDOW + 1
        if m < 2:
            return out
        text = self.text_of_word
        key = text[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(WINDOW):
            key = (key ^ w[k : k + m]) * _MIX
            key ^= key >> np.uint64(29)
        whole = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
        key = key[whole]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return out
        at = whole[np.isin(key, twice)]
        groups: dict[tuple, list[int]] = {}
        for i in at.tolist():  # the few candidates, compared word by word
            groups.setdefault((int(text[i]), *w[i : i + WINDOW].tolist()), []).append(i)
        edge = np.zeros(len(w) + 1, np.int64)
        for g in groups.values():
            if len(g) > 1:
                np.add.at(edge, np.array(g), 1)
                np.add.at(edge, np.array(g) + WINDOW, -1)
        covered = np.cumsum(edge)[:-1] > 0
        return np.bincount(text[covered], minlength=self.n)

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """(code points in words, symbols) of each text."""
        buf = np.frombuffer(b"".join(self.values), np.uint8)
        ends = np.cumsum([len(v) for v in self.values])
        out = []
        for table in (_CHAR, _SYMBOL):
            total = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
            out.append(np.diff(total[np.concatenate([[0], ends]).astype(np.int64)]))
        return out[0], out[1]

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line."""
        out = np.zeros(self.n, np.int64)
        for i, v in enumerate(self.values):
            if b"\n" in v:
                lines = [x for x in v.split(b"\n") if x.strip()]
                out[i] = len(lines) - len(set(lines))
        return out

    def failed(self, repeated: np.ndarray) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * self.n_words)

    def scores(self, ratio: np.ndarray) -> np.ndarray:
        bucket, text = self.features()
        n = np.bincount(text, minlength=self.n)
        return np.bincount(text, ratio[bucket], self.n) / np.maximum(n, 1)


def _labelled(labels: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """(doc_id, role): 1 fits the target, 2 trusted and 3 bad set the threshold. All rows, or `sample` of them."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    one = one.agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    one = one.where((F.col("quality") == 0) | ((F.col("quality") == 1) & (F.col("toxic") == 0)))
    h = F.xxhash64("doc_id")
    role = F.when(F.col("quality") == 0, 3).when(h.bitwiseAND(1) == 0, 1).otherwise(2)
    if sample is not None:
        one = one.orderBy(h, "doc_id").limit(sample)
    return one.select("doc_id", role.alias("role"))


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = SAMPLE) -> tuple[np.ndarray, float]:
    """(log-likelihood ratio of each bucket, threshold). Without labelled rows of both kinds nothing is rejected."""
    ship(docs.sparkSession)
    written = materialize(_labelled(labels, sample))
    few = written.count() <= BROADCAST
    chosen = F.broadcast(written) if few else written  # at most BROADCAST rows

    def count(batches):
        got = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part, values in slices(batch, "text"):
                s = Slice(values)
                bucket, text = s.features()
                got[0] += np.bincount(bucket, minlength=BUCKETS)
                fits = np.array([r == 1 for r in part.column(1).to_pylist()], bool)
                if fits.any():
                    got[1] += np.bincount(bucket[fits[text]], minlength=BUCKETS)
        for kind in (0, 1):
            at = np.flatnonzero(got[kind])
            yield pa.record_batch([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(got[kind][at])], ["k", "b", "n"])

    texts = docs.select("doc_id", "text")
    marked = (texts if few else texts.where("doc_id IS NOT NULL")).join(chosen, "doc_id", "left").select("text", "role")
    if not few:  # rows without an id would all be one key
        marked = marked.unionByName(texts.where("doc_id IS NULL").select("text", F.lit(None).cast("int").alias("role")))
    sums = marked.mapInArrow(count, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    total = np.zeros((2, BUCKETS))
    for r in sums.collect():  # at most 2 * BUCKETS rows
        total[r["k"], r["b"]] = r["n"]
    ratio = np.log((total[1] + 1) / (total[1].sum() + BUCKETS)) - np.log((total[0] + 1) / (total[0].sum() + BUCKETS))

    def score(batches):
        for batch in batches:
            for part, values in slices(batch, "text"):
                s = Slice(values)
                ok = ~s.failed(s.repeated())
                bins = np.floor(s.scores(ratio) / BIN).astype(np.int64)
                yield pa.record_batch([pa.array(bins[ok]), part.column(1).filter(pa.array(ok))], ["bin", "role"])

    held = texts.join(chosen.where("role > 1"), "doc_id").select("text", "role")
    bins = held.mapInArrow(score, "bin long, role int").groupBy("bin", "role").count().collect()  # bounded by the bins
    release(written)
    return ratio, threshold({(r["bin"], r["role"]): r["count"] for r in bins})


def threshold(bins: dict[tuple[int, int], int]) -> float:
    """The bin edge at which kept bad rows and COST times the rejected trusted rows, as shares, are fewest; of a run of
    equal edges the middle. -inf if a kind has no rows."""
    kinds = [{b: n for (b, role), n in bins.items() if role == k} for k in (2, 3)]
    if not all(kinds):
        return float("-inf")
    lo, hi = min(min(k) for k in kinds), max(max(k) for k in kinds) + 1
    size = [sum(k.values()) for k in kinds]
    below, best, edges = [0, 0], None, []
    for edge in range(lo, hi + 1):
        loss = round(COST * below[0] / size[0] + 1 - below[1] / size[1], 12)
        if best is None or loss < best:
            best, edges = loss, []
        if loss == best:
            if edges and edges[-1] != edge - 1:
                edges = []
            edges.append(edge)
        below = [b + k.get(edge, 0) for b, k in zip(below, kinds, strict=True)]
    return edges[len(edges) // 2] * BIN


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, score double"
)


def judge(docs: DataFrame, labels: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """docs with the base counts, base_failed, kept and score added; columns of docs with such names are replaced.

    docs needs doc_id and text; null text has no words and fails. Repeated rows are each judged; null ids have no
    label. An empty table gives no rows.
    """
    ratio, least = fit(docs, labels, sample)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)  # BUCKETS doubles
    added = [c.split()[0] for c in _COLUMNS.split(", ")]
    keep = [c for c in docs.columns if c not in added]
    types = pa_names(docs.select(*keep))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, "text"):
                s = Slice(values)
                repeated, (chars, symbols), score = s.repeated(), s.chars(), s.scores(shared.value)
                failed = s.failed(repeated)
                new = [s.n_words, chars, symbols, s.dup_lines(), repeated, failed, ~failed & (score >= least), score]
                yield pa.record_batch([*part.columns, *map(pa.array, new)], [*part.schema.names, *added])

    return docs.select(*keep).mapInArrow(run, f"{types}, {_COLUMNS}")


def pa_names(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def op4_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, read(spark, sf_dir, "labels")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    columns = docs.columns
    return judge(docs, read(spark, sf_dir, "labels")).where("kept").select(*columns)


QUERIES = {"op4_ngram_ratio": op4_ngram_ratio}
SQL: dict[str, str] = {}
