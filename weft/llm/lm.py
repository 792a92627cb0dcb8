"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; a decision is predicted from the bits of the byte so far and the DEPTH bytes
before it. Every node (context of depth d, bits so far) holds a Krichevsky-Trofimov estimate of its decisions in the
training texts, and a node's weighted probability is half its own estimate and half the product over the contexts one
byte longer. The weights of the mixture follow from these in closed form, so a batch of counts gives what sequential
weighting gives after the whole corpus. The code length of a text is the sum over its bytes and one end symbol.

The tree is built and read back by DataFrame aggregations level by level; its leaves are the byte (DEPTH + 1)-grams of
the corpus, and the result is one log-probability a gram. Word counts for the base score come in the same pass. The
table of grams and words goes to the workers whole while it has at most BROADCAST rows; beyond that, each block of
documents gets just the rows that it needs, through a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, ship, slices

#: Bytes of context.
DEPTH = 4
#: Documents whose id's crc32 has this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Rows (16 bytes each) of the table of grams and words up to which every worker gets all of it.
BROADCAST = 8_000_000
#: Text bytes of a block of documents beyond that.
BLOCK_BYTES = 32 << 20
_END = 0xFF  # occurs in no UTF-8 text; stands before and after every text
_END_WORD = np.int64(-1)
_FLUSH = 2_000_000


class _Words(dict):
    """Number of each lower-cased word a worker has met, and its key; forgotten when there are too many."""

    MOST = 400_000

    def __init__(self):
        self.keys: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        # Keys of words are negative and even, those of grams positive; -1 is the end.
        self.keys.append(((xxhash.xxh3_64_intdigest(word) | 1 << 63) & ~1) - (1 << 64))
        return n


_WORDS = _Words()


def _tokens(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word keys of all texts, words of each text)."""
    global _WORDS
    if len(_WORDS) > _Words.MOST:
        _WORDS = _Words()
    number = _WORDS.__getitem__
    parts = [np.fromiter(map(number, ws), np.int64, len(ws)) for ws in (v.split() for v in values)]
    return np.array(_WORDS.keys, np.int64)[np.concatenate(parts)], np.array([len(p) for p in parts])


def _grams(values: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) of every byte and end of each text; a gram is its context's bytes and the byte itself."""
    edge = bytes([_END])
    buf = np.frombuffer(edge * depth + edge.join(values) + edge, np.uint8)
    sizes = np.array([len(v) + 1 for v in values])
    text = np.repeat(np.arange(len(values)), sizes)
    into = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in its text
    gram = buf[depth:].astype(np.int64)
    for back in range(1, depth + 1):
        before = np.where(into >= back, buf[depth - back : len(buf) - back], _END)
        gram |= before.astype(np.int64) << (8 * back)
    return gram, text


class _Counts:
    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append(_summed(keys, n))
        self.size += len(self.parts[-1][0])

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [(keys, n)], len(keys)
        return keys, n


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _count(depth: int):
    """Rows (text, trains) -> partial counts (key, n): grams of all texts, words of training texts."""

    def run(batches):
        counts, pending = _Counts(), 0
        for batch in batches:
            for part, values in slices(batch, "text", 2 << 20):
                values = [v.lower() for v in values]
                trains = np.array(part.column(1).to_pylist(), np.int64)
                gram, text = _grams(values, depth)
                counts.add(gram, trains[text])
                learn = [v for v, t in zip(values, trains, strict=True) if t]
                if learn:
                    keys, _ = _tokens(learn)
                    counts.add(keys, np.ones(len(keys), np.int64))
                    counts.add(np.array([_END_WORD]), np.array([len(learn)]))
                pending += 1
                if pending >= 8:
                    pending = 0
                    if len(counts.compact()[0]) > _FLUSH:
                        yield pa.record_batch([pa.array(x) for x in counts.compact()], ["key", "n"])
                        counts = _Counts()
        keys, n = counts.compact()
        yield pa.record_batch([pa.array(keys), pa.array(n)], ["key", "n"])

    return run


def _lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight steps up, and back down by the product."""
    y = x + 8.0
    down = x
    for i in range(1, 8):
        down = down * (x + float(i))
    tail = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.log(down)


def _kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a + b == 0, 0.0).otherwise(
        _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)
    )


def _decisions(grams: DataFrame, *kept: str) -> DataFrame:
    """Eight rows a gram: node (context, then 1 and the bits so far in its last byte) and the bit decided."""
    j = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = grams.select("key", *kept, j.alias("j"))
    symbol = F.col("key").bitwiseAND(F.lit(255))
    prefix = F.call_function("shiftright", symbol, 8 - F.col("j")) + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    return rows.select(
        "key",
        *kept,
        (F.col("key") - symbol + prefix).alias("node"),
        F.call_function("shiftright", symbol, 7 - F.col("j")).bitwiseAND(F.lit(1)).alias("bit"),
    )


def weigh(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """log10 of each gram's weighted probability: grams(key, n) -> (key, logp). n may be 0 (a gram to be scored that
    training never met)."""
    level = _decisions(grams, "n").groupBy("node").agg(
        F.sum(F.col("n") * (1 - F.col("bit"))).alias("a"), F.sum(F.col("n") * F.col("bit")).alias("b")
    )
    levels = [materialize(level.withColumn("lw", _kt(F.col("a"), F.col("b"))))]
    for d in range(depth - 1, -1, -1):
        parent = F.col("node").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1))
        up = levels[-1].groupBy(parent.alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("ls"))
        up = up.withColumn("lpe", _kt(F.col("a"), F.col("b")))
        top = F.greatest("lpe", "ls")
        both = top + F.log(F.exp(F.col("lpe") - top) + F.exp(F.col("ls") - top)) - math.log(2)
        levels.append(materialize(up.withColumn("lw", both).drop("ls")))
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    stop = F.exp(F.col("lpe") - math.log(2) - F.col("lw"))
    mixed = levels[-1].select("node", (stop * one).alias("acc"), (1 - stop).alias("rest"))
    for d in range(1, depth + 1):
        here = levels[depth - d].withColumn("up", F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1)))
        joined = here.join(mixed.withColumnRenamed("node", "up"), "up")
        if d < depth:
            acc, rest = F.col("acc") + F.col("rest") * stop * one, F.col("rest") * (1 - stop)
            mixed = joined.select("node", acc.alias("acc"), rest.alias("rest"))
        else:
            mixed = joined.select("node", (F.col("acc") + F.col("rest") * one).alias("p"))
    p = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return _decisions(grams).join(mixed, "node").groupBy("key").agg(F.sum(F.log10(p)).alias("logp"))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _score(values: list[bytes], grams, words, total: int, distinct: int, depth: int) -> list[np.ndarray]:
    """[tokens, known tokens, base score, score] of each text; grams and words are (sorted keys, values)."""
    values = [v.lower() for v in values]
    gram, text = _grams(values, depth)
    logp = _look(*grams, gram, np.nan)
    if np.isnan(logp).any():
        raise RuntimeError("a gram of the corpus is missing from the model")
    score = np.bincount(text, logp, len(values))
    keys, n = _tokens(values)
    count = _look(*words, keys, 0.0)
    text = np.repeat(np.arange(len(values)), n)
    ends = float(_look(*words, np.array([_END_WORD]), 0.0)[0])
    per = math.log10(total + distinct + 1)
    known = np.bincount(text, count > 0, len(values)).astype(np.int64) + (ends > 0)
    base = np.bincount(text, np.log10(count + 1), len(values)) + math.log10(ends + 1) - per * (n + 1)
    return [n + 1, known, base, score]


_COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(
    docs: DataFrame,
    depth: int = DEPTH,
    broadcast: int = BROADCAST,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    A-Z are lower-cased. Null text is empty: one end token. A null id is training data; repeated rows count and are
    scored each. An empty table gives no rows. Texts are whole, whatever their length.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), held.alias("held_out"))
    counts = rows.select("text", (~F.col("held_out")).cast("long").alias("trains")).mapInArrow(_count(depth), "key long, n long")
    counts = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")))
    grams, words = counts.where("key >= 0"), counts.where("key < 0")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = whole["total"], whole["distinct"]
    model = weigh(grams, depth).unionByName(words.select("key", F.col("n").cast("double").alias("logp")))
    model = materialize(model.withColumnRenamed("logp", "value"))

    def split(keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        at = int(np.searchsorted(keys, 0))
        return (keys[at:], values[at:]), (keys[:at], values[:at])

    def out(part: pa.RecordBatch, values: list[bytes], grams, words) -> pa.RecordBatch:
        new = _score(values, grams, words, total, distinct, depth)
        return pa.record_batch([part.column("doc_id"), part.column("held_out"), *map(pa.array, new)], _names)

    _names = [c.split()[0] for c in _COLUMNS.split(", ")]
    if model.count() <= broadcast:
        table = model.toArrow()
        shared = spark.sparkContext.broadcast(split(table.column("key").to_numpy(), table.column("value").to_numpy()))
        del table

        def run(batches):
            for batch in batches:
                for part, values in slices(batch, "text", 2 << 20):
                    yield out(part, values, *shared.value)

        scored = rows.mapInArrow(run, _COLUMNS)
    else:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
        blocks = max(1, -(-size // block_bytes))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

        def needs(table: pa.Table) -> pa.Table:
            found = _Counts()
            block = table.column("block")[0].as_py() if table.num_rows else 0
            for batch in table.to_batches():
                for _, values in slices(batch, "text", 2 << 20):
                    values = [v.lower() for v in values]
                    for keys in (_grams(values, depth)[0], _tokens(values)[0], np.array([_END_WORD])):
                        found.add(keys, np.zeros(len(keys), np.int64))
                    if found.size > _FLUSH:
                        found.compact()
            keys, _ = found.compact()
            return pa.table([pa.array(np.full(len(keys), block, np.int64)), pa.array(keys)], ["block", "key"])

        def by_block(texts: pa.Table, table: pa.Table) -> pa.Table:
            grams, words = split(table.column("key").to_numpy(), table.column("value").to_numpy())
            parts = [
                out(part, values, grams, words)
                for batch in texts.to_batches()
                for part, values in slices(batch, "text", 2 << 20)
            ]
            return pa.Table.from_batches(parts)

        wanted = rows.select("block", "text").groupBy("block").applyInArrow(needs, "block long, key long")
        wanted = wanted.join(model, "key")
        scored = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(by_block, _COLUMNS)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


QUERIES = {"op9_context_tree": op9_context_tree}
SQL: dict[str, str] = {}
