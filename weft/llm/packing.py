"""Packing documents into fixed windows by minimum bin slack.

Every document is cut at multiples of the window; full pieces are windows of their own. The remainders form a multiset
of lengths. For each window a subset-sum dynamic program over that multiset (a bitset of reachable sums, one shift per
power of two of a length's count) finds the sum closest to the window, and the counts are found by backtracking through
the stored bitsets. Slack that no subset fills is filled by cutting one more remainder, whose rest goes back to the
multiset. The last tokens of a partition, too few for a window, are cut into windows of power-of-two length, which
need no padding: so there is none at all.

One pass over each input partition, no shuffle: a worker holds at most PENDING remainders.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices
from .tokens import encoder, public_path

WINDOW = 2048
#: Remainders that a worker gathers before it packs the older half of them.
PENDING = 8192

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_length", pa.int64()),
    ]
)
_DDL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


def min_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest that is at most `room`.

    counts: length -> available. Long lengths come first, so that they are used up while short ones can still fill."""
    full, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, counts[length], reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & full
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, most, before in reversed(layers):
        k = 0
        while not before >> (total - k * length) & 1:
            k += 1
        if k:
            out[length] = k
            total -= k * length
        assert k <= most
    return out


class Packer:
    """Turns documents' ids into pieces (doc_id, start, ids, doc_tokens) placed in windows."""

    def __init__(self, window: int, pending: int, first_sequence: int):
        self.window, self.pending, self.next = window, pending, first_sequence
        self.by_length: dict[int, deque] = {}
        self.waiting = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        size, at = sum(len(p[2]) for p in pieces), 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids, total, self.next, at, size
            at += len(ids)
        self.next += 1

    def _wait(self, piece: tuple) -> None:
        self.by_length.setdefault(len(piece[2]), deque()).append(piece)
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        queue = self.by_length[length]
        piece = queue.popleft()
        if not queue:
            del self.by_length[length]
        self.waiting -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, whole = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            yield from self._emit([(doc, at, ids[at : at + self.window], n)])
        if whole < n:
            self._wait((doc, whole, ids[whole:].copy(), n))
        if self.waiting >= self.pending:
            yield from self.fill(self.pending // 2)

    def fill(self, down_to: int) -> Iterator[tuple]:
        while self.waiting > down_to:
            longest = max(self.by_length)
            pieces = [self._take(longest)]
            room = self.window - longest
            picks = min_slack({k: len(q) for k, q in self.by_length.items()}, room)
            for length, k in picks.items():
                pieces += [self._take(length) for _ in range(k)]
                room -= length * k
            if room and self.waiting:  # no subset fills it: cut what is longest
                doc, start, ids, n = self._take(max(self.by_length))
                pieces.append((doc, start, ids[:room], n))
                self._wait((doc, start + room, ids[room:], n))
                room = 0
            if room:
                yield from self._last(pieces)
            else:
                yield from self._emit(pieces)

    def _last(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Less than a window is left: cut it at powers of two, largest first."""
        left, queue = sum(len(p[2]) for p in pieces), deque(pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                doc, start, ids, n = queue.popleft()
                out.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    queue.appendleft((doc, start + room, ids[room:], n))
                room -= len(out[-1][2])
            yield from self._emit(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    cols[3] = [x.tobytes() for x in cols[3]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def pack(
    docs: DataFrame,
    tokenizer: str,
    chunks: str = "bare",
    end_id: int = 1,
    window: int = WINDOW,
    pending: int = PENDING,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in windows: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id,
    offset, sequence_length.

    Each document is its ids and then end_id; null and empty texts are that one id. Repeated rows are documents of
    their own, null ids stay null. A window holds `window` ids or, for the last of a partition, a power of two. An
    empty table gives no rows; other columns are ignored. Sequence ids hold the partition in their upper bits.
    """
    ship(docs.sparkSession)

    def run(batches):
        packer = Packer(window, pending, TaskContext.get().partitionId() << 36)
        enc, rows, held = encoder(tokenizer, chunks, end_id), [], 0
        for batch in batches:
            for part, values in slices(batch, "text"):
                ids, ends = enc.encode([v.decode("utf-8", "replace") for v in values])
                at = 0
                for doc, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    for row in packer.add(doc, ids[at:end]):
                        rows.append(row)
                        held += row[2]
                    at = end
                    if held > 1 << 19:
                        yield _batch(rows)
                        rows, held = [], 0
        rows += packer.fill(0)
        if rows:
            yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DDL)


def op2_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_length",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces in windows, with their ids."""
    return pack(docs, public_path("word_bpe_49k.json"))


QUERIES = {"op2_min_slack_packing": op2_min_slack_packing}
SQL: dict[str, str] = {}
