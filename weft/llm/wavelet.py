"""Token ids in wavelet-matrix shard files.

A shard holds the ids of consecutive documents as bit-planes, highest bit first; below each plane the ids are stably
split into those with a 0 and those with a 1 there. With a rank directory beside each plane, the file answers access
(the id at a place), rank (how often an id occurs before a place) and select (where its k-th occurrence is) without
being decoded; whole shards decode plane by plane with sequential reads only.

File: 8 bytes of magic, the length of the header (uint32), the header (zlib'd JSON), the documents' ids, lengths and
nulls (zlib'd), then for each plane the packed bits and the counts of ones before every 512th bit (uint32).
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, shared_dir, ship, slices
from .tokens import encoder, public_path

MAGIC = b"WEFTWM01"
#: Ids from which on a shard is closed; a document is never split, so only one of more ids makes a larger shard.
SHARD_IDS = 2_000_000
_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint32)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            mask = ((cur >> level) & 1).astype(bool)
            bits = np.packbits(mask, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (_BLOCK // 8), np.uint8)])
            ones = _ONES[bits].reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.uint64)
            planes.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            cur = np.concatenate([cur[~mask], cur[mask]])
            zeros.append(int(len(mask) - mask.sum()))
        return cls(len(ids), planes, ranks, zeros)

    def _rank1(self, level: int, at: int) -> int:
        """Ones before place `at` of the plane."""
        block, plane = at // _BLOCK, self.planes[level]
        first = block * (_BLOCK // 8)
        out = int(self.ranks[level][block]) + int(_ONES[plane[first : at // 8]].sum())
        if at % 8:
            out += int(_ONES[plane[at // 8] & ((1 << at % 8) - 1)])
        return out

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[at // 8]) >> (at % 8) & 1
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        levels = len(self.planes)
        if symbol < 0 or symbol >> levels:
            return 0, 0
        for level in range(levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if symbol >> (levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, symbol: int, at: int) -> int:
        return self.count(symbol, 0, at)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        first = block * (_BLOCK // 8)
        bits = np.unpackbits(self.planes[level][first : first + _BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            if at >= self.zeros[level]:
                at = self._select_bit(level, 1, at - self.zeros[level])
            else:
                at = self._select_bit(level, 0, at)
        return at

    def decode(self) -> np.ndarray:
        cur = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            mask = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(cur)
            out[~mask] = cur[: self.zeros[level]]
            out[mask] = cur[self.zeros[level] :] | cur.dtype.type(1 << (len(self.planes) - 1 - level))
            cur = out
        return cur.astype(np.uint32)


def to_bytes(wm: WaveletMatrix, doc_ids: list, lengths: np.ndarray) -> bytes:
    nulls = np.array([d is None for d in doc_ids], bool)
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    docs = zlib.compress(ids.tobytes() + np.asarray(lengths, np.int64).tobytes() + nulls.tobytes(), 1)
    head = {"n": wm.n, "docs": len(doc_ids), "doc_bytes": len(docs), "zeros": wm.zeros}
    head |= {"plane_bytes": [len(p) for p in wm.planes], "rank_bytes": [4 * len(r) for r in wm.ranks]}
    packed = zlib.compress(json.dumps(head).encode())
    planes = [x for p, r in zip(wm.planes, wm.ranks, strict=True) for x in (p.tobytes(), r.astype("<u4").tobytes())]
    return b"".join([MAGIC, len(packed).to_bytes(4, "little"), packed, docs, *planes])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, doc ids, lengths) of a shard file; the planes stay views of the file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = 12 + int.from_bytes(data[8:12], "little")
    head = json.loads(zlib.decompress(data[12:at]))
    docs, n = zlib.decompress(data[at : at + head["doc_bytes"]]), head["docs"]
    at += head["doc_bytes"]
    ids, lengths = np.frombuffer(docs, np.int64, n), np.frombuffer(docs, np.int64, n, 8 * n)
    nulls = np.frombuffer(docs, bool, n, 16 * n)
    planes, ranks = [], []
    for p, r in zip(head["plane_bytes"], head["rank_bytes"], strict=True):
        planes.append(np.frombuffer(data, np.uint8, p, at))
        ranks.append(np.frombuffer(data, "<u4", r // 4, at + p))
        at += p + r
    named = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)]
    return WaveletMatrix(head["n"], planes, ranks, head["zeros"]), named, lengths


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    chunks: str = "spaced",
    end_id: int = 0,
    shard_ids: int = SHARD_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every document, append end_id, and write shard files to `folder` (any URI that pyarrow.fs opens) in
    ascending order of id (null first; equal ids by text). Returns the manifest: part, shard, path, docs, ids.

    Null text is empty. A file is written under another name and moved, so a task that runs twice leaves one file.
    """
    ship(docs.sparkSession)

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base)
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, chunks, end_id)
        names, lengths, ids, held, shard = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            wm = WaveletMatrix.build(np.concatenate(ids))
            path = f"{base}/part-{part:07d}-{shard:05d}.wm"
            own = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
            with store.open_output_stream(own) as f:
                f.write(to_bytes(wm, names, np.array(lengths)))
            store.move(own, path)
            row = ([part], [shard], [path], [len(names)], [held])
            return pa.record_batch(list(row), names=["part", "shard", "path", "docs", "ids"])

        for batch in batches:
            for sub, values in slices(batch, "text"):
                got, ends = enc.encode([v.decode("utf-8", "replace") for v in values])
                ids.append(got.astype(np.uint32))
                names += sub.column(0).to_pylist()
                lengths += np.diff(ends, prepend=0).tolist()
                held += len(got)
                if held >= shard_ids:
                    yield close()
                    names, lengths, ids, held, shard = [], [], [], 0, shard + 1
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The text's hash lets a range be cut within one id, should an id hold many rows.
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return materialize(ranged.mapInArrow(run, "part long, shard long, path string, docs long, ids long"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32) from the shard files."""
    spark = manifest.sparkSession
    per_part = manifest.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()  # a row a partition
    before, rows = 0, []
    for r in per_part:
        rows.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "part long, part_start long")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("in_part", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).join(offsets, "part")
    files = placed.select("path", (F.col("part_start") + F.col("in_part")).alias("first"))

    def run(batches):
        store, _ = _open(folder)
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as f:
                    wm, names, lengths = from_bytes(f.read())
                ids, ends = wm.decode(), np.cumsum(lengths)
                starts = ends - lengths
                at = 0
                while at < len(names):
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), side="right")))
                    data = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[at:to], ends[at:to], strict=True)]
                    yield pa.record_batch(
                        [
                            pa.array(names[at:to], pa.int64()),
                            pa.array(starts[at:to] + first, pa.int64()),
                            pa.array(lengths[at:to], pa.int64()),
                            pa.array(data, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = to

    # A file is a task's work, however small the manifest's rows are.
    spread = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    manifest = write_shards(read(spark, sf_dir, "documents"), folder, public_path("byte_bpe_50k.json"))
    return read_shards(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_wavelet_tokens": op8_wavelet_tokens}
SQL: dict[str, str] = {}
