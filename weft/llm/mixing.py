"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target size; a document is taken floor(p) times plus once more with probability p - floor(p),
where p = target / source size (at most `most`). The extra copies are a balanced sample: the cube method moves the
vector of inclusion probabilities through the null space of the balance constraints (document count and total size),
so both totals stay put while probabilities reach 0 or 1. A flight over any block ends with at most two fractional
units; those of all blocks of a source fly again, level by level, until one block is left, whose last units (the
landing problem) are rounded to the subset whose size is nearest to what is left of the target.

A block is a hash range of one source's documents, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read, ship

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Documents in a flight block: bounds a task's rows.
BLOCK = 20_000
#: Units that each block hands on to the next level undecided, besides the two that its flight leaves.
HOLD = 256


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: Fraction, most: int) -> dict:
    """Target of each source: `share` of all sizes by weight; what is above `most` times a source's size goes to the
    others by weight, until none is above. Exact fractions, so no rounding decides who is above."""
    ranked = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    size = dict(ranked)
    left, open_, out = share * sum(size.values()), {s for s in size if size[s] > 0}, {s: Fraction(0) for s in size}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > most * size[s] * total]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * size[s])
            left -= out[s]
            open_.discard(s)
    return out


def _random(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed & 0xFFFFFFFFFFFF))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube-method flight under the constraints sum(p) and sum(p * size): returns p with at most two values strictly
    between 0 and 1 (a few more only where rounding leaves them within 1e-9 of a bound, which are snapped)."""
    p = p.astype(np.float64).copy()
    eps = 1e-9
    s = size.astype(np.float64).tolist()
    v = p.tolist()
    draw = iter(rng.random(3 * len(v) + 16).tolist())
    live: list[int] = []
    for i in range(len(v)):
        if not eps < v[i] < 1 - eps:
            v[i] = float(round(v[i]))
            continue
        live.append(i)
        while len(live) >= 3:
            a, b, c = live
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # orthogonal to (1, 1, 1) and to the sizes
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, d in zip(live, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - v[k]) / d), min(down, v[k] / d)
                elif d < 0:
                    up, down = min(up, v[k] / -d), min(down, (1 - v[k]) / -d)
            step = up if next(draw) * (up + down) < down else -down
            keep = []
            for k, d in zip(live, u, strict=True):
                v[k] += step * d
                if eps < v[k] < 1 - eps:
                    keep.append(k)
                else:
                    v[k] = float(round(v[k]))
            live = keep
    return np.array(v)


def landing(size: np.ndarray, p: np.ndarray, due: float) -> np.ndarray:
    """Round the few fractional units to the subset whose size is nearest to `due` (ties: fewer units first). What
    still misses the total is made up by exchanging a taken and an untaken unit of the block, while that helps."""
    out = np.round(p)
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if not len(open_):
        return out
    out[open_] = 0
    subsets = sorted(range(1 << len(open_)), key=lambda m: (m.bit_count(), m))
    chosen = lambda m: sum(float(size[k]) for j, k in enumerate(open_) if m >> j & 1)
    best = min(subsets, key=lambda m: abs(chosen(m) - due))
    for j, k in enumerate(open_):
        out[k] = best >> j & 1
    miss = due - chosen(best)
    for _ in range(200):
        yes, no = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if abs(miss) < 1 or not len(yes) or not len(no):
            break
        no = no[np.argsort(size[no], kind="stable")]
        at = np.searchsorted(size[no], size[yes] + miss)
        pairs = [(yes, no[np.clip(at + d, 0, len(no) - 1)]) for d in (-1, 0)]
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        left = np.abs(miss - (size[b] - size[a]))
        k = int(np.argmin(left))
        if left[k] >= abs(miss):
            break
        out[a[k]], out[b[k]] = 0.0, 1.0
        miss -= float(size[b[k]] - size[a[k]])
    return out


def _fly(last: bool, hold: int):
    """hold: units of each block that wait for the next level, so that the last block has enough to land well."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        size, p = block.column("size").to_numpy(), block.column("p").to_numpy()
        seed = block.column("order")[0].as_py() * 31 + block.column("src")[0].as_py()
        fly = len(p) if last else max(0, len(p) - hold)
        out = np.concatenate([flight(size[:fly], p[:fly], _random(seed)), p[fly:]])
        if last:
            done = np.isin(out, (0.0, 1.0))
            # The landing makes up for the size that is due to the units still open.
            out = landing(size, out, float((out * size)[~done].sum()))
        columns = [block.column(c) for c in ("doc_id", "src", "size", "order")]
        return pa.table([*columns, pa.array(out, pa.float64())], ["doc_id", "src", "size", "order", "p"])

    return run


def cube_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units(doc_id, src int, size long, order long, p double in (0, 1)) with p moved to 0 or 1; doc_id of any type that
    has an order.

    Balanced within each src on the count and on the sum of sizes. Levels of flights: each level's blocks hold about
    `block` units of one src; what stays fractional (two a block and HOLD that wait) goes on to the next level.
    """
    spark = units.sparkSession
    ship(spark)
    state, done = units.select("doc_id", "src", "size", "order", "p"), []
    schema = state.schema

    def count() -> dict[int, int]:  # a row a source
        return {r["src"]: r["n"] for r in state.groupBy("src").agg(F.count("*").alias("n")).collect()}

    counts = count()
    while True:
        last = all(n <= block for n in counts.values())
        spread = spark.createDataFrame([(s, -(-n // block)) for s, n in counts.items()], "src int, spread long")
        place = F.pmod(F.xxhash64("order", F.lit(len(done))), F.col("spread"))
        keyed = state.join(spread, "src").select(*state.columns, place.alias("blk"))
        state = materialize(keyed.groupBy("src", "blk").applyInArrow(_fly(last, min(HOLD, block // 8)), schema))
        if last:
            done.append(state)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~open_))
        state = state.where(open_)
        counts = count()
        if not counts:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _each(groups: DataFrame, chunk: int = 4096) -> DataFrame:
    """groups(..., n) as n rows each, numbered from 0 in `nth`; large groups by chunks that are dealt out first."""
    rest = [c for c in groups.columns if c != "n"]
    upto = F.least(F.col("at") + chunk, F.col("n")) - 1
    few = groups.where(F.col("n") <= chunk).withColumn("at", F.lit(0).cast("long"))
    many = groups.where(F.col("n") > chunk)
    many = many.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    cut = few.unionByName(many.repartition("at", *rest))
    return cut.select(*rest, F.explode(F.sequence(F.col("at"), upto)).alias("nth"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies of each document in the mix.

    Returns doc_id, source, size (words), source_size, target (the source's), copies (0 to `most`), taken
    (copies * size). Null text has size 0; null source is a source of its own, last in rank; repeated rows are units
    of their own; null ids stay. Documents of size 0 cost nothing: they are taken floor(p) times. An empty table gives
    no rows. Sources are rows of a driver-side table: one row a source, not a document.

    The draw depends on the rows alone, not on how they are dealt: sources are numbered by rank, and rows equal in id,
    source and size are counted before they are numbered, so that they too spread over all blocks.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"))
    base = materialize(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sizes = base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).collect()
    sizes = sorted(((r["source"], r["size"]) for r in sizes), key=lambda s: (s[0] is None, s[0] or ""))
    goal = targets(sizes, weights, Fraction(*share), most)
    rows = []
    for i, (s, n) in enumerate(sizes):
        p = goal[s] / n if n else Fraction(0)
        rows.append((s, i, n, float(goal[s]), int(p), float(p - int(p))))
    plan = spark.createDataFrame(
        rows, "source string, src int, source_size long, target double, whole int, p double"
    )  # one row a source; Spark broadcasts it only below its own threshold
    named = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    named = _each(named.select("doc_id", "size", "src", "p", "n"))
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    units = named.where(drawn).withColumn("order", F.xxhash64("doc_id", "size", "nth"))
    picked = cube_sample(units, block).select("doc_id", "src", "size", F.col("p").cast("int").alias("extra"))
    fixed = named.where(~drawn).select("doc_id", "src", "size", F.lit(0).alias("extra"))
    return (
        picked.unionByName(fixed)
        .join(plan.drop("p"), "src")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("whole") + F.col("extra")).alias("copies"),
            ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
        )
    )


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it (rows equal in all columns as one group).

    Rows meet their copies by two hashes of 64 bits over all columns, with their nulls marked (columns of maps, which
    have no hash, take no part)."""
    columns = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = [*columns, *(F.col(c).isNull() for c in columns)]
    row_key = F.concat_ws(":", F.xxhash64(F.lit(1), *whole), F.xxhash64(F.lit(2), *whole))
    key, times, nth = (fresh(docs.columns, c) for c in ("key", "copies", "copy"))
    copies = mix(docs.select(row_key.alias("doc_id"), "text", "source"))
    copies = copies.groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").cast("int").alias(times)).where(F.col(times) > 0)
    kept = docs.withColumn(key, row_key).join(copies, key).dropDuplicates([key])
    again = F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)
    return kept.select(*(f"`{c}`" for c in docs.columns), again).drop(nth)


QUERIES = {"op1_cube_mix": op1_cube_mix}
SQL: dict[str, str] = {}
