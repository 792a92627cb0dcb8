from fractions import Fraction

import numpy as np

from weft.llm import mixing


def brute_targets(sizes, weights):
    """Pour the total in small equal-weight drops until it is used up, a capped source taking no more."""
    ranked = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    size = dict(ranked)
    got, left = dict.fromkeys(size, 0.0), 1.5 * sum(size.values())
    for _ in range(200):
        free = [s for s in size if got[s] < 2 * size[s] - 1e-9]
        if left < 1e-9 or not free:
            break
        drop = min((2 * size[s] - got[s]) / w[s] for s in free)
        drop = min(drop, left / sum(w[s] for s in free))
        for s in free:
            got[s] += drop * w[s]
            left -= drop * w[s]
    return got


def test_targets_match_pouring():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 20):
        sizes = [(f"s{i}", int(x)) for i, x in enumerate(rng.integers(1, 5000, n))] + [(None, 40), ("é", 0)]
        out = mixing.targets(sizes, (3, 1, 2), Fraction(3, 2), 2)
        want = brute_targets(sizes, (3, 1, 2))
        assert all(abs(float(out[s]) - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 2000):
        size = rng.integers(1, 9000, n)
        p = np.full(n, 0.37)
        out = mixing.flight(size, p, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - p.sum()) < 1e-6 * n + 1e-6
        assert abs((out * size).sum() - (p * size).sum()) < 1e-5 * (size.sum() + 1)


def test_flight_is_unbiased():
    size = np.array([5, 80, 13, 200, 7, 41, 41, 90, 3, 60])
    p = np.full(10, 0.3)
    runs = np.mean([mixing.flight(size, p, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(runs - 0.3).max() < 0.035


def docs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(1, 60)))), "ab"[i % 2] if i % 3 else "hot") for i in range(900)]
    rows += [(7, "repeated row", "a")] * 2 + [(5000, None, "a"), (5001, "", None), (5002, "x y", None), (None, "no id", "b")]
    rows += [(6000, "w " * 1500, "hot")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'z' AS target")


def test_mix(spark):
    out = mixing.mix(docs(spark), block=100).toPandas()
    assert len(out) == 907
    assert (out.taken == out.copies * out["size"]).all() and out.copies.between(0, 2).all()
    for _, g in out.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5 * g["size"].max() + 1
    again = mixing.mix(docs(spark).repartition(7), block=100).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_large_ids_and_equal_rows(spark):
    rows = [(2**53 + 2 * i + 1, "w " * (1 + i % 7), "a") for i in range(60)] + [(None, "w w", "a"), (3, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.size) for r in mixing.mix(df).collect())
    assert got == sorted((d or 0, len(t.split())) for d, t, _ in rows)
    same = spark.range(100_000).selectExpr("5L AS doc_id", "'one two three' AS text", "'hot' AS source")
    other = spark.range(400).selectExpr("id + 10 AS doc_id", "repeat('w ', cast(id % 50 as int)) AS text", "'z' AS source")
    out = mixing.mix(same.unionByName(other), weights=(1, 3)).toPandas()
    assert len(out) == 100_400
    hot = out[out.source == "hot"]
    assert abs(hot.taken.sum() - hot.target.iloc[0]) <= 4


def test_each_splits_large_groups(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 10), ("c", 25), (None, 11)], "k string, n long")
    got = sorted(((r.k or ""), r.nth) for r in mixing._each(groups, chunk=10).collect())
    assert got == sorted((k, i) for k, n in (("a", 1), ("b", 10), ("c", 25), ("", 11)) for i in range(n))
