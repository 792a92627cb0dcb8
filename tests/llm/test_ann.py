import numpy as np
import pandas as pd

from weft.llm import ann


def test_visit_is_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = ann.visit(a, b, np.ones(35, int), 35)
    assert got == sorted(range(35), key=lambda c: -(a[c // 5] + b[c % 5]))
    assert ann.visit(a, b, np.full(35, 10), 25) == got[:3]


def nearest(ids, x, q, qid, k):
    at = [i for i in range(len(ids)) if ids[i] != qid]
    at.sort(key=lambda i: (-float((x[i] * q).sum()), ids[i]))
    return [(ids[i], float((x[i] * q).sum())) for i in at[:k]]


def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]  # a third is one vector
    out = [(i, x[i].tolist()) for i in range(600)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1020, [float("nan")] * 8), (1040, [1.0, None] * 4)]
    odd += [(1060, [float("inf")] + [1.0] * 7), (1080, [1.0, 2.0]), (None, [1.0] * 8), (20, x[20].tolist())]
    return out, odd


def test_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    good, odd = rows()
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "'x' AS rank")
    ids = [r[0] for r in good] + [20]
    x = np.array([r[1] for r in good] + [odd[-1][1]], np.float64)
    # All cells visited: exact. A share of them: most of the true neighbours.
    out = ann.search(df, df.where("vec_id % 20 == 0"), k=20, cells=6, fraction=1.0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        assert found == nearest(ids, x, x[q], q, 20)
    out = ann.search(df, df.where("vec_id % 20 == 0"), k=20, cells=6, fraction=0.6).collect()
    hits = [r.vec_id in dict(got[r.query_id]) for r in out]
    assert len(out) == 600 and np.mean(hits) >= 0.85


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    data = df.toPandas()
    x = np.array(data.embedding.tolist(), np.float64)
    out = ann.op6_multi_index(spark, "/root/testdata/sf0.1").toPandas()
    recall = []
    for q, g in out.groupby("query_id"):
        at = int(np.flatnonzero(data.vec_id == q)[0])
        want = {v for v, _ in nearest(data.vec_id.tolist(), x, x[at], q, 20)}
        recall.append(len(want & set(g.vec_id)) / 20)
    assert len(recall) == 100 and np.mean(recall) >= 0.9


def test_recall_at_fifty_thousand(spark):
    """At the share that op6 visits, on vectors without clusters, which are the hardest."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()})).repartition(8)
    asked = np.arange(0, 50_000, 500)
    out = ann.search(df, df.where("vec_id % 500 == 0")).toPandas()
    score = x[asked].astype(np.float64) @ x.astype(np.float64).T
    score[np.arange(100), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    found = {q: set(g.vec_id) for q, g in out.groupby("query_id")}
    assert len(out) == 2000
    assert np.mean([len(found[q] & set(b)) / 20 for q, b in zip(asked, best, strict=True)]) >= 0.9


def test_few_and_empty(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    out = ann.search(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in out] == [(1, 2, 3.0), (2, 3, 3.0)]
    assert ann.search(df.where("vec_id < 0"), df).count() == 0
    assert ann.search(df, df.where("vec_id < 0")).count() == 0
