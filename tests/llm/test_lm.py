import math
import zlib
from collections import Counter

import pytest

from weft.llm import lm

TEXTS = ["The cat sat on the mat.", "the cat ate", "", None, "A dog; the DOG é ß\n\n x", "mat mat mat " * 40, "zzz qq", "the"]


def brute_ctw(texts, depth):
    """Sequential context-tree weighting, the textbook recursion on a tree of nodes, then scores with it at rest."""

    class Node:
        def __init__(self):
            self.n, self.lpe, self.lw, self.kids = [0, 0], 0.0, 0.0, {}

    roots = {}

    def stream(t):
        b = t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t)
        b = [255] * depth + list(b.encode()) + [255]
        for i in range(depth, len(b)):
            for j in range(8):
                yield b[i - depth : i][::-1], (j, b[i] >> (8 - j)), b[i] >> (7 - j) & 1

    def path(ctx, bits, grow):
        node = roots.setdefault(bits, Node()) if grow else roots.get(bits, Node())
        out = [node]
        for c in ctx:
            node = node.kids.setdefault(c, Node()) if grow else node.kids.get(c, Node())
            out.append(node)
        return out

    for t in texts:
        for ctx, bits, bit in stream(t):
            nodes = path(ctx, bits, True)
            for d in range(depth, -1, -1):
                x = nodes[d]
                x.lpe += math.log((x.n[bit] + 0.5) / (sum(x.n) + 1))
                x.n[bit] += 1
                if d == depth:
                    x.lw = x.lpe
                else:
                    ls = sum(k.lw for k in x.kids.values())
                    m = max(x.lpe, ls)
                    x.lw = m + math.log(0.5 * math.exp(x.lpe - m) + 0.5 * math.exp(ls - m))

    def score(t):
        total = 0.0
        for ctx, bits, bit in stream(t):
            nodes = path(ctx, bits, False)
            p = (nodes[depth].n[bit] + 0.5) / (sum(nodes[depth].n) + 1)
            for x in reversed(nodes[:-1]):
                w = 0.5 * math.exp(x.lpe - x.lw)
                p = w * (x.n[bit] + 0.5) / (sum(x.n) + 1) + (1 - w) * p
            total += math.log10(p)
        return total

    return score


@pytest.mark.parametrize(("depth", "broadcast"), [(2, 10**6), (3, 0)])
def test_scores(spark, depth, broadcast):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(24)] + [(None, "null id the"), (5, "repeated"), (5, "repeated")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'k' AS key", "2 AS block")
    out = lm.score_texts(df, depth=depth, broadcast=broadcast, block_bytes=200).collect()
    assert len(out) == len(rows)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [t or "" for d, t in rows if not held(d)]
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t).split()
    c = Counter(w for t in train for w in [*low(t), None])
    n, v = sum(c.values()), len(c)
    score = brute_ctw(train, depth)
    want = []
    for d, t in rows:
        ws = [*low(t or ""), None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        want.append((d is None, d or 0, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6), round(score(t or ""), 6)))
    got = [
        (r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in out
    ]
    assert sorted(got) == sorted(want)


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty, depth=1).count() == 0
    one = spark.createDataFrame([(1, "ab " * 400_000)], "doc_id long, text string")
    assert lm.score_texts(one, depth=1).first().n_tokens == 400_001
