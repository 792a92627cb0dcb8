import math
import re
import zlib
from collections import Counter

import numpy as np

from weft.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), symbols, dup, len(covered), failed)


def brute_features(text):
    tokens = [zlib.crc32(t) for w in text.encode().split() for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20]", w)]
    m, x = 0x9E3779B97F4A7C15, 1 << 64
    one = [t * m % x >> 48 for t in tokens]
    two = [((a * m % x) ^ (b + 0x632BE59BD9B4E019) % x) * m % x >> 48 for a, b in zip(tokens, tokens[1:])]
    return one + two


def corpus():
    rng = np.random.default_rng(4)
    good = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "of", "the"]
    rows = []
    for i in range(160):
        ws = list(rng.choice(good, int(rng.integers(15, 70))))
        if i % 4 == 3:
            ws = [w + "###" if rng.random() < 0.7 else w for w in ws]
        for k in range(0, len(ws), 9):
            ws[k] += "\n"
        rows.append((i, " ".join(ws)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one two three four five six seven eight nine " * 30)]
    rows += [(204, "a b\na b\n\n \na b\nc " + "x y z é " * 3), (5, "repeated row " * 12), (5, "repeated row " * 12)]
    rows += [(None, "no id " * 12), (205, "long " + " ".join(f"w{i % 5000}" for i in range(60000)))]
    return rows


def test_judge(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS kept", "7 AS extra")
    labels = [(i, 0 if i % 4 == 3 else 1, 0) for i in range(160)] + [(3, 0, 0), (9, 1, 1), (None, 1, 0), (10, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ratio, least = quality.fit(docs, labels)
    raw = Counter(f for _, t in rows for f in brute_features(t or ""))
    fits = {r["doc_id"] for r in quality._labelled(labels, quality.SAMPLE).collect() if r["role"] == 1}
    target = Counter(f for d, t in rows if d in fits for f in brute_features(t or ""))
    total = [sum(c.values()) + quality.BUCKETS for c in (target, raw)]
    want = lambda f: math.log((target[f] + 1) / total[0]) - math.log((raw[f] + 1) / total[1])
    out = quality.judge(docs, labels)
    assert out.columns == ["doc_id", "text", "extra", *[c.split()[0] for c in quality._COLUMNS.split(", ")]]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r[3:9] == brute_base(r.text), r.doc_id
        fs = brute_features(r.text or "")
        score = sum(map(want, fs)) / max(len(fs), 1)
        assert abs(score - r.score) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= least)
    verdicts = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 160 and not r.base_failed}
    assert np.mean([v == (d % 4 != 3) for d, v in verdicts.items()]) > 0.97


def test_all_labels_by_broadcast_or_join(spark, monkeypatch):
    many = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    assert quality._labelled(many, quality.SAMPLE).count() == 20_000
    # Of 20,000 rows, one text a word; each word of a fitting row is in the target.
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 2 = 1, 'good', 'bad') || repeat(' x', 25) AS text")
    docs = docs.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'null id' AS text"))
    ratio, least = quality.fit(docs, many)
    good = zlib.crc32(b"good") * 0x9E3779B97F4A7C15 % (1 << 64) >> 48
    fits = quality._labelled(many, quality.SAMPLE).where("role = 1").count()
    target, raw = fits * (26 + 25) + quality.BUCKETS, 20_000 * (26 + 25) + 2 + 1 + quality.BUCKETS
    assert abs(ratio[good] - (math.log((fits + 1) / target) - math.log(10_001 / raw))) < 1e-9
    monkeypatch.setattr(quality, "BROADCAST", 0)
    again, edge = quality.fit(docs, many)
    assert (again == ratio).all() and edge == least


def test_no_labels_keeps_all_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert [r.kept for r in quality.judge(docs, labels).collect()] == [True]
    assert quality.judge(docs.where("doc_id < 0"), labels).count() == 0


def test_threshold():
    assert quality.threshold({(5, 2): 3}) == float("-inf")
    assert abs(quality.threshold({(10, 2): 5, (2, 3): 5}) - 7 * quality.BIN) < 1e-9
