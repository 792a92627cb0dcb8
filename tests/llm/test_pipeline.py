"""run() on a small corpus, every stage held against brute force on the stage's own input."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from test_near_dup import brute as brute_classes
from test_quality import brute_base, brute_features
from test_secrets import BASE, LIVE
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import mixing, quality, tokens
from weft.llm.common import materialize


def corpus():
    rng, rows = np.random.default_rng(11), []
    for i in range(110):
        ws = [f"word{x}" for x in rng.integers(0, 3000, int(rng.integers(25, 160)))]
        if i % 9 == 0:
            ws = [w + "###" for w in ws]
        if i % 10 == 3:
            ws.insert(5, "password=hunter22secret")
        if i == 14:
            ws.insert(7, LIVE)
        rows.append((i, " ".join(ws), "en", f"src{i % 5 if i % 3 else 0}", 0))
        if i % 8 == 1:
            ws[len(ws) // 2] = "edited"
            rows.append((1000 + i, " ".join(ws), "en", "src1", 0))
        if i % 11 == 2:
            rows.append((2000 + i, " ".join(ws), "fr", "src2", 0))
    rows += [(5000, None, None, None, None), (5001, "too short", "en", "src0", 0)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s, _ in rows]


def redacted(text):
    spans = sorted((m.start(), m.end()) for p, g, n in BASE for m in re.finditer(p, text) if len(m.group(g)) >= n)
    at = text.find(LIVE)
    spans = sorted([*spans, (at, at + len(LIVE))]) if at >= 0 else spans
    out, last = "", 0
    for a, b in spans:
        if a >= last:
            out += text[last:a] + "[secret]"
        last = max(last, b)
    return out + text[last:]


def test_stages(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = corpus()
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 0 if "###" in (t or "") else 1, 0) for d, t, *_ in rows if d < 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    ratio, least = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        outs.append([tuple(r) for r in docs.collect()])
    assert all(r[4] == (None if r[1] is None else len(r[1])) for out in outs[:4] for r in out)

    def verdict(t):
        fs = brute_features(t or "")
        return not brute_base(t)[5] and sum(ratio[f] for f in fs) / max(len(fs), 1) >= least

    assert math.isfinite(least)
    assert sorted(outs[0]) == sorted(r for r in rows if verdict(r[1]))
    assert 70 < len(outs[0]) < len(rows) and not any("###" in r[1] for r in outs[0])

    before = sorted(outs[0])
    firsts = {before[c][0] for c in brute_classes([r[1] for r in before])}
    assert sorted(outs[1]) == [r for r in before if r[0] in firsts] and len(outs[1]) < len(before)

    want = sorted((d, redacted(t), lang, s, len(redacted(t))) for d, t, lang, s, _ in outs[1])
    assert sorted(outs[2]) == want and sum("[secret]" in r[1] for r in want) > 5

    copies = Counter(outs[3])
    assert set(copies) <= set(outs[2]) and max(copies.values()) <= 2
    sizes = Counter()
    for r in outs[2]:
        sizes[r[3]] += len(r[1].split())
    goal = mixing.targets(list(sizes.items()), mixing.WEIGHTS, Fraction(3, 2), 2)
    for s in sizes:
        taken = sum(n * len(r[1].split()) for r, n in copies.items() if r[3] == s)
        assert abs(taken - goal[s]) <= 80

    plain = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    ids = {r[0]: plain.encode(r[1], add_special_tokens=False).ids + [1] for r in copies}
    times = {r[0]: n for r, n in copies.items()}
    pieces = Counter()
    for doc, start, length, data, total, *_ in outs[4]:
        got = np.frombuffer(data, "<u4").tolist()
        assert got == ids[doc][start : start + length] and total == len(ids[doc])
        pieces[doc] += length
    assert pieces == {d: n * len(ids[d]) for d, n in times.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(outs[4])
