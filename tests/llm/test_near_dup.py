import hashlib

import numpy as np
import pytest

from weft.llm import near_dup as nd
from weft.operators.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_against_brute_force():
    rng = np.random.default_rng(0)
    seen = set()
    for _ in range(250):
        n = int(rng.integers(0, 60))
        a = rng.integers(0, 30, n).astype(np.uint16)
        b = a.tolist()
        for _ in range(int(rng.integers(0, 2 + n // 3))):
            at, kind = int(rng.integers(0, len(b) + 1)), rng.integers(0, 3)
            b[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(0, 30))]
        b = np.array(b, np.uint16)
        d, most = distance(a.tolist(), b.tolist()), max(len(a), len(b)) // 5
        assert nd.alike(nd.Bag(a), nd.Bag(b)) == (d <= most)
        seen.add(d <= most)
        for f in (nd._band, nd._rows_band):
            full = max(len(a), len(b), 1)
            assert f(a, b, full, full) == d
            narrow = f(a, b, 3, full)
            assert narrow is None or narrow >= d
    assert seen == {True, False}


def test_sketch_finds_edited_copies_and_order_matters():
    rng = np.random.default_rng(1)
    hits, swapped = [], []
    for _ in range(60):
        a = rng.integers(0, 1 << 60, 300).astype(np.uint64)
        b = a.copy()
        b[rng.choice(300, 10, replace=False)] += np.uint64(1)
        hits.append((nd.sketch(a) == nd.sketch(b)).sum())
        swapped.append((nd.sketch(a) == nd.sketch(np.roll(a, 150))).sum())
    assert min(hits) >= 3
    assert np.mean(swapped) < 0.6 * nd.SKETCHES  # a set of runs would agree in nearly all


def text(rng, n):
    return [f"w{x}" for x in rng.integers(0, 4000, n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(words))), rng.integers(0, 3)
        words[at : at + (kind != 0)] = [] if kind == 1 else [f"e{rng.integers(0, 10**6)}"]
    return words


def fixture():
    rng, rows = np.random.default_rng(7), []
    base = [text(rng, int(n)) for n in rng.integers(40, 300, 40)]
    passage = text(rng, 60)
    for i, b in enumerate(base):
        b = b + passage if i % 2 else b  # half share a passage
        rows.append(" ".join(b))
        if i % 4 == 0:
            rows += [" ".join(b)] * 3
        if i % 5 == 0:
            rows += [" ".join(edited(rng, b, len(b) // 25)).upper() + "." for _ in range(2)]
    hot = text(rng, 120)
    rows += [" ".join(edited(rng, hot, 3)) for _ in range(60)]  # one large class, all texts different
    rows += ["", "", None, " ", "one", "One.", "two words", "!!! ???"]
    rows.append(" ".join(text(rng, 30000)))
    rows.append(rows[-1] + " and more")
    return rows


def brute(rows):
    words = [(t or "").lower().encode().translate(None, nd._PUNCTUATION).split() for t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    runs = [set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} for w in words]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i] or "") == (rows[j] or "")
            most = max(len(words[i]), len(words[j])) // 5
            if same or words[i] and words[j] and abs(len(words[i]) - len(words[j])) <= most and runs[i] & runs[j]:
                if same or len(words[i]) > 2000 or distance(words[i], words[j]) <= most:
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("small", [12, 2])
def test_classes(spark, monkeypatch, small):
    monkeypatch.setattr(nd, "SMALL", small)
    rows = fixture()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS key", "2 AS h")
    out = nd.classes(df.repartition(3)).collect()
    got = {r.doc_id: r.class_id for r in out}
    assert len(out) == len(rows) and got == dict(enumerate(brute(rows)))
    assert all(r.h == hashlib.md5((rows[r.doc_id] or "").encode()).digest() for r in out)


def test_ids_and_stage(spark):
    rows = [(5, "a b c d e f g", 1), (5, "a b c d e f g", 1), (None, "a b c d e f g", 2), (3, "x y z", 3), (3, "other", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    out = nd.classes(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in out if r.doc_id) == [(3, 3), (3, 3), (5, 5), (5, 5)]
    assert sorted(r.class_id == 5 for r in out if r.doc_id is None) == [False, True]
    assert len({r.label for r in out}) == 4  # two texts under one id are not one class
    kept = nd.stage(spark, df.selectExpr("*", "'x' AS weft_h"), "").collect()
    assert kept[0].__fields__ == ["doc_id", "text", "n", "weft_h"]
    assert sorted(r.text or "" for r in kept) == ["", "a b c d e f g", "other", "x y z"]
    assert [r.doc_id for r in kept if r.text == "a b c d e f g"] == [5]
    assert nd.classes(df.where("n > 9")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in range(101, 150)] + [(7, 7)]
    edges += [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 80, (50, 2))]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    loops = {a for a, b in edges if a == b and not any((x == a) != (y == a) for x, y in edges if x != y)}
    assert got == {x: c for x, c in want.items() if x not in loops}


def linked(rows):
    """Least row of each row's class, by all pairs of texts, whatever runs they share."""
    words = [(t or "").lower().encode().translate(None, nd._PUNCTUATION).split() for t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n, m = len(words[i]), len(words[j])
            most = max(n, m) // 5
            if rows[i] == rows[j] or n and m and abs(n - m) <= most and distance(words[i], words[j]) <= most:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def got_classes(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [c for _, c in sorted((r.doc_id, r.class_id) for r in nd.classes(df).collect())]


def test_texts_of_frequent_passages(spark):
    rng, rows = np.random.default_rng(11), []
    passages = [text(rng, 12) for _ in range(14)]
    chosen = [np.sort(rng.choice(14, 7, replace=False)) for _ in range(200)]
    for i, c in enumerate(chosen + chosen[:40] + [np.sort(rng.choice(14, 7, replace=False)) for _ in range(160)]):
        # Runs inside a passage are held by many others, those at its ends by no other text.
        rows.append(" ".join(w for p in c for w in [*passages[p], f"own{i}x{p}"]))
    keys, want = [nd.Bag(k) for k in nd.word_keys([r.encode() for r in rows])], list(range(len(rows)))
    links = [(j, i) for i in range(len(rows)) for j in range(i) if nd.alike(keys[j], keys[i])]
    for _ in rows:
        for j, i in links:
            want[i] = want[j] = min(want[i], want[j])
    assert len(links) >= 40 and got_classes(spark, rows) == want


def test_edits_at_any_places(spark):
    rng, rows = np.random.default_rng(12), []
    for n in (5, 6, 10, 10, 15, 20, 25, 40, 60, 100, 150):
        for edits in (n // 10, n // 5):
            even, some = text(rng, n), text(rng, n)
            rows.append(" ".join(even))
            at = set(np.arange(n // edits // 2, n, n // edits)[:edits]) if edits else set()
            rows.append(" ".join(f"x{i}" if i in at else w for i, w in enumerate(even)))
            rows += [" ".join(some), " ".join(edited(rng, some, edits))]
    rows += ["a b c d E f g h i j", "a b c d e f g h i j", "one two", "one too", "one"]
    want = linked(rows)
    assert len(set(want)) < len(rows) * 0.6 and got_classes(spark, rows) == want


@pytest.mark.parametrize("block", [500, 25])
def test_long_passage_of_many_texts(spark, monkeypatch, block):
    """Texts that are mostly one passage: some are alike by what little they add, most are not."""
    monkeypatch.setattr(nd, "FREQUENT", 4)
    monkeypatch.setattr(nd, "HEAVY", block)
    compared = []
    heavy = nd._heavy
    monkeypatch.setattr(nd, "_heavy", lambda rows: compared.append(rows.where("part = -1").count()) or heavy(rows))
    rng, passage = np.random.default_rng(13), None
    passage = text(rng, 60)
    rows = [" ".join([*passage, *text(rng, int(n))]) for n in rng.integers(8, 32, 90)]
    rows += [" ".join([*edited(rng, r.split(), 4)]) for r in rows[:15]]
    assert got_classes(spark, rows) == linked(rows) and compared[0] > 60


def test_rarest_grams_meet():
    """Texts that are alike have _common of their rarest grams in common, whatever the counts are."""
    rng = np.random.default_rng(14)
    alike = 0
    for _ in range(3000):
        n = int(rng.integers(1, 70))
        a = rng.integers(0, int(rng.choice([4, 30, 3000])), n).astype(np.uint32)
        b = a.tolist()
        for _ in range(int(rng.integers(0, 2 + n // 5))):
            at, kind = int(rng.integers(0, len(b) + 1)), rng.integers(0, 3)
            b[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(0, 3000))]
        b = np.array(b, np.uint32)
        if not len(b) or not nd.alike(nd.Bag(a), nd.Bag(b)):
            continue
        alike += 1
        known = np.unique(np.concatenate([nd._grams_of(a), nd._grams_of(b)]))[:: int(rng.integers(1, 4))]
        times = rng.integers(2, 9, len(known)).astype(np.int32)
        (x, _), (y, _) = nd._rarest(a, known, times), nd._rarest(b, known, times)
        assert len(np.intersect1d(x, y)) >= min(nd._common(len(a)), nd._common(len(b)))
    assert alike > 1000
