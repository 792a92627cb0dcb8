import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weft.llm import packing, tokens


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 40))
def test_min_slack_is_best(counts, room):
    picks = packing.min_slack(counts, room)
    assert all(0 < k <= counts[x] for x, k in picks.items())
    sums = {sum(x * k for x, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
    assert sum(x * k for x, k in picks.items()) == max(s for s in sums if s <= room)


def test_packer_same_lengths_have_no_padding():
    p, out = packing.Packer(2048, 64, 0), []
    for d in range(500):
        out += p.add(d, np.full(1500, d, np.uint32))
    out += p.fill(0)
    sizes = {}
    for _, _, n, _, _, seq, _, _ in out:
        sizes[seq] = sizes.get(seq, 0) + n
    assert sum(sizes.values()) == 750_000
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


TEXTS = ["", None, "one", "  a  b\n\n c \t d's don't", "<|endoftext|> x", "x\x1c y\x85z ß ΑΣ ΣΑΣ é", "日本語 🙂🙂 12 345,6"]


def test_encoder_is_exact():
    texts = [t for t in TEXTS if t is not None] + ["́ ́x 's 't a  's", "\r\n\r\n x"] * 2
    for name, chunks in (("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")):
        path = tokens.public_path(name)
        enc, plain = tokens.Encoder(path, chunks, 7), Tokenizer.from_file(path)
        ids, ends = enc.encode(texts)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [plain.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_pack_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "same id"), (3, "same id"), (None, "no id")]
    rows += [(100 + i, "word other " * int(rng.integers(1, 900))) for i in range(60)] + [(999, "long text here " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS length")
    path = tokens.public_path("word_bpe_49k.json")
    out = packing.pack(df.coalesce(2), path).collect()
    plain = Tokenizer.from_file(path)
    want = sorted((d is None, d or 0, plain.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)
    by_doc = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    unique = [w for w in want if w[1] not in (3,) or w[0]]
    for null, d, ids in unique:
        pieces = sorted(by_doc[None if null else d], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == ids
        assert all(p.doc_tokens == len(ids) for p in pieces)
    assert sum(r.length for r in out) == sum(len(w[2]) for w in want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist()
        n = sum(r.length for r in s)
        assert n == s[0].sequence_length <= 2048 and (n == 2048 or n & (n - 1) == 0)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokens.public_path("word_bpe_49k.json")).count() == 0
    assert zlib.crc32(b"") == 0
