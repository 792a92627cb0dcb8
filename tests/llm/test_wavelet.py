import numpy as np
from tokenizers import Tokenizer

from weft.llm import tokens, wavelet
from weft.llm.common import shared_dir


def test_matrix_against_brute_force():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (700, 5), (5000, 50257), (1300, 1 << 20)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        data = wavelet.to_bytes(wavelet.WaveletMatrix.build(ids), [5], np.array([n]))
        wm, names, lengths = wavelet.from_bytes(data)
        assert names == [5] and lengths.tolist() == [n]
        assert (wm.decode() == ids).all()
        for at in rng.integers(0, max(n, 1), 40 if n else 0).tolist():
            s = int(ids[at])
            assert wm.access(at) == s
            assert wm.rank(s, at) == int((ids[:at] == s).sum())
            assert wm.select(s, wm.rank(s, at)) == at
            assert wm.count(s) == int((ids == s).sum())
        assert wm.count(1 << 25) == 0


def test_files_round_trip(spark):
    texts = ["", None, "one two", "a  b\n\n c", "Hello world! " * 700, "é 🙂 日本"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "another row of id 6"), (None, "no id"), (-4, "negative")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS start", "'x' AS ids")
    folder, path = shared_dir(spark), tokens.public_path("byte_bpe_50k.json")
    manifest = wavelet.write_shards(df, folder, path, shard_ids=200)
    assert manifest.count() >= 1
    out = sorted(wavelet.read_shards(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    plain, at = Tokenizer.from_file(path), 0
    want = sorted((d is not None, d or 0, plain.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in out)
    assert got == want
    for r in out:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    folder = shared_dir(spark)
    manifest = wavelet.write_shards(empty, folder, tokens.public_path("byte_bpe_50k.json"))
    assert wavelet.read_shards(manifest, folder).count() == 0
