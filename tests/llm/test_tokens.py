import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphspark.llm import elias_fano, packing, token_files
from graphspark.llm.tokens import Encoder, default_path

TEXTS = ["", "a", "  a  b \n\n c", "a\n b", " x", "x ", "\n", "don't  stop\t\tnow 123 4", "日本 語テキスト　全角", "é b c d", "<|endoftext|> hi", "a\x1cb c", "x" * 3000, "  ", "a  ", "emoji 😀😀 x's", "Of%%% athe*** the&&& a$$$", "a b " * 2000, "naïve café 12ab"]


def test_ids_and_spans_equal_the_library():
    enc, lib = Encoder(), Tokenizer.from_file(default_path())
    for text in TEXTS * 2:
        want = lib.encode(text, add_special_tokens=False)
        ids, lo, hi = enc.spans(text)
        assert ids.tolist() == want.ids == enc.ids(text).tolist(), text
        assert list(zip(lo.tolist(), hi.tolist())) == want.offsets, text
    assert enc.ids(None).tolist() == []


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], [0, 1 << 40], rng.integers(0, 10_000, 3000), rng.integers(0, 1 << 36, 2000), np.arange(5000)):
        v = np.sort(np.array(values, dtype=np.int64))
        data = elias_fano.encode(v)
        ef = elias_fano.EliasFano(data)
        assert ef.all().tolist() == v.tolist()
        assert [ef.select(i) for i in range(0, len(v), 7)] == v[::7].tolist()
        if len(v) > 1000:
            assert len(data) * 8 / len(v) < 2.6 + np.log2(max(1, v[-1] / len(v))) + 1
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


def frame(spark):
    rows = [(i * 7 % 40 - 5, t) for i, t in enumerate(TEXTS)] + [(3, None), (3, "again"), (None, "no id")]
    return spark.createDataFrame([(k, t, 1.5) for k, t in rows], "doc_id long, text string, start double").repartition(3), rows


def test_token_files_round_trip(spark, tmp_path):
    docs, rows = frame(spark)
    lib = Tokenizer.from_file(default_path())
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/a", shard_ids=3000)
    got = sorted(map(tuple, token_files.read_tokens(manifest, "k long, start long, ids array<long>", lambda k, s, x: (k, s, x.tolist())).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert sorted((r[0] is None, r[0] or 0, r[2]) for r in got) == sorted((k is None, k or 0, lib.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in rows)
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids)
    one = token_files.Shard(manifest.orderBy("part", "seq").collect()[0].path)
    assert [(one.key(i), one.doc(i).tolist()) for i in range(len(one))] == [(k, x.tolist()) for k, _, x in one.docs(5)]
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), f"{tmp_path}/b"), "k long", lambda k, s, x: (k,)).count() == 0


def test_packing_is_whole_and_full(spark):
    docs, rows = frame(spark)
    lib = Tokenizer.from_file(default_path())
    got = packing.pack(docs).collect()
    whole = {}
    for k, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        whole.setdefault(k, []).append(ids)
    for k, texts in whole.items():
        assert sum(r.length for r in got if r.doc_id == k) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0])
                assert r.ids_crc32 == zlib.crc32(texts[0][at : at + r.length].tobytes())
                at += r.length
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].capacity <= 2048 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tiers=(100,))


def test_step_groups_cost_the_same():
    made = []
    p = packing.Packer([64, 32, 16], lambda size, pieces: made.append((size, pieces)), pool=50)
    rng = np.random.default_rng(2)
    total = 0
    for k, n in enumerate(rng.integers(1, 200, 400)):
        p.add(k, np.arange(n, dtype="<u4"))
        total += n
    p.close()
    assert sum(s for s, _ in made) == total
    assert all(sum(x[0] for x in pieces) == s for s, pieces in made)
    assert sum(s not in (64, 32, 16) for s, _ in made) < 6
