import hashlib
import random

import numpy as np
import pytest

from graphspark.llm import difference_cover
from graphspark.llm import suffix_dedup as s


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(3)
    for n in [*range(0, 40), 100, 101, 102, 500]:
        for k in (1, 2, 5, 300):
            t = rng.integers(0, k, n)
            assert s.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist()), (n, k)


def brute(docs, length):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        n = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = len(raw), sum(gone), n, hashlib.sha256(kept).hexdigest()
    return out


def strict(docs, length=100):
    """By (id, text): a string repeats what starts in a smaller id (null is the least) or before it in its own text."""
    found, docs = {}, set(docs)
    rank = lambda d: (d is not None, d or 0)
    for d in sorted({d for d, _ in docs}, key=rank):
        older = {t.encode()[i : i + length] for e, t in docs if rank(e) < rank(d) and t for i in range(len(t.encode()) - length + 1)}
        for text in {t for e, t in docs if e == d}:
            raw, seen = (text or "").encode(), set()
            gone = bytearray(len(raw))
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                if w in older or w in seen:
                    gone[i : i + length] = b"\1" * length
                seen.add(w)
            kept = bytes(b for b, g in zip(raw, gone) if not g)
            found[d, text] = d, len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()
    return found


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(30) for _ in range(4)]
    line = "All rights reserved, 2020."
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and docs:
            text = docs[rnd.randrange(len(docs))][1]
        elif kind == 1:
            text = prose(20) + rnd.choice(shared) + prose(20) + line
        elif kind == 2 and docs:
            old = docs[rnd.randrange(len(docs))][1] or "x"
            at = rnd.randrange(len(old))
            text = old[:at] + "#" + old[at:]
        elif kind == 3:
            text = rnd.choice(shared)[rnd.randrange(40) :] + rnd.choice(shared)
        elif kind == 4:
            text = "a" * rnd.randrange(400) + line + "ab" * rnd.randrange(200)
        else:
            text = line + prose(60) + line
        docs.append((rnd.randrange(10**6) * 100 + i, text))
    return docs + [(-1, None), (-2, ""), (None, shared[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, n_removed int").repartition(3)
    for length in (100,):
        want = brute(docs, length)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(frame, length=length).collect()}
        assert got == want
    assert s.digest(frame.limit(0)).count() == 0
    kept = {r.doc_id: r for r in s.clean(frame).collect()}
    raw = {r.doc_id: r.kept.decode("utf-8", "ignore") for r in s.remove_repeats(frame).collect()}
    assert {d: r.text or "" for d, r in kept.items()} == raw and kept[-1].text is None and s.clean(frame).columns == frame.columns


def test_long_text_in_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 150)
    rnd = random.Random(7)
    text = "".join(rnd.choice("abc ") for _ in range(900))
    want = brute([(1, text), (2, "zz" + text + text[300:500])], 100)
    runs = [s.anchors(t.encode()) for t in (text, "zz" + text)]
    assert all((np.diff(r[2]) > 0).all() and r[3][-1] == len(t) - 100 for r, t in zip(runs, (text, "zz" + text)))
    monkeypatch.undo()
    frame = spark.createDataFrame([(1, text), (1, text), (2, "zz" + text + text[300:500])], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(frame).collect()}
    assert got == {(d, *v) for d, v in want.items()}


def digests(frame, **more):
    return sorted((tuple(r) for r in s.digest(frame, **more).collect()), key=repr)


def test_rows_of_one_id_and_of_null_ids_are_told_apart(spark):
    rnd = random.Random(11)
    prose = lambda n: "".join(rnd.choice("abcdefg ") for _ in range(n))
    shared = prose(160)
    docs = [(None, prose(rnd.randrange(250)) + (shared if i % 9 == 0 else "")) for i in range(300)]
    docs += [(i % 4, prose(rnd.randrange(300)) + (shared[i % 50 :] if i % 3 == 0 else "") + prose(20)) for i in range(60)]
    docs += [(2, shared * 3), (3, None), (3, ""), (9, docs[5][1] + docs[5][1])]
    want = strict(docs)
    frame = spark.createDataFrame(docs + docs[40:60], "doc_id long, text string").repartition(3)
    assert digests(frame) == sorted((want[x] for x in docs + docs[40:60]), key=repr)


def test_large_groups_are_sorted_by_the_distributed_algorithm(spark):
    rnd = random.Random(13)
    prose = lambda n: "".join(rnd.choice("abcdefg ") for _ in range(n))
    shared = prose(90)
    some = [prose(30) for _ in range(4)]
    docs = [(i, prose(10) + rnd.choice(some) + shared + rnd.choice(some) + prose(10)) for i in range(70)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = strict(docs)
    assert digests(frame, group_bytes=1000) == digests(frame) == sorted((want[x] for x in docs), key=repr)
    assert sum(r[2] for r in want.values()) > 5000


@pytest.mark.parametrize("alphabet", [2, 60])
def test_distributed_difference_cover_equals_sorting(spark, alphabet):
    rng = np.random.default_rng(alphabet)
    strings = [rng.integers(0, alphabet, rng.integers(0, 70), dtype=np.uint8).tobytes() for _ in range(12)] + [b"", bytes(40), bytes(41)]
    frame = spark.createDataFrame(list(enumerate(strings)), "p long, x binary")
    order = sorted((x[o:], p, o) for p, x in enumerate(strings) for o in range(len(x)))
    got = {(r.p, r.o): r.r for r in difference_cover.ranks(frame, 1000).collect()}
    least = {}
    for k, (x, _, _) in enumerate(order):
        least.setdefault(x, k + 1)
    assert got == {(p, o): least[x] for x, p, o in order}
    found = [(r.p, r.o, r["class"]) for r in difference_cover.classes(frame, 8).collect()]
    names = {}
    for p, o, k in found:
        assert names.setdefault(k, strings[p][o : o + 8]) == strings[p][o : o + 8]
    assert len(set(names.values())) == len(names) and len(found) == sum(max(0, len(x) - 7) for x in strings)
    assert difference_cover.classes(frame.limit(0), 8).count() == 0


def test_equal_hashes_of_unlike_strings_stop_the_job(spark, monkeypatch):
    text = "".join(random.Random(17).choice("abcdefg ") for _ in range(150))
    digest = lambda b: hashlib.sha256(b).digest()
    rows = [(1, 0, 5, 6, 0, 9, digest(b"a"), 0), (1, 0, 5, 6, 0, 9, digest(text.encode()), 0)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in list(zip(*rows))[:7]], names=["k", "kind", "d", "m", "s", "n", "b"])
    with pytest.raises(RuntimeError, match="unlike"):
        list(s._sorted(100, 10**6)([batch]))


def test_columns_named_as_the_operator_names_its_own(spark):
    rnd = random.Random(19)
    text = "".join(rnd.choice("abcdefg ") for _ in range(220))
    rows = [(1, text, 0, "x", 7), (2, "zz" + text, 0, "y", 8)]
    frame = spark.createDataFrame(rows, "d long, m string, spans int, t string, lo long")
    kept = {r.d: r for r in s.clean(frame, "d", "m").collect()}
    assert kept[1].m == text and kept[2].m == "zz" and (kept[2].t, kept[2].lo, kept[2].spans) == ("y", 8, 0)
    assert s.clean(frame, "d", "m").columns == frame.columns
    assert {(r.doc_id, r.n_removed) for r in s.digest(frame, "d", "m").collect()} == {(1, 0), (2, 220)}
