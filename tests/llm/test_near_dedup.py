import os
import random

import numpy as np
import pytest

from graphspark.llm import near_dedup as nd
from graphspark.llm.components import connected


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_gives_the_edit_distance_or_none():
    rnd = random.Random(1)
    for _ in range(1500):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(25))]
        b = list(a) if rnd.random() < 0.6 else [rnd.randrange(5) for _ in range(rnd.randrange(25))]
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = [rnd.randrange(6)] * rnd.randrange(2)
        want, most = plain(a, b), rnd.randrange(8)
        got = nd.distance(np.array(a, dtype="<u4"), np.array(b, dtype="<u4"), most)
        assert got == (want if want <= most else None), (a, b, most)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    want = {x: min(g) for g in groups.values() for x in g if len(g) > 1}
    assert {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = prose(60)
    rows = []
    for g in range(12):
        base = prose(rnd.choice([30, 120, 400]))
        for c in range(rnd.choice([1, 2, 8])):
            own = list(base)
            for _ in range(int(len(own) * 0.04) * (c > 0)):
                at = rnd.randrange(len(own))
                own[at : at + rnd.randrange(2)] = [rnd.choice(vocab)]
            rows.append((rnd.randrange(10**6) * 1000 + len(rows), " ".join(own)))
    rows += [(10**10 + i, " ".join(prose(50) + passage + prose(90))) for i in range(20)]
    rows += [(rows[0][0] + 7, rows[0][1].upper() + "!"), (5, "one two"), (6, "One, two"), (8, "one two three"), (9, None), (10, ""), (None, "one two"), (5, "one two")]
    return rows


def test_classes_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(3)
    own = {d: nd.words(t) for d, t in rows}
    ids = sorted(own, key=lambda d: (d is not None, d))
    part = {d: d for d in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if own[a] and own[b] and abs(len(own[a]) - len(own[b])) <= 0.2 * max(len(own[a]), len(own[b])) and nd.alike(*(nd.word_hashes(own[x]) for x in (a, b)), 0.8):
                lo, hi = sorted((find(a), find(b)), key=lambda d: (d is not None, d))
                part[hi] = lo
    got = {r.doc_id: r.class_id for r in nd.classes(frame).collect()}
    # a class never goes beyond true links, and holds all pairs that share three quarters of their 5-word shingles
    assert all(find(d) == find(c) for d, c in got.items()) and set(got) == set(ids)
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in own.items() if w}
    close = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if own[a] and own[b] and find(a) == find(b) and len(shingles[a] & shingles[b]) >= 0.75 * len(shingles[a] | shingles[b])]
    assert len(close) >= 8 and all(got[a] == got[b] for a, b in close)
    kept = nd.keep_one(frame)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == sorted((d is not None, d or 0) for d in ids if got[d] == d)
    assert kept.columns == frame.columns and nd.classes(frame.limit(0)).count() == 0


def test_leaders_link_all_members_of_a_large_group():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, 48)
    group = np.where(rng.random((300, 48)) < 0.75, base, rng.integers(0, 256, (300, 48))).astype(np.uint8)
    pairs = nd.leader_pairs(group, np.full(300, 100))
    assert {x for a, b, _ in pairs for x in (a, b)} == set(range(300)) and len(pairs) < 300 * 12
    assert nd.leader_pairs(group[:2], np.array([100, 79])) == []


def test_exact_tests_never_rule_out_a_pair_that_aligns():
    rng = np.random.default_rng(5)
    ruled = 0
    for _ in range(600):
        a = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, rng.integers(1, 60))]
        b = a.copy()
        for _ in range(rng.integers(0, 20)):
            at = rng.integers(0, len(b) + 1)
            b = np.concatenate([b[:at], rng.integers(0, 9, rng.integers(0, 2), dtype=np.uint64), b[at + rng.integers(0, 2) :]])
        if not len(b):
            continue
        counts = [np.frombuffer(nd.bins(x), dtype=np.uint8) for x in (a, b)]
        may = nd.may_align(counts[0][None], np.array([len(a)]), counts[1], len(b), 0.8)[0]
        ruled += not may
        assert may or not nd.alike(*(x.astype("<u4") for x in (a, b)), 0.8)
    assert ruled > 50


def test_bags_rule_out_no_pair_that_aligns_and_name_each_pair_once():
    import pyarrow as pa

    rnd = random.Random(21)
    base = [rnd.randrange(3000) for _ in range(300)]
    texts = []
    for k in range(40):
        own = [rnd.randrange(3000) if rnd.random() < rnd.choice([0.02, 0.1, 0.2]) else w for w in base[rnd.randrange(40) :]]
        texts.append(np.array(own if k else [7] * 900, dtype="<u4"))
    same = np.array([[10 * t + rnd.randrange(3) for t in range(nd.SKETCHES)] for _ in texts], dtype="<i8")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.tobytes() for t in texts]), pa.array([x.tobytes() for x in same])], names=["i", "w", "s"])
    bags = nd._Bags(next(nd._bags([batch])).column("m").to_pylist())
    links = 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            links += (aligned := nd.alike(texts[i], texts[j], 0.8))
            meet = np.flatnonzero(same[i] == same[j]).tolist()
            seen = [t for t in meet if len(bags.partners(i, np.array([j]), int(same[i][t]), 0.8))]
            assert len(seen) <= 1 and (seen or not aligned or not meet)
    assert links > 50


def test_copies_in_a_group_under_one_template_are_linked(spark):
    rnd = random.Random(6)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    template = prose(140)
    rows = [(i, template + prose(60)) for i in range(50)]
    for i in (20, 24, 28):  # shingles are shared within the template only
        copy = list(rows[i][1])
        copy[142::4] = prose(len(copy[142::4]))
        rows[i + 1] = (i + 1, copy)
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.classes(frame).collect()}
    assert got == {d: d - (d in (21, 25, 29)) for d in range(50)}


def test_scattered_edits_are_found(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        copy = list(base)
        for at in rnd.sample(range(400), 32 if g % 2 else 40):
            copy[at] = f"w{rnd.randrange(10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * g + 1] == 2 * g for g in range(40)]
    assert sum(found[1::2]) >= 19 and sum(found[::2]) >= 18 and all(c // 2 == d // 2 for d, c in got.items())


def test_texts_of_null_and_repeated_ids_are_kept_apart(spark):
    rnd = random.Random(8)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, b), (3, c), (3, d), (4, d + " more"), (5, b), (5, b), (6, None), (7, "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, x int")
    kept = [(r.doc_id, r.text) for r in nd.keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (3, c), (3, d), (6, None), (7, "")], key=str)
    got = sorted(((r.doc_id, r.class_id, r.n_rows) for r in nd.classes(frame).collect()), key=str)
    assert got == sorted([(None, None, 1), (None, None, 1), (3, 3, 1), (3, 3, 1), (4, 3, 1), (5, None, 2), (6, 6, 1), (7, 7, 1)], key=str)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_registered_query_finds_all_pairs_that_align(spark):
    """Components of all aligned pairs of the table, by brute force, against the query's classes."""
    from graphspark.llm import queries

    got = {r.doc_id: r.class_id for r in queries.op2_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: nd.word_hashes(nd.words(r.text)).astype("<u4") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = sorted((d for d in texts if len(texts[d])), key=lambda d: len(texts[d]))
    lead = {d: d for d in texts}

    def top(d):
        while lead[d] != d:
            d = lead[d]
        return d

    links = 0
    for k, d in enumerate(ids):
        for e in ids[k + 1 :]:
            if 0.8 * len(texts[e]) > len(texts[d]) + 1e-9:
                break
            if nd.alike(texts[d], texts[e], 0.8):
                links += 1
                a, b = sorted((top(d), top(e)))
                lead[b] = a
    assert got == {d: top(d) for d in texts} and links > 100
