import random

from graphspark.llm import decontaminate as d


def brute(docs, items, window):
    wins = []
    for name, text in items:
        w = d.words(text)
        if w:
            wins += [(name, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))]
    out = {}
    for key, text in docs:
        w = d.words(text)
        hit, names = set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names.add(name)
        out[key] = len(w), len(hit), sorted(names), sorted(hit)
    return out


def cases(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcd")
    items = [(str(i), " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 9])))) for i in range(6)] + [("9", None), ("10", "É é-A")]
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(20)] + [(50, None), (51, ""), (51, "é É a"), (51 + 1, "--")]
    return docs, items


def test_automaton_equals_brute_force():
    for seed in range(150):
        docs, items = cases(seed)
        if seed % 2:
            items = [x for x in items if len(d.words(x[1])) not in (1, 2)]
        a = d.Automaton([(n, d.words(t)) for n, t in items], 4)
        want = brute([(i, t) for i, (_, t) in enumerate(docs)], items, 4)
        for i, (_, text) in enumerate(docs):
            runs, names = a.hits(d.words(text))
            got = sorted(x for lo, hi in runs.tolist() for x in range(lo, hi))
            assert (sorted(names), got) == want[i][2:], (seed, text, items)


def test_frames_and_chunks(spark):
    docs, items = cases(3)
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(int(n), t) for n, t in items], "item_id long, text string")
    rows = [sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.spans)) for r in d.find(frame, bench, window=4, chunk_words=most).collect()) for most in (1000, 6)]
    assert rows[0] == rows[1] and len(rows[0]) == len(docs)
    assert d.find(frame, bench.limit(0)).where("n_hit > 0").count() == 0
    assert d.find(frame.limit(0), bench).count() == 0


def test_clean_cuts_runs_and_drops_covered(spark):
    item = " ".join(f"w{i}" for i in range(12))
    long = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, 5), (2, f"{long} - {item}! {long}", 5), (3, item, 5), (4, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in d.clean(docs, bench).collect()}
    assert got == {1: long, 2: f"{long} - ! {long}", 4: None}


def test_clean_is_the_same_for_one_chunk_and_many(spark):
    w = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two = w("a", 12), w("b", 12)
    # 60% by two items; windows of two items that overlap; ends that meet to form a window when another is cut
    both, overlap = w("c", 12) + " c12 c13 c14", "c10 c11 c12 c13 c14 " + w("d", 7)
    half = two.split()
    rows = [(1, f"{one} {w('x', 8)} {two} {w('y', 8)}"), (2, f"{w('x', 40)} {both} {w('d', 7)} {w('y', 40)}"), (3, f"{w('x', 40)} {' '.join(half[:5])} {one} {' '.join(half[5:])} {w('y', 40)}")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, one), (2, both), (3, overlap), (4, two)], "item_id long, text string").coalesce(1)
    got = [sorted((r.doc_id, r.text, r.n_chars) for r in d.clean(docs, bench, chunk_words=most).collect()) for most in (1000, 12)]
    assert got[0] == got[1] and [(k, t) for k, t, _ in got[1]] == [(2, f"{w('x', 40)}  {w('y', 40)}"), (3, f"{w('x', 40)} {' '.join(half[:5])}  {' '.join(half[5:])} {w('y', 40)}")]
