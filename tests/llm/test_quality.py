import random
import re
import zlib
from collections import Counter

import numpy as np

from graphspark.llm import language_id, quality_model, quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def texts(seed, n=80):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "É#", "dd$", "<x>", " y", "z\x1cw"])
    out = ["".join(word() + rnd.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]
    return [None, "", " \n ", "a b c d e f g h " * 30, "\x85\xa0", *out]


def test_counts_equal_brute_force():
    judged = quality_rules.Judge(quality_rules.References([], np.zeros((0, 7)), [], np.zeros((0, 41))))
    some = texts(1)
    got = judged(some)
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(some):
        assert tuple(got[k][i] for k in keys) == brute(t), t
    assert (got["kept"] == ~got["base_failed"]).all()


def prose(rnd, common, rare, n):
    return " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice(rare) for _ in range(3)) for _ in range(n))


def corpus(seed=4, n=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang, common, rare = (("en", ["the", "of", "and"], ["tha", "ing", "wer"]), ("de", ["der", "und", "die"], ["sch", "über", "gen"]))[i % 2]
        rows.append((i, prose(rnd, common, rare, 150), lang))
    return rows


def test_rules_reject_far_documents_and_keep_the_rest(spark):
    rnd = random.Random(5)
    bad = [(1000, "".join(rnd.choice("#$%&Q9") for _ in range(3000)).replace("Q", " "), "en"), (1001, " ".join("X" + str(rnd.random()) for _ in range(200)), None), (1002, None, "en"), (1002, "", None)]
    docs = spark.createDataFrame([(*r, True) for r in corpus() + bad], "doc_id long, text string, lang string, kept boolean")
    refs = quality_rules.learn(docs)
    assert refs.langs == ["de", "en"] and {b"the", b"of", b"and"} <= set(refs.common[1])
    got = {r.doc_id: r for r in quality_rules.judge(docs, refs).collect()}
    assert all(got[i].kept for i in range(60)) and not got[1000].kept and not got[1001].kept and got[1002].base_failed
    assert not got[1000].base_failed
    assert quality_rules.keep(docs, refs).count() == 60 and quality_rules.keep(docs, refs).columns == docs.columns
    assert quality_rules.judge(docs.limit(0), quality_rules.learn(docs.limit(0))).count() == 0


def test_js_distance():
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert quality_rules.js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def test_nn_risk_is_never_negative_and_its_gradient_fits():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, 30), rng.normal(0, 1, 40)
    risk, g_p, g_u = quality_model.nn_risk(p, u, 0.3)
    eps = 1e-6
    for k in range(3):
        d = np.eye(30)[k] * eps
        assert abs((quality_model.nn_risk(p + d, u, 0.3)[0] - risk) / eps - g_p[k]) < 1e-4
    assert quality_model.nn_risk(rng.normal(9, 1, 30), rng.normal(-9, 1, 40), 0.99)[0] >= 0


def test_quality_model_separates_held_out_rows(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        rows.append((i, prose(rnd, ["the", "of"], ["tha", "ing"], 60) if good else " ".join(rnd.choice("#$%") * 3 for _ in range(60)), "x"))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(900, None, "x"), (900, "", "x"), (901, "a" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.score(docs, quality_model.train(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == (r.doc_id % 4 > 0) for r in got if r.held_out and r.doc_id < 400]
    assert sum(right) / len(right) > 0.95
    none = quality_model.score(docs, quality_model.train(docs, marks.limit(0))).collect()
    assert all(r.predicted == 1 for r in none)


def test_language_id_on_held_out_rows(spark):
    docs = spark.createDataFrame([(i, t, l, 0.5) for i, t, l in corpus(8, 120)] + [(500, None, "en", 0.1), (501, "12 !?", "en", 0.1), (502, "", None, 0.1), (503, "x", None, 0.1)], "doc_id long, text string, lang string, score double")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model, reject_below=0.6).collect()}
    assert model.langs == ["de", "en"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(120))
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred in model.langs
    assert got[503].score < 0.9 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs.limit(0))).collect()} == {"und"}


def test_language_id_rejects_other_languages_by_default(spark):
    docs = spark.createDataFrame([(i, t, l) for i, t, l in corpus(8, 400)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert 0 < model.reject_below < 1
    other = spark.createDataFrame([(i, "съешь же ещё этих мягких французских булок да выпей чаю " * (i + 1)) for i in range(6)], "doc_id long, text string")
    assert all(r.rejected and r.lang_pred in model.langs for r in language_id.identify(other, model).collect())
    own = [r.rejected for r in language_id.identify(docs, model).collect() if r.held_out]
    assert sum(own) <= 0.1 * len(own)
