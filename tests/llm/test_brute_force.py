"""The registered queries that SQL cannot express, against plain loops over the same rows."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphspark.llm import chat_format, language_id, packing, quality_model, quality_rules, queries, token_counts
from graphspark.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.01/documents.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rnd, lang, n):
    common, rare = {"en": (["the", "of", "and"], ["tha", "ing", "wer", "sh"]), "de": (["der", "und", "die"], ["sch", "über", "gen", "ß"])}[lang]
    return " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice(rare) for _ in range(3)) for _ in range(n)).capitalize()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, rows, labels = random.Random(3), [], []
    for i in range(240):
        lang, good = ("en", "de")[i % 2], i % 4 > 0
        lines = [prose(rnd, lang, rnd.randrange(20, 90)) if good else " ".join(rnd.choice("#$%*") * 4 for _ in range(50)) for _ in range(rnd.randrange(1, 5))]
        rows.append((i, "\n".join(lines + lines[:1] * (i % 5 == 0)), lang if i % 7 else None, "web", 1))
        if i % 3:
            labels.append((i, int(good), 0))
    long = "\n".join(prose(rnd, "en", 200) for _ in range(250))
    rows += [(900, None, "en", None, None), (900, "", "de", "web", 0), (901, "12 !? 34", "en", "web", 3), (902, long, "en", "web", 4), (903, long, "en", "web", 4), (None, "lone text of no id", None, None, None), (904, "a" * 60_000, None, "web", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, labels


def js(p, q):
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(min(1.0, max(0.0, out)))


def classes_of(text):
    """Counts of the seven character classes, character by character."""
    out = [0] * 7
    for c in text or "":
        out[0 if c in " \t\n\v\f\r" else 6 if ord(c) > 127 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:?!'\"()-" else 5] += 1
    return out


def test_quality_rules_verdicts(spark, folder):
    at, rows, _ = folder
    hist, words = {}, {}
    for _, text, lang, *_ in rows:
        if lang is not None and text:
            hist[lang] = [a + b for a, b in zip(hist.get(lang, [0] * 7), classes_of(text))]
            words.setdefault(lang, Counter()).update(WORD.findall(text))
    refs = {}
    for lang, own in words.items():
        short = Counter()
        for w, n in own.items():
            if len(w.encode()) <= 8 and w.isalpha():
                short[w.lower()] += n
        best = sorted(short.items(), key=lambda x: (-x[1], x[0]))[:40]
        total = sum(own.values())
        refs[lang] = [x / sum(hist[lang]) for x in hist[lang]], [w for w, _ in best], [*(n / total for _, n in best), 1 - sum(n for _, n in best) / total]
    got = {}
    for r in queries.op5_quality_rules(spark, at).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.base_failed, r.kept))
    want, judged = {}, 0
    for key, text, *_ in rows:
        own = WORD.findall(text or "")
        grams = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        hit = {i + k for i in range(len(own) - 7) if grams[tuple(own[i : i + 8])] > 1 for k in range(8)}
        failed = len(own) < 20 or 100 * len(hit) > 30 * len(own)
        kept = not failed
        if kept:
            c = classes_of(text)
            p = [x / sum(c) for x in c]
            far = []
            for classes, common, freq in refs.values():
                n = [sum(w in (x, x.capitalize()) for w in own) / len(own) for x in common]
                far.append((js(p, classes), js([*n, max(0.0, 1 - sum(n))], freq)))
            a, b = min(far, key=sum)
            kept = (a <= quality_rules.CLASS_LIMIT or len(own) < quality_rules.CLASS_GUARD) and (b <= quality_rules.WORD_LIMIT or len(own) < quality_rules.WORD_GUARD)
            judged += not kept
        want.setdefault(key, []).append((len(own), failed, kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and judged > 5


def test_quality_scores(spark, folder):
    at, rows, labels = folder
    docs, marks = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, marks)
    learn = [y for i, y in ((i, y) for i, y, _ in [*labels, (7777, 1, 0)]) if zlib.crc32(str(i).encode()) % 5]
    assert abs(model.prior - sum(learn) / len(learn)) < 1e-9
    got = {}
    for r in queries.op6_quality_model(spark, at).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, round(r.score, 9), r.predicted))
    want = {}
    for key, text, *_ in rows:
        x = quality_model.features(text)
        margin = model.bias
        for k, value in enumerate(x):
            margin += float(model.weights[k * quality_model.BINS + sum(1 for e in model.edges[k].tolist() if e <= value)])
        score = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        want.setdefault(key, []).append((key is not None and zlib.crc32(str(key).encode()) % 5 == 0, round(score, 9), int(score >= 0.3)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_quality_features_and_risk():
    text = "Ab ab! ab ab! ab ab! ab ab! ab ab! 7#\n\nno, no\nno, no\nX"
    x = quality_model.features(text)
    own, lines = WORD.findall(text), [y for y in text.split("\n") if y.strip()]
    n = len(own)
    grams = Counter(tuple(own[i : i + 8]) for i in range(n - 7))
    again = {i + k for i in range(n - 7) if grams[tuple(own[i : i + 8])] > 1 for k in range(8)}
    plain = [*(c / sum(classes_of(text)) for c in classes_of(text)), math.log1p(n), len(set(own)) / n, len(set(own)) / math.sqrt(n), max(Counter(own).values()) / n, sum(map(len, own)) / n, sum(len(w) == 1 for w in own) / n, sum(a == b for a, b in zip(own, own[1:])) / (n - 1), sum(w[-1] in "#*$%&|<>" for w in own) / n, sum(w[-1] == "!" for w in own) / n, sum("A" <= w[0] <= "Z" for w in own) / n, len(again) / n, 1 - len(set(lines)) / len(lines), len(lines) / n]
    assert np.allclose(x, plain)
    rng = np.random.default_rng(1)
    for shift in (0, 3):
        p, u, prior = rng.normal(shift, 1, 20), rng.normal(-shift, 1, 30), 0.4
        loss = lambda z: math.log(1 + math.exp(-z))
        rest = sum(loss(-z) for z in u) / 30 - prior * sum(loss(-z) for z in p) / 20
        assert abs(quality_model.nn_risk(p, u, prior)[0] - (prior * sum(map(loss, p)) / 20 + max(0, rest))) < 1e-9


def test_language_scores(spark, folder):
    at, rows, _ = folder
    model = language_id.train(spark.read.parquet(f"{at}/documents.parquet"))
    assert model.langs == ["de", "en"]
    table, bias = model.table.astype(float), model.bias.astype(float)

    def subwords(text):
        letters, out = [], []
        for c in f" {text.lower()} ":
            c = c if ord(c) > 127 or c.isalpha() else " "
            if not (c == " " and letters and letters[-1] == " "):
                letters.append(c)
        for n in (2, 3, 4):
            for i in range(len(letters) - n + 1):
                h = ord(letters[i])
                for k in range(2, n + 1):
                    h = (((h * 31 + ord(letters[i + k - 1])) % 2**32) * 0x85EBCA6B % 2**32) ^ k
                out.append((h * 2654435761 % 2**32) >> (32 - language_id.BUCKET_BITS))
        return out

    got = {}
    for r in queries.op10_language_id(spark, at).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, round(r.score, 4), r.rejected))
    want = {}
    for key, text, *_ in rows:
        if not text or not any(c.isalpha() for c in text):
            told = "und", 0.0, True
        else:
            own = subwords(text)
            z = [sum(n * table[b, l] for b, n in Counter(own).items()) / len(own) + bias[l] for l in range(2)]
            e = [math.exp((x - max(z)) / model.temperature) for x in z]
            k = e.index(max(e))
            score = (len(own) * e[k] / sum(e) + language_id.FLAT / 2) / (len(own) + language_id.FLAT)
            told = model.langs[k], round(score, 4), score < model.reject_below
        want.setdefault(key, []).append((key is not None and zlib.crc32(str(key).encode()) % 4 == 2, *told))
    for key in want:
        for a, b in zip(sorted(got[key], key=str), sorted(want[key], key=str), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-4 and (a[3] == b[3] or abs(a[2] - model.reject_below) < 2e-4), key


def counted(lib, text, parts, rule):
    """Tokens and crossing tokens of each part, token by token and character by character."""
    edge = [*parts, len(text)]
    n, touched = [0.0] * len(parts), [0] * len(parts)
    for lo, hi in lib.encode(text, add_special_tokens=False).offsets:
        held = [sum(1 for c in range(lo, hi) if edge[p] <= c < edge[p + 1]) for p in range(len(parts))]
        own = [p for p, h in enumerate(held) if h]
        for p in own if len(own) > 1 else ():
            touched[p] += 1
        if rule == "share":
            for p in own:
                n[p] += held[p] / (hi - lo)
        else:
            n[own[0] if rule == "first" else own[-1] if rule == "last" else held.index(max(held))] += 1
    return n, touched


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    lib, rnd = Tokenizer.from_file(default_path()), random.Random(9)
    bits = ["a", "\n", "\n\n", " ", "é", "日本", "😀", "the ", "x\n", "\t", "!!"]
    texts = [None, "", "\n", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(40)), "word\n" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_counts.count_lines(docs, rule=rule).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, round(float(r.n_tokens), 6), r.n_crossing))
    for key, text in enumerate(texts[:-1]):
        text = text or ""
        parts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text))]
        n, touched = counted(lib, text, parts, rule)
        assert got[key] == [(a, b - a, round(x, 6), t) for a, b, x, t in zip(parts, [*parts[1:], len(text)], n, touched)], (key, text)
    assert len(got[len(texts) - 1]) == 20_000
    fields = spark.createDataFrame([(1, "we", "b\nx", None), (2, "", "é", "😀")], "doc_id long, a string, b string, c string")
    for r in token_counts.count_fields(fields, "doc_id", ["a", "b", "c"], separator="", rule=rule).collect():
        text, sizes = ("web\nx", [2, 3, 0]) if r.doc_id == 1 else ("é😀", [0, 1, 1])
        parts = [sum(sizes[:k]) for k in range(3)]
        assert r.length == sizes[r.part] and r.start == parts[r.part]
        if all(sizes):
            assert abs(r.n_tokens - counted(lib, text, parts, rule)[0][r.part]) < 1e-9


def test_registered_counts_are_those_of_the_library(spark, folder):
    at, rows, _ = folder
    lib = Tokenizer.from_file(default_path())
    got = Counter()
    for r in queries.op7_token_counts(spark, at).collect():
        got[r.doc_id] += r.n_tokens
    want = Counter()
    for key, text, *_ in rows:
        want[key] += len(lib.encode(text or "", add_special_tokens=False).ids)
    assert got == want


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_ids_of_whole_documents_equal_the_library(spark):
    lib, enc = Tokenizer.from_file(default_path()), Encoder()
    for r in spark.read.parquet(SF).select("text").collect():
        assert enc.ids(r.text).tolist() == lib.encode(r.text or "", add_special_tokens=False).ids


def test_another_tokenizer_goes_to_the_library():
    path = os.path.join(os.path.dirname(default_path()), "word_bpe_49k.json")
    lib, enc = Tokenizer.from_file(path), Encoder(path)
    assert not enc.chunked and Encoder().chunked
    for text in ("The  Cat's 12 HATS\n\n", "é b", "", "a" * 50):
        got = lib.encode(text, add_special_tokens=False)
        ids, lo, hi = enc.spans(text)
        assert ids.tolist() == enc.ids(text).tolist() == got.ids and list(zip(lo.tolist(), hi.tolist())) == got.offsets


def test_step_groups_cost_the_same_over_all_tasks(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["the", "x1", "ab"]) for _ in range(rnd.randrange(1, 900)))) for i in range(300)], "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, tiers=(256, 128, 64), group_ids=1024).collect()
    windows = {r.sequence_id: (r.capacity, r.step_group) for r in rows}
    assert all(windows[r.sequence_id] == (r.capacity, r.step_group) for r in rows)
    sizes: dict = {}
    for capacity, group in windows.values():
        sizes.setdefault(capacity, Counter())[group] += 1
    assert len({g for c in sizes.values() for g in c}) == sum(map(len, sizes.values()))
    for capacity, groups in sizes.items():
        full = max(1, 1024 // capacity)
        assert sorted(groups.values())[1:] == [full] * (len(groups) - 1) and max(groups.values()) <= full, (capacity, groups)
    assert len(sizes[256]) > 20


def test_conversations_are_read_back_from_files_in_any_order(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rnd.choice(["the", "…", "\n", "[INST]", "</s>"]) for _ in range(rnd.randrange(60)))) for c in range(30) for t in range(rnd.randrange(1, 9))]
    rows += [(1000, 0, "user", "x " * 40_000), (1000, 1, "assistant", "y " * 40_000), (None, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chat_format.format_conversations(turns, segment_chars=100).orderBy("ids").repartition(7).write.parquet(f"{tmp_path}/chats")
    stored = spark.read.parquet(f"{tmp_path}/chats")
    at_once = {tuple(r) for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert {tuple(r) for r in chat_format.read_back(stored).collect()} == at_once and len(at_once) == 32
    with pytest.raises(Exception, match="missing"):
        chat_format.read_back(stored.where("segment <> 1")).collect()
