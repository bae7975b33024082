"""Quality rules: how far a document's histograms lie from those of its language.

References are learned from all documents: for each language the histogram of
character classes and that of its most common short words, with one bin for
all other words.  A document is compared to each language's references by the
Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts.  Short
documents are not judged by it, as their histograms are mostly chance.

Plain counts (words, symbols, repeated lines and windows) come beside it.

Defined cases: null is a text without words; texts of fewer than MIN_WORDS
words fail the base rule; documents without a language learn nothing but are
judged; with no references at all only the base rule holds; rows with equal
ids keep their own results; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm import common

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Bins of the word histogram, and the longest word that counts as a common word.
COMMON, COMMON_BYTES = 40, 8
#: Different words that a task counts before it passes the counts on.
HELD_WORDS = 100_000
#: Distances beyond which a document is rejected, and the words that it must have to be judged by each.
CLASS_LIMIT, CLASS_GUARD, WORD_LIMIT, WORD_GUARD = 0.3, 60, 0.33, 120

_CLASSES = ("space", "lower", "upper", "digit", "stop", "symbol", "beyond")


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0xC0:
        return 6
    if b >= 0x80:
        return -1  # a character's later bytes
    if c in " \t\n\v\f\r":
        return 0
    return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:?!'\"()-" else 5


_CLASS = np.array([_class_of(b) for b in range(256)])
_FOLD = np.zeros((256, len(_CLASSES)))
_FOLD[np.flatnonzero(_CLASS >= 0), _CLASS[_CLASS >= 0]] = 1
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_SPACES = np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8)
_POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, dtype=np.uint64))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


@dataclass
class References:
    """Histograms by language: ``classes`` (L, 7), ``words`` (L, K + 1) over ``common`` (L lists of K words)."""

    langs: list[str]
    classes: np.ndarray
    common: list[list[bytes]]
    words: np.ndarray

    def index(self) -> tuple[dict[bytes, int], np.ndarray]:
        """Words in either case to columns, and each language's columns (the last one is empty)."""
        column: dict[bytes, int] = {}
        for own in self.common:
            for w in own:
                column.setdefault(w, len(column))
        n = len(column)
        table = np.array([[column[w] for w in own] + [n] * (self.words.shape[1] - 1 - len(own)) for own in self.common], dtype=np.int64).reshape(len(self.common), self.words.shape[1] - 1)
        return {form: k for w, k in column.items() for form in (w, w.capitalize())}, table


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_words: int = COMMON) -> References:
    """References from all documents that name a language: a few rows for each language reach the driver."""

    def run(batches):
        common.claim("quality_rules")
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in common.slices(whole, "t"):
                for lang, text in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist()):
                    if text:
                        raw = text.encode()
                        classes[lang] = classes.get(lang, 0) + np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                        words.setdefault(lang, Counter()).update(raw.split())
                if sum(map(len, words.values())) >= HELD_WORDS:
                    yield from counted(words, classes)
                    words, classes = {}, {}
        yield from counted(words, classes)
        words, classes = {}, {}
        common.release()

    def counted(words: dict, classes: dict):
        rows = []
        for lang, counts in words.items():
            rows += [(lang, 0, str(k), int(n)) for k, n in enumerate(classes[lang] @ _FOLD)]
            short: Counter = Counter()
            total = 0
            for w, n in counts.items():
                total += n
                if len(w) <= COMMON_BYTES and (s := w.decode("utf-8", "ignore")).isalpha():
                    short[s.lower()] += n
            rows.append((lang, 1, "", total))
            rows += [(lang, 2, w, n) for w, n in short.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "kind", "key", "n"])

    common.importable(docs.sparkSession)
    seen = docs.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    counts = seen.mapInArrow(run, "lang string, kind int, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))).where(F.col("r") <= max(common_words, len(_CLASSES)))
    by: dict = {}
    for r in top.collect():
        by.setdefault(r.lang, {}).setdefault(r.kind, {})[r.key] = r.n
    langs = sorted(k for k, v in by.items() if 1 in v)
    classes, lists, hists = [], [], []
    for lang in langs:
        c = np.array([by[lang][0][str(k)] for k in range(len(_CLASSES))], dtype=float)
        classes.append(c / c.sum())
        best = sorted(by[lang].get(2, {}).items(), key=lambda x: (-x[1], x[0]))[:common_words]
        h = np.array([n for _, n in best] + [0] * (common_words - len(best)), dtype=float)
        total = by[lang][1][""]
        hists.append(np.append(h, total - h.sum()) / total)
        lists.append([w.encode() for w, _ in best])
    return References(langs, np.array(classes).reshape(-1, len(_CLASSES)), lists, np.array(hists).reshape(-1, common_words + 1))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence to base 2, over the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0)
        b = np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip((a + b).sum(axis=-1) / 2, 0, 1))


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that the text has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    v = ids.astype(np.uint64) + np.uint64(1)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        code += v[k : k + n] * _POWERS[k]
    code ^= code >> np.uint64(31)
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    at = np.flatnonzero(same)
    if not (rows[order[at]] == rows[order[at + 1]]).all():  # codes that clash: name the windows themselves
        _, name = np.unique(rows, axis=0, return_inverse=True)
        twice = np.bincount(name.ravel())[name.ravel()] > 1
    else:
        twice = np.zeros(n, dtype=bool)
        twice[order[at]] = twice[order[at + 1]] = True
    mark = np.zeros(len(ids) + 1, dtype=np.int64)
    mark[np.flatnonzero(twice)] += 1
    np.add.at(mark, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(mark)[: len(ids)] > 0).sum())


class Judge:
    """Counts and verdicts of lists of texts."""

    def __init__(self, refs: References, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, class_guard: int = CLASS_GUARD, word_guard: int = WORD_GUARD):
        self.refs, self.limits = refs, (("class_distance", class_limit, class_guard), ("word_distance", word_limit, word_guard))
        self.column, self.table = refs.index()

    def __call__(self, texts: list) -> dict[str, np.ndarray]:
        n, k = len(texts), max([0, *self.column.values()]) + 1
        base = np.zeros((n, 5), dtype=np.int64)
        chars, words = np.zeros((n, 256)), np.zeros((n, k + 1))
        get = self.column.get
        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode()
            own = raw.split()
            if not own:
                continue
            counts = chars[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            seen: dict = {}
            new = seen.setdefault
            ids = np.fromiter([new(w, len(seen)) for w in own], dtype=np.int64, count=len(own))
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            base[i] = len(own), len(text) - counts[_SPACES].sum(), counts[_SYMBOLS].sum(), len(lines) - len(set(lines)), repeated_words(ids) if len(seen) < len(own) else 0
            if get and self.column:
                cols = np.fromiter((get(w, k) for w in seen), dtype=np.int64, count=len(seen))
                np.add.at(words[i], cols, np.bincount(ids, minlength=len(seen)))
        out = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), base.T))
        out["base_failed"] = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED * base[:, 0])
        out |= dict(zip(("class_distance", "word_distance"), self.distances(chars @ _FOLD, words)))
        out["kept"] = ~out["base_failed"]
        for name, limit, guard in self.limits:
            out["kept"] &= (out[name] <= limit) | (base[:, 0] < guard)
        return out

    def distances(self, classes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document to the nearest language, by the sum of both distances."""
        if not self.refs.langs:
            return np.zeros(len(words)), np.zeros(len(words))
        total = np.maximum(words.sum(axis=1), 1)
        words = words.copy()
        words[:, -1] = 0
        wide = np.append(words[:, :-1], np.zeros((len(words), 1)), axis=1)
        p = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
        by_class, by_word = [], []
        for l in range(len(self.refs.langs)):
            h = wide[:, self.table[l]]
            h = np.append(h, (total - h.sum(axis=1))[:, None], axis=1) / total[:, None]
            by_class.append(js_distance(p, self.refs.classes[l]))
            by_word.append(js_distance(h, self.refs.words[l]))
        by_class, by_word = np.array(by_class), np.array(by_word)
        best = (by_class + by_word).argmin(axis=0), np.arange(len(words))
        return by_class[best], by_word[best]


def judge(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    def make():
        common.claim("quality_rules")
        judged = Judge(refs, **limits)
        return lambda keys, texts: {"doc_id": keys, **judged(texts)}

    return common.map_texts(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, SCHEMA, make)


def keep(docs: DataFrame, refs: References, text_col: str = "text", **limits) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(batches):
        common.claim("quality_rules")
        judged = Judge(refs, **limits)
        for whole in batches:
            for batch in common.slices(whole, text_col):
                yield batch.filter(pa.array(judged(batch.column(text_col).to_pylist())["kept"]))

    common.importable(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
