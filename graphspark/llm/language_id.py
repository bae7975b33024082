"""Language identification by averaged hashed subword embeddings and a softmax.

A text's subwords (2 to 4 letters, runs of other ASCII characters count as one
word end) are hashed to buckets; the mean of their embeddings goes through a
linear softmax.  Embeddings and weights are trained by stochastic gradient
descent in numpy on a bounded sample (MOST_DOCS rows and MOST_CHARS characters
a language, least hash of the id first, whole texts; a text that would go beyond
that is left out, not cut).  A temperature fitted on a part of the sample that
is not trained on makes the scores probabilities.  The same part sets the
rejection threshold: the score that all but REJECTED of its rightly told texts
reach (0, so no rejection, where the sample is too small to set texts aside).

As the model is linear after the mean, scoring needs one table of a row for
each bucket, and whole texts are summed up by numpy.

Defined cases: ``und`` with score 0 for a null text or one without a letter;
languages are those of training rows; with none, everything is ``und``; rows
with equal ids are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm import common

BUCKET_BITS, DIM = 15, 16
#: Training rows of one language, and their characters, at most; a language's first row counts whatever its size.
MOST_DOCS, MOST_CHARS = 1_000, 800_000
#: Subwords' worth of an even guess that is mixed into each score, so that a few letters are not certain.
FLAT = 4
#: Share of the rightly told texts set aside that the rejection threshold gives up.
REJECTED = 0.01
_MIX = np.uint32(2654435761)
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)] + [0], dtype=np.uint32)


def buckets(text: str) -> np.ndarray:
    """Hash buckets of all subwords of a text."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = _PLAIN[np.minimum(a, 128)]
    a = np.where(a < 128, plain, a)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    out, h = [], a
    for n in (2, 3, 4):
        if len(a) < n:
            break
        h = (h[:-1] * np.uint32(31) + a[n - 1 :]) * np.uint32(0x85EBCA6B) ^ np.uint32(n)
        out.append((h * _MIX) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, langs): embeddings times weights
    bias: np.ndarray
    temperature: float
    reject_below: float = 0.0

    def logits(self, text: str) -> tuple[np.ndarray, int]:
        """The logits, and how many subwords they rest on."""
        b = buckets(text)
        if not len(b):
            return self.bias, 0
        return self.table[b].mean(axis=0) + self.bias, len(b)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        z, n = self.logits(text)
        k, score = self.told(z, n)
        return self.langs[k], score

    def told(self, z: np.ndarray, n: int) -> tuple[int, float]:
        """The most likely language of these logits and its score, given so many subwords."""
        p = softmax(z[None] / self.temperature)[0]
        k = int(p.argmax())
        return k, float((n * p[k] + FLAT / len(p)) / (n + FLAT))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 5, rate: float = 0.5, seed: int = 3) -> Model:
    """Stochastic gradient descent over shuffled texts; every fifth text only sets the temperature and the rejection threshold."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    emb = (rng.random((1 << BUCKET_BITS, DIM), dtype=np.float32) - 0.5) / DIM
    w, b = np.zeros((DIM, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    rows = [np.unique(buckets(t), return_counts=True) for t in texts]
    sizes = [int(c.sum()) for _, c in rows]
    rows = [(k, (c / c.sum()).astype(np.float32)) for k, c in rows]
    aside = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    steps, total = 0, epochs * max(1, int((~aside).sum()))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if aside[i] or not len(rows[i][0]):
                continue
            k, c = rows[i]
            lr = rate * (1 - steps / total) + 1e-3
            steps += 1
            mean = c @ emb[k]
            g = softmax((mean @ w + b)[None])[0]
            g[y[i]] -= 1
            back = w @ g
            w -= lr * np.outer(mean, g)
            b -= lr * 0.1 * g
            emb[k] -= (lr * 10) * c[:, None] * back
    model = Model(names, emb @ w, b, 1.0)
    check = np.flatnonzero(aside)
    if len(check):
        z = np.array([c @ model.table[k] + b for k, c in (rows[i] for i in check)])
        nll = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), y[check]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=nll))
        told = [(model.told(row, sizes[i]), y[i]) for row, i in zip(z, check)]
        if right := [score for (k, score), want in told if k == want]:
            model.reject_below = float(np.quantile(right, REJECTED, method="lower"))
    return model


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> Model:
    key = F.xxhash64(F.col(id_col).cast("string"))
    pool = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, folds, fold)).select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), key.alias("h"))
    # rows of a language below a hash bound that leaves about twice MOST_DOCS of them: a common language is no large group
    bounds = pool.groupBy("lang").count().select("lang", (F.lit(2.0 * MOST_DOCS) / F.col("count")).alias("share"))
    # a row a language, as in the model itself; so the pool is not dealt by language
    few = pool.join(F.broadcast(bounds), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ids = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i"))).where(F.col("r") <= MOST_DOCS).select("i", "lang", "r")
    # at most MOST_DOCS ids a language; the texts stay where they are until then
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(ids), ["i", "lang"]).orderBy("r", "lang", "i")
    texts, langs, sizes = [], [], {}
    for r in rows.toLocalIterator():
        if has_letter(r.t) and (r.lang not in sizes or sizes[r.lang] + len(r.t) <= MOST_CHARS):
            texts.append(r.t)
            langs.append(r.lang)
            sizes[r.lang] = sizes.get(r.lang, 0) + len(r.t)
    return fit(texts, langs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_below: float | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; the threshold is the model's by default."""
    reject_below = model.reject_below if reject_below is None else reject_below

    def make():
        def work(keys, texts):
            got = [model.predict(t) for t in texts]
            return {"doc_id": keys, "lang_pred": [x for x, _ in got], "score": [p for _, p in got], "rejected": [x == "und" or p < reject_below for x, p in got]}

        return work

    found = common.map_texts(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, "doc_id long, lang_pred string, score double, rejected boolean", make)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
