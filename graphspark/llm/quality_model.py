"""Quality scores by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts train a linear model over
binned text statistics with the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

logistic loss, Adam steps; while the second term is below zero, a step only
undoes it.  The class prior is the share of positives among judged training
rows unless given.  A logistic map fitted on judged training rows turns the
margin into a probability.

The fit sees a bounded sample (MOST_POSITIVE, MOST_UNLABELLED, MOST_JUDGED rows
with the least hash of their id); scoring sees every whole text.

Defined cases: a null text is an empty one and gets a score too; labels that
are null or belong to no document teach nothing; without positives every score
is the prior (1 if that is unknown); rows with equal ids are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm import common
from graphspark.llm.quality_rules import _CLASSES, _FOLD, repeated_words

MOST_POSITIVE, MOST_UNLABELLED, MOST_JUDGED = 8_000, 16_000, 8_000
BINS = 12
N_FEATURES = len(_CLASSES) + 13


def features(text: str | None) -> list[float]:
    """Statistics of a whole text: shares of character classes, of words and of lines."""
    raw = (text or "").encode()
    own = raw.split()
    n = len(own)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _FOLD
    shares = counts / max(1, counts.sum())
    if not n:
        return [*shares, *[0.0] * 13]
    seen: dict = {}
    new = seen.setdefault
    ids = np.fromiter([new(w, len(seen)) for w in own], dtype=np.int64, count=n)
    size = np.fromiter(map(len, own), dtype=np.int64, count=n)
    last = np.fromiter([w[-1] for w in own], dtype=np.uint8, count=n)
    first = np.fromiter([w[0] for w in own], dtype=np.uint8, count=n)
    times = np.bincount(ids)
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    upper = (first >= 65) & (first <= 90)
    return [
        *shares,
        np.log1p(n), len(seen) / n, len(seen) / np.sqrt(n), times.max() / n, float(size.mean()), float((size == 1).mean()),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        float(np.isin(last, _TAIL).mean()), float((last == 33).mean()), float(upper.mean()),
        repeated_words(ids) / n if len(seen) < n else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / n,
    ]


_TAIL = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


@dataclass
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def onehot(self, x: np.ndarray) -> np.ndarray:
        """Columns that each row sets: one for each feature."""
        cols = np.empty(x.shape, dtype=np.int64)
        for k in range(x.shape[1]):
            cols[:, k] = np.searchsorted(self.edges[k], x[:, k], side="right") + k * BINS
        return cols

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.onehot(x)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def nn_risk(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk, and the gradient by each margin that a step descends."""
    loss = lambda z: np.logaddexp(0, -z)  # noqa: E731  of label +1 at margin z
    n_p, n_u = len(margin_p), len(margin_u)
    rest = loss(-margin_u).mean() - prior * loss(-margin_p).mean()
    g_u, g_p_minus = _sigmoid(margin_u) / n_u, -prior * _sigmoid(margin_p) / n_p
    g_p_plus = -prior * _sigmoid(-margin_p) / n_p
    risk = prior * loss(margin_p).mean() + max(0.0, rest)
    if rest >= 0:
        return risk, g_p_plus + g_p_minus, g_u
    return risk, -g_p_minus, -g_u


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, x_j: np.ndarray | None = None, y_j: np.ndarray | None = None, epochs: int = 30, batch: int = 1024, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """x_p: trusted positives, x_u: unlabelled, x_j with y_j: judged rows for the probability map."""
    x = np.concatenate([x_p, x_u])
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy() if len(x) else np.zeros((N_FEATURES, BINS - 1))
    n_w = N_FEATURES * BINS
    model = Model(edges, np.zeros(n_w), 0.0, 1.0, 0.0, prior)
    if not len(x_p) or not len(x_u):
        model.slope, model.shift = 0.0, float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
        return model
    rng, w = np.random.default_rng(seed), np.zeros(n_w + 1)
    c_p, c_u = model.onehot(x_p), model.onehot(x_u)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, -(-len(x_u) // batch))
    for _ in range(epochs):
        part_p, part_u = np.array_split(rng.permutation(len(c_p)), min(steps, len(c_p))), np.array_split(rng.permutation(len(c_u)), steps)
        for k in range(steps):
            a, b = c_p[part_p[k % len(part_p)]], c_u[part_u[k]]
            _, g_p, g_u = nn_risk(w[a].sum(axis=1) + w[-1], w[b].sum(axis=1) + w[-1], prior)
            g = np.bincount(a.ravel(), np.repeat(g_p, a.shape[1]), n_w + 1) + np.bincount(b.ravel(), np.repeat(g_u, b.shape[1]), n_w + 1) + decay * w
            g[-1] = g_p.sum() + g_u.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])
    if x_j is not None and len(set(np.asarray(y_j).tolist())) == 2:
        model.slope, model.shift = _platt(model.margin(x_j), np.asarray(y_j, dtype=float))
    return model


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic map, by Newton steps; the slope stays positive."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.array([1.0, 0.0])
    d = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(steps):
        p = _sigmoid(d @ a)
        h = d.T @ (d * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, d.T @ (p - target))
        a -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return max(float(a[0]), 1e-3), float(a[1])


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None, folds: int = 5) -> Model:
    """Fit on bounded samples of rows that are not held out."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    judged = labels.where(~held_out(id_col, folds) & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"), key.alias("h"))
    share = judged.agg(F.avg("y"), F.count("y")).first()
    if prior is None:
        prior = min(0.999, max(0.001, share[0])) if share[1] else 0.999
    take = lambda df, n, role: df.orderBy("h", "i").limit(n).select("i", "y", F.lit(role).alias("role"))
    unlabelled = docs.where(~held_out(id_col, folds)).select(F.col(id_col).cast("long").alias("i"), F.lit(0).alias("y"), key.alias("h"))
    sample = take(judged.where("y = 1"), MOST_POSITIVE, "p").union(take(judged, MOST_JUDGED, "j")).union(take(unlabelled, MOST_UNLABELLED, "u"))
    texts = docs.where(~held_out(id_col, folds)).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    # at most the three bounds together, ids and flags only
    rows = texts.join(F.broadcast(sample.groupBy("i").agg(F.collect_set("role").alias("roles"), F.max("y").alias("y"))), "i")
    keyed = rows.select(F.to_json(F.struct("i", "roles", "y")).alias("k"), "t")
    made = map_features(keyed).collect()  # bounded as the sample
    import json

    heads = [json.loads(r.k) for r in made]
    order = sorted(range(len(made)), key=lambda k: heads[k]["i"])
    x = np.array([made[k].x for k in order], dtype=float).reshape(-1, N_FEATURES)
    has = lambda role: np.array([role in heads[k]["roles"] for k in order], dtype=bool)
    y = np.array([heads[k].get("y", 0) for k in order])
    return fit(x[has("p")], x[has("u")], prior, x[has("j")], y[has("j")])


def map_features(rows: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "t"):
                x = [features(t) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(x, pa.list_(pa.float64()))], names=["k", "x"])

    common.importable(rows.sparkSession)
    return rows.mapInArrow(run, "k string, x array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def make():
        def work(keys, texts):
            x = np.array([features(t) for t in texts], dtype=float).reshape(-1, N_FEATURES)
            return {"doc_id": keys, "score": model.score(x)}

        return work

    found = common.map_texts(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, "doc_id long, score double", make)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
