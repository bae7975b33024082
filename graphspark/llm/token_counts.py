"""Token counts of the parts of documents, from one encoding of the whole.

The parts (lines of a text, or several columns joined) are character intervals
that tile the whole.  The whole is encoded once; tokens are matched to parts by
binary search over the intervals.  A token that crosses a boundary goes by an
explicit rule:

    first   to the part that holds its first character (default)
    last    to the part that holds its last character
    most    to the part with most of its characters, the earlier at a tie
    share   to each part the share of its characters (fractions)

A token's characters are those it has bytes of; under ``share`` tokens of one
character's bytes each count whole.

Defined cases: a null or empty text is one empty part without tokens; rows with
equal ids keep their own rows; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm import common
from graphspark.llm.tokens import Encoder

RULES = ("first", "last", "most", "share")


def line_starts(text: str) -> list[int]:
    """A line holds its own line feed."""
    out, at = [0], text.find("\n") + 1
    while at and at < len(text):
        out.append(at)
        at = text.find("\n", at) + 1
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, parts: np.ndarray, size: int, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens that touch it) of each part.

    ``starts`` and ``ends``: token intervals in ascending order; ``parts``: where each part
    starts, from 0 on; ``size``: the end of the last part.
    """
    n = len(parts)
    first, last = np.searchsorted(parts, starts, side="right") - 1, np.searchsorted(parts, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(first if rule != "last" else last, minlength=n).astype(float)
    touched = np.zeros(n, dtype=np.int64)
    edge = np.append(parts, size)
    for k in crossing.tolist():
        own = range(int(first[k]), int(last[k]) + 1)
        for p in own:
            touched[p] += 1
        if rule in ("most", "share"):
            held = [min(int(ends[k]), int(edge[p + 1])) - max(int(starts[k]), int(edge[p])) for p in own]
            counts[first[k]] -= 1
            if rule == "most":
                counts[own[held.index(max(held))]] += 1
            else:
                for p, h in zip(own, held):
                    counts[p] += h / (ends[k] - starts[k])
    return counts, touched


def count_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", tokenizer_path: str | None = None) -> DataFrame:
    """A row for each line of each text: doc_id, part, start, length (characters), n_tokens, n_crossing."""
    return _count(docs, id_col, [F.col(text_col)], None, rule, tokenizer_path)


def count_fields(docs: DataFrame, id_col: str, fields: list[str], separator: str = "\n", rule: str = "first", tokenizer_path: str | None = None) -> DataFrame:
    """A row for each of the columns, joined in order; a column holds the separator after it."""
    return _count(docs, id_col, [F.col(c).cast("string") for c in fields], separator, rule, tokenizer_path)


def _count(docs, id_col, cols, separator, rule, path):
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    # fields travel in one array column; lines in a text column
    rows = docs.select(F.col(id_col).cast("long").alias("i"), (cols[0] if separator is None else F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in cols]))).alias("t"))

    def make():
        import json

        enc = Encoder.of(path)

        def work(keys, texts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "part", "start", "length", "n_tokens", "n_crossing")}
            for key, text in zip(keys, texts):
                text = text or ""
                if separator is None:
                    at = line_starts(text)
                else:
                    values = json.loads(text)
                    at = np.cumsum([0, *(len(v) + len(separator) for v in values[:-1])]).tolist()
                    text = separator.join(values)
                _, lo, hi = enc.spans(text)
                counts, touched = allocate(lo, hi, np.array(at), len(text), rule)
                out["doc_id"] += [key] * len(at)
                out["part"] += range(len(at))
                out["start"] += at
                out["length"] += np.diff(at, append=len(text)).tolist()
                out["n_tokens"] += counts.tolist()
                out["n_crossing"] += touched.tolist()
            return out

        return work

    found = common.map_texts(rows, "i", "t", "doc_id long, part long, start long, length long, n_tokens double, n_crossing long", make)
    return found if rule == "share" else found.withColumn("n_tokens", F.col("n_tokens").cast("long"))
