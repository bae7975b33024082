"""Conversations as training texts with loss masks aligned to token offsets.

A turn is written as  OPEN role MIDDLE text CLOSE.  The three control strings
are tokens of their own, so no other token crosses them.  Inside roles and
texts a control string gets a backslash after its first character, one that
has k such backslashes gets k + 1; that is undone by taking one away.

Turns stream in order through a task (partitioned by conversation, sorted by
turn).  A conversation is rendered whole and encoded once; one of more than
SEGMENT_CHARS characters goes out in segments that end between turns, where
texts and ids just follow each other, so a task never holds a conversation of
any length at once.  Loss spans are those of the assistant's texts; sorted
turn spans are matched to token spans by binary search.

Defined cases: null roles and texts are empty; turns without a conversation id
form one conversation; a null turn number comes first, equal numbers are
ordered by role and text; repeated rows stay; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm import common
from graphspark.llm.tokens import Encoder

SEGMENT_CHARS = 1_000_000
SCHEMA = "conv_id long, segment long, last boolean, n_turns long, text string, ids array<int>, loss_tokens array<int>"


class Template:
    """Control strings of a chat format."""

    def __init__(self, opening: str = "[INST]", middle: str = "[/INST]", closing: str = "</s>", learned: tuple[str, ...] = ("assistant",)):
        self.control, self.learned = (opening, middle, closing), learned
        for a in self.control:
            for b in self.control:
                if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")
                if "\\" in a or len(a) < 2:
                    raise ValueError(f"not a control string: {a!r}")
        first = "|".join(sorted({re.escape(c[0]) for c in self.control}))
        rest = "|".join(re.escape(c[1:]) for c in self.control)
        self._plain = re.compile(rf"({first})(\\*)(?={rest})")
        self._escaped = re.compile(rf"({first})(\\*)\\(?={rest})")

    def escape(self, text: str | None) -> str:
        return self._plain.sub(r"\1\2\\", text) if text else ""

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1\2", text)

    def render(self, role: str | None, text: str | None) -> tuple[str, int, int]:
        """The turn, and where its text lies in it."""
        a, b, c = self.control
        head = a + self.escape(role) + b
        body = self.escape(text)
        return head + body + c, len(head), len(head) + len(body)

    def parse(self, rendered: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a rendered text."""
        a, b, c = self.control
        out = []
        for part in rendered.split(c)[:-1]:
            role, text = part[len(a) :].split(b)
            out.append((self.unescape(role), self.unescape(text)))
        return out

    def tokenizer(self, path: str | None = None) -> Encoder:
        return Encoder.of(path, self.control)


def loss_runs(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Token runs (first, end, first, end, ...) inside the sorted character spans; empty ones are left out."""
    at = np.array([s for s in spans if s[1] > s[0]], dtype=np.int64).reshape(-1, 2)
    return np.stack([np.searchsorted(starts, at[:, 0], side="left"), np.searchsorted(ends, at[:, 1], side="right")], axis=1).ravel()


def format_conversations(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer_path: str | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Rows of SCHEMA; a conversation's segments are numbered from 0 on, in any order of rows.

    ``loss_tokens`` are the runs of ``ids`` under the loss mask: first, end, first, end, ...
    """
    template = template or Template()
    common.importable(turns.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def run(batches):
        enc = template.tokenizer(tokenizer_path)
        rows: list[tuple] = []
        conv, seg, parts, spans, size, n, any_yet = None, 0, [], [], 0, 0, False

        def close(last: bool):
            text = "".join(parts)
            ids, starts, ends = enc.spans(text)
            rows.append((conv, seg, last, n, text, ids.astype(np.int32), loss_runs(starts, ends, spans).tolist()))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for got in batches:
            for c, role, text in zip(*(got.column(k).to_pylist() for k in ("c", "r", "t"))):
                if any_yet and c != conv:
                    close(True)
                    seg, parts, spans, size, n = 0, [], [], 0, 0
                elif size > segment_chars:
                    close(False)
                    seg, parts, spans, size, n = seg + 1, [], [], 0, 0
                conv, any_yet = c, True
                rendered, lo, hi = template.render(role, text)
                if role in template.learned:
                    spans.append((size + lo, size + hi))
                parts.append(rendered)
                size += len(rendered)
                n += 1
                if len(rows) >= 500 or sum(len(r[4]) for r in rows[-3:]) > segment_chars:
                    yield batch()
        if any_yet:
            close(True)
            yield batch()

    ordered = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("n"), F.col(role_col).alias("r"), F.col(text_col).alias("t")).repartition("c").sortWithinPartitions("c", "n", "r", "t")
    return ordered.select("c", "r", "t").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, template: Template | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Digests of what the formatted rows hold, in whatever order they were stored.

    Turns are parsed from the text; the text under the mask is found from the ids' own bytes.
    """
    template = template or Template()
    common.importable(formatted.sparkSession)
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")

    def run(batches):
        lib = template.tokenizer(tokenizer_path).lib
        state = None
        for got in batches:
            rows = []
            for r in got.to_pylist():
                if state is None:
                    state = {"conv": r["conv_id"], "segment": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "lc": 0, "fc": 0, "nt": 0}
                if (r["conv_id"], r["segment"]) != (state["conv"], state["segment"]):
                    raise ValueError(f"conversation {state['conv']}: segment {state['segment']} is missing")
                state["segment"] += 1
                for role, text in template.parse(r["text"]):
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                runs = r["loss_tokens"]
                for lo, hi in zip(runs[::2], runs[1::2]):
                    text = template.unescape(lib.decode(r["ids"][lo:hi], skip_special_tokens=False))
                    state["loss"].update(text.encode())
                    state["lc"] += len(text)
                state["fc"] += len(r["text"])
                state["nt"] += len(r["ids"])
                if r["last"]:
                    rows.append((r["conv_id"], state["n"], state["turns"].hexdigest(), state["lc"], state["loss"].hexdigest(), state["fc"], state["nt"]))
                    state = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=list(names))
        if state is not None:
            raise ValueError(f"conversation {state['conv']}: its last segment is missing")

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
