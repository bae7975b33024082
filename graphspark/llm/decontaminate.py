"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are normalised to words and put into one automaton (a state for each
class of substrings that end at the same places).  Documents stream through it
word by word; the length of the longest suffix that occurs in some item says
which words lie inside an occurrence of a window.  A window is ``window``
consecutive words of an item, or the whole item where it is shorter.

Documents never leave their task.  The items are gathered in chunks of at most
CHUNK_WORDS words: the automaton of one chunk, at most two states a word, is
what a task holds; a larger benchmark takes one pass over the documents for
each chunk, and the hits are merged.

Defined cases: null, empty and wordless texts have no words and no hits; items
that are null or wordless give no window; rows with equal ids keep their own
results; equal items each count; no items: nothing is hit.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm import common

#: Words of items in one automaton.
CHUNK_WORDS = 1_000_000
#: Bytes that belong to words; A-Z count as a-z.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Column of the hit words of the chunks so far, while texts are cleaned.
_SPANS = "_spans"
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<long>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


class Automaton:
    """Generalised suffix automaton over lists of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: dict[int, set] = {}  # items that have the state's words somewhere, by prefix state first
        self.short: dict[int, set] = {}  # items that are a window themselves
        self.least = window
        same: dict[tuple, list[str]] = {}  # items of equal words are one, however many there are
        for name, own in items:
            if own:
                same.setdefault(tuple(own), []).append(name)
        for k, own in enumerate(same):
            last = 0
            for w in own:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                self.ends.setdefault(last, set()).add(k)
            if len(own) < window:
                self.short.setdefault(last, set()).add(k)
                self.least = min(self.least, len(own))
        self.names = list(same.values())
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if v in self.ends and self.len[self.link[v]] >= window:  # shorter states' items are never asked for
                self.ends.setdefault(self.link[v], set()).update(self.ends[v])
        self.known: dict[tuple[int, bool], tuple[int, frozenset]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if ln[last] + 1 == ln[q] else self._clone(last, c, q)
        cur = len(ln)
        nxt.append({})
        link.append(0)
        ln.append(ln[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if ln[p] + 1 == ln[q] else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(self.len)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.len.append(self.len[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _at(self, v: int, long: bool) -> tuple[int, frozenset]:
        """Words before this place inside a window that ends here, and the items of the windows.

        v holds the longest match with all its words (length len[v]), or a part of it, if long, of ``window`` words at least.
        """
        if (got := self.known.get((v, long))) is None:
            cover, found = 0, set()
            if long:
                u = v
                while self.len[self.link[u]] >= self.window:
                    u = self.link[u]
                cover = self.window
                found |= self.ends[u]
            u = v
            while u > 0:
                if u in self.short:
                    cover = max(cover, self.len[u])
                    found |= self.short[u]
                u = self.link[u]
            got = self.known[v, long] = cover, frozenset(found)
        return got

    def hits(self, own: list[bytes]) -> tuple[np.ndarray, set]:
        """(start, end) of the maximal runs of hit words, and the names of the items."""
        n = len(own)
        runs: list[list[int]] = []
        found: set = set()
        if n >= self.least and self.vocab:
            get = self.vocab.get
            ids = np.fromiter((get(w, -1) for w in own), dtype=np.int32, count=n)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]]).astype(np.int8)))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):  # only words of the items can match
                if hi - lo >= self.least:
                    self._run(ids[lo:hi].tolist(), lo, runs, found)
        return np.array(runs, dtype=np.int64).reshape(-1, 2), {name for k in found for name in self.names[k]}

    def _run(self, ids: list[int], base: int, runs: list, found: set) -> None:
        nxt, link, ln, least, window = self.next, self.link, self.len, self.least, self.window
        v = l = 0
        for i, w in enumerate(ids, base + 1):
            while v and w not in nxt[v]:
                v = link[v]
                l = ln[v]
            if w in nxt[v]:
                v = nxt[v][w]
                l += 1
            if l >= least:
                # a whole item that is the state's longest string is matched only in full
                u = link[v] if l < ln[v] and v in self.short else v
                cover, items = self._at(u, l >= window)
                if cover:
                    if items:
                        found |= items
                    if runs and runs[-1][1] >= i - cover:
                        runs[-1][0] = min(runs[-1][0], i - cover)
                        runs[-1][1] = i
                        while len(runs) > 1 and runs[-2][1] >= runs[-1][0]:
                            lo = min(runs[-2][0], runs[-1][0])
                            runs.pop()
                            runs[-1] = [lo, i]
                    else:
                        runs.append([i - cover, i])


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """For each document: n_words, n_hit, items (sorted), spans (hit words: start, end, start, end, ...)."""
    common.importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<long>").alias("spans"))
    chunks = item_chunks(items, item_id, item_text, chunk_words)
    chunk = next(chunks)
    while (following := next(chunks, None)) is not None:
        rows = common.persisted(_scan(rows, chunk, window, False), "decontaminate")
        chunk = following
    return _scan(rows, chunk, window, True)


def item_chunks(items: DataFrame, item_id: str, item_text: str, chunk_words: int):
    """The items' words in chunks of at most ``chunk_words`` (an item alone may have more); one chunk at least."""
    chunk, size = [], 0
    for name, text in items.select(F.col(item_id).cast("string"), item_text).toLocalIterator():
        own = words(text)
        if chunk and size + len(own) > chunk_words:
            yield chunk
            chunk, size = [], 0
        chunk.append((name or "", own))
        size += len(own)
    yield chunk


def _scan(rows: DataFrame, chunk: list, window: int, last: bool) -> DataFrame:
    held, token = rows.sparkSession.sparkContext.broadcast(chunk), uuid.uuid4().hex

    def run(batches):
        common.claim("decontaminate", _built.clear)
        if token not in _built:
            _built.clear()
            _built[token] = Automaton(held.value, window)
        hits = _built[token].hits
        for whole in batches:
            for batch in common.slices(whole, "t"):
                n_words, n_hit, names, spans = [], [], [], []
                for text, old, at in zip(*(batch.column(c).to_pylist() for c in ("t", "items", "spans"))):
                    own = words(text)
                    runs, found = hits(own)
                    if at:
                        runs = _merged(np.concatenate([runs, np.array(at).reshape(-1, 2)]))
                    n_words.append(len(own))
                    n_hit.append(int((runs[:, 1] - runs[:, 0]).sum()))
                    names.append(sorted(found.union(old or ())))
                    spans.append(runs.ravel().tolist())
                found = [pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
                mid = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())] if last else [batch.column("t")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *mid, *found], names=["doc_id", *(["n_words", "n_hit"] if last else ["t"]), "items", "spans"])

    return rows.mapInArrow(run, SCHEMA if last else "doc_id long, t string, items array<string>, spans array<long>")


_built: dict = {}


def _merged(runs: np.ndarray) -> np.ndarray:
    """Sorted runs in which those that touch are one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > ends[:-1]])
    return np.stack([runs[new, 0], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]], axis=1)


def digest(found: DataFrame) -> DataFrame:
    """The columns that a report of hits needs."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, most_covered: float = 0.5, least_run: int = 1, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Documents without what the items share with them; columns are kept.

    Runs of at least ``least_run`` hit words (by default all) are cut from the text (with what lies between
    their words); a document of which more than ``most_covered`` of the words are hit goes.  The runs of all
    chunks of items are found on the whole text and merged before that.
    """
    common.importable(docs.sparkSession)
    schema, chars = docs.schema, "n_chars" in docs.columns

    def scan(rows, chunk, last):
        held, token = rows.sparkSession.sparkContext.broadcast(chunk), uuid.uuid4().hex

        def run(batches):
            common.claim("decontaminate", _built.clear)
            if token not in _built:
                _built.clear()
                _built[token] = Automaton(held.value, window)
            hits = _built[token].hits
            for whole in batches:
                for batch in common.slices(whole, text_col):
                    keep, texts, spans = [], [], []
                    for text, at in zip(batch.column(text_col).to_pylist(), batch.column(_SPANS).to_pylist()):
                        own = words(text)
                        runs, _ = hits(own)
                        if at:
                            runs = _merged(np.concatenate([runs, np.array(at).reshape(-1, 2)]))
                        if last:
                            n = int((runs[:, 1] - runs[:, 0]).sum())
                            keep.append(n <= most_covered * len(own))
                            texts.append(cut(text, runs[runs[:, 1] - runs[:, 0] >= least_run]) if n else text)
                        else:
                            spans.append(runs.ravel().tolist())
                    if not last:
                        yield batch.set_column(batch.schema.get_field_index(_SPANS), _SPANS, pa.array(spans, pa.list_(pa.int64())))
                        continue
                    batch = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, batch.schema.field(text_col).type))
                    if chars:
                        sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                        batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", sizes.cast(batch.schema.field("n_chars").type))
                    yield batch.drop_columns([_SPANS]).filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, schema if last else rows.schema)

    rows = docs.withColumn(_SPANS, F.lit(None).cast("array<long>"))
    chunks = item_chunks(items, "item_id", "text", chunk_words)
    chunk = next(chunks)
    while (following := next(chunks, None)) is not None:
        rows = common.persisted(scan(rows, chunk, False), "decontaminate")
        chunk = following
    return scan(rows, chunk, True)


def cut(text: str, runs: np.ndarray) -> str:
    """The text without the words of these runs."""
    if not len(runs):
        return text
    raw, out, at = text.encode(), [], 0
    spans = [m.span() for m in _WORD.finditer(raw)]
    for lo, hi in runs.tolist():
        out.append(raw[at : spans[lo][0]])
        at = spans[hi - 1][1]
    return b"".join([*out, raw[at:]]).decode()
