"""Hierarchical packing of documents into context windows of several sizes.

A document's ids are cut into whole windows of the largest tier; the rest goes
to the smallest tier that holds it.  Each task packs its own documents from
the largest tier down: a rest opens a window of its tier, the gap is filled
with the longest shorter rests that fit, and what is left is filled by cutting
one rest.  So windows are full, and only the rests of a task's last windows
are dealt out to windows of the powers of two that add up to them: no window
holds padding.  Windows of a size, numbered over all tasks, form step groups of
equal ids (``group_ids``), so that steps cost the same: only the last group of
each size is short.

No text leaves its task: there is no shuffle of texts or ids, and any number of
copies or rows of one source spreads as the input does.  The pieces' rows are
written once, so that the numbers of windows of each task are known.

Defined cases: a null or empty text is its end id alone; rows with equal ids are
packed as documents of their own; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm import common
from graphspark.llm.tokens import Encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, capacity long, number long"
#: Rests that a task gathers before it packs them.
POOL = 2048


class Packer:
    """Packs (key, ids) documents; ``emit(window, capacity, pieces)`` gets each full window.

    A piece is (length, order, key, ids of the whole document, start).
    """

    def __init__(self, tiers: list[int], emit, pool: int = POOL):
        self.tiers, self.emit, self.most = sorted(tiers, reverse=True), emit, pool
        self.pool: list[tuple] = []
        self.order = count()

    def add(self, key, ids: np.ndarray) -> None:
        top, start = self.tiers[0], 0
        while len(ids) - start >= top:
            self.emit(top, [(top, 0, key, ids, start)])
            start += top
        if start < len(ids):
            insort(self.pool, (len(ids) - start, next(self.order), key, ids, start))
            if len(self.pool) >= self.most:
                self._pack(self.most // 4)

    def _pack(self, least: int) -> None:
        """Pack rests from the longest down until ``least`` of them or less than a window is left."""
        left = sum(p[0] for p in self.pool)
        while self.pool and len(self.pool) > least:
            head = self.pool[-1]
            size = next(t for t in reversed(self.tiers) if t >= head[0])
            while size > left and size > self.tiers[-1]:
                size = self.tiers[self.tiers.index(size) + 1]
            if size > left:
                return
            self._window(size)
            left -= size

    def _window(self, size: int) -> None:
        gap, pieces = size, []
        while gap:
            i = bisect_left(self.pool, (gap + 1,)) - 1  # the longest that fits
            if i >= 0 and (pieces or self.pool[-1][0] <= gap):
                piece = self.pool.pop(i)
            else:  # none fits: cut the shortest that is longer
                n, order, key, ids, start = self.pool.pop(i + 1 if pieces else -1)
                insort(self.pool, (n - gap, order, key, ids, start + gap))
                piece = (gap, order, key, ids, start)
            pieces.append(piece)
            gap -= piece[0]
        self.emit(size, pieces)

    def close(self) -> None:
        self._pack(0)
        left, bit = sum(p[0] for p in self.pool), 1
        while bit << 1 <= self.tiers[0]:
            bit <<= 1
        while left:
            if bit <= left:
                self._window(bit)
                left -= bit
            else:
                bit >>= 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int | None = 1, tiers: tuple[int, ...] = (2048, 1024, 512, 256), group_ids: int = 65_536) -> DataFrame:
    """Pieces of all documents in windows; every id lies in exactly one piece.

    ``tiers`` are powers of two.  ``sequence_id`` names the window, ``offset`` the piece's
    place in it, ``capacity`` the window's size, ``step_group`` windows of one step.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def make():
        enc, part = Encoder.of(tokenizer_path), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        rows: list[tuple] = []
        windows, made = count(), {}

        def emit(size: int, pieces: list[tuple]) -> None:
            seq, at = part << 32 | next(windows), 0
            k = made[size] = made.get(size, -1) + 1
            for n, _, key, ids, start in pieces:
                rows.append((key, start, n, zlib.crc32(ids[start : start + n]), len(ids), seq, at, size, k))
                at += n

        packer = Packer(list(tiers), emit)

        def take() -> dict:
            out = dict(zip(names, zip(*rows))) if rows else dict.fromkeys(names, ())
            rows.clear()
            return out

        def work(keys, texts):
            for key, text in zip(keys, texts):
                packer.add(key, np.concatenate([enc.ids(text), tail]))
            return take()

        def end():
            packer.close()
            return take()

        return work, end

    found = common.persisted(common.map_texts_to_end(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, SCHEMA, make), "packed")
    # a row for each task and size: where its windows begin among all of that size
    sizes = found.where("offset = 0").groupBy("capacity", F.shiftright("sequence_id", 32).alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("capacity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("capacity", "part", F.coalesce(before, F.lit(0)).alias("base"))
    rows = found.withColumn("part", F.shiftright("sequence_id", 32)).join(F.broadcast(starts), ["capacity", "part"])
    per_step = F.greatest(F.lit(1), F.floor(F.lit(group_ids) / F.col("capacity")))
    group = F.shiftleft(F.floor((F.col("base") + F.col("number")) / per_step).cast("long"), 5) + F.log2("capacity").cast("long")
    return rows.select(*names[:-1], group.alias("step_group"))
