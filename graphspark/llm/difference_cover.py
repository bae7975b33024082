"""Suffix order of many byte strings by the difference cover {1, 2} modulo 3, as Spark jobs.

The triples at offsets of residue 1 and 2 are sorted over range partitions and
named; the strings of names are ranked in the same way until the names are
unique or stand for ``length`` bytes; the remaining suffixes are merged by two
sorts with the ranks of the suffixes that follow them; then the ``length``-byte
prefixes of neighbours are compared.  No task holds more than one string and a
batch of rows, and a row for each partition is all that reaches the driver.

Strings end where they end, and a suffix that is a prefix of another comes
first.  Ranks count the suffixes that are less; those that share ``length``
bytes lie next to each other, in any order.

Each round shuffles 16 to 40 bytes for every suffix, so suffix_dedup uses it
only for groups that are too large for one task.

Defined cases: an empty table or empty strings give no rows; equal strings are
ranked each; null strings count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm import common


def edges(*cols: np.ndarray, before=None) -> np.ndarray:
    """Whether each row differs from the one before it (``before`` for the first) in these columns."""
    out = np.zeros(len(cols[0]), dtype=bool)
    for k, x in enumerate(cols):
        out[1:] |= x[1:] != x[:-1]
        out[:1] |= before is None or x[:1] != before[k]
    return out


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(n)) for n in names]


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))


def _symbols(raw: bytes | None, width: int) -> np.ndarray:
    """A string's symbols from 1 on: bytes plus 1, or names."""
    x = np.frombuffer(raw or b"", f"<u{width}").astype(np.int64)
    return x + 1 if width == 1 else x


def _less(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, bool]:
    """(p, o, kind, less0, less1): rows of kind 0 and of kind 1 with less keys; and whether all keys are different."""

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        seen, start = np.zeros(2, dtype=np.int64), np.zeros(2, dtype=np.int64)  # rows so far, and before the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            p, o, kind, *key = _columns(batch, "p", "o", "kind", *keys)
            new = edges(*key, before=last)
            last = [k[-1] for k in key]
            at = np.maximum.accumulate(np.where(new, np.arange(len(p)), -1))
            out = []
            for k in (0, 1):
                own = kind == k
                before = seen[k] + np.cumsum(own) - own
                out.append(np.where(at >= 0, before[np.maximum(at, 0)], start[k]))
                start[k], seen[k] = out[k][-1], seen[k] + own.sum()
            yield _batch({"part": np.full(len(p), part, dtype=np.int32), "new": new, "p": p, "o": o, "kind": kind, "less0": out[0], "less1": out[1]})

    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    done = common.persisted(dealt.mapInArrow(run, "part int, new boolean, p long, o long, kind int, less0 long, less1 long"), name)
    sizes = done.groupBy("part").agg(F.count_if(F.col("kind") == 0).alias("a"), F.count_if(F.col("kind") == 1).alias("b"), F.count_if("new").alias("new")).orderBy("part").collect()  # a row a partition
    base, a, b = [], 0, 0
    for r in sizes:
        base.append((r["part"], a, b))
        a, b = a + r["a"], b + r["b"]
    offsets = done.sparkSession.createDataFrame(base, "part int, a long, b long")
    placed = done.join(F.broadcast(offsets), "part")  # a row a partition
    return placed.select("p", "o", "kind", (F.col("less0") + F.col("a")).alias("less0"), (F.col("less1") + F.col("b")).alias("less1")), sum(r["new"] for r in sizes) == a + b


def ranks(strings: DataFrame, length: int, width: int = 1, covers: int = 1) -> DataFrame:
    """(p, o, r) for the suffix of string p (columns p long, x binary) from each offset o, r from 1 on.

    ``covers``: bytes that a symbol of ``width`` bytes stands for.
    """

    def triples(batches):
        for batch in batches:
            for p, raw in zip(batch.column("p").to_pylist(), batch.column("x").to_pylist()):
                x = np.append(_symbols(raw, width), [0, 0, 0])
                o = np.concatenate([np.arange(k, len(x) - 3, 3) for k in (1, 2)])
                if len(o):
                    yield _batch({"p": np.full(len(o), p), "o": o, "kind": np.zeros(len(o), dtype=np.int32), "a": x[o], "b": x[o + 1], "c": x[o + 2]})

    common.importable(strings.sparkSession)
    counted, unique = _less(strings.mapInArrow(triples, "p long, o long, kind int, a long, b long, c long"), ["a", "b", "c"], "triples")
    names = counted.select("p", "o", (F.col("less0") + 1).alias("r"))
    if not unique and 3 * covers < length:

        def joined(batches):
            for batch in batches:
                yield _batch({"p": batch.column("p"), "x": pa.array([np.array([v["r"] for v in row], dtype="<i8").tobytes() for row in batch.column("v").to_pylist()], pa.binary())})

        # the names of each residue are a string of their own
        lists = names.groupBy((F.col("p") * 2 + F.col("o") % 3 - 1).alias("p")).agg(F.sort_array(F.collect_list(F.struct("o", "r"))).alias("v"))
        inner = ranks(common.persisted(lists.mapInArrow(joined, "p long, x binary"), "names"), length, 8, 3 * covers)
        names = inner.select(F.shiftright("p", 1).alias("p"), (F.col("o") * 3 + 1 + F.pmod("p", F.lit(2))).alias("o"), "r")
    names = common.persisted(names, "ranks")

    def keys(residue: int):
        """Suffixes of residue 0 (kind 0) and of ``residue`` (kind 1): the symbols before a ranked suffix, and its rank."""

        def run(batches):
            for batch in batches:
                for p, raw, v in zip(*(batch.column(c).to_pylist() for c in ("p", "x", "v"))):
                    x = np.append(_symbols(raw, width), [0, 0, 0])
                    n = len(x) - 3
                    rank = np.zeros(n + 3, dtype=np.int64)
                    for r in v or ():
                        rank[r["o"]] = r["r"]
                    o = np.concatenate([np.arange(0, n, 3), np.arange(residue, n, 3)])
                    if len(o):
                        second = x[o + 1] if residue == 2 else np.zeros(len(o), dtype=np.int64)
                        yield _batch({"p": np.full(len(o), p), "o": o, "kind": (o % 3 > 0).astype(np.int32), "a": x[o], "b": second, "c": rank[o + residue]})

        return run

    known = strings.join(names.groupBy("p").agg(F.collect_list(F.struct("o", "r")).alias("v")), "p", "left").select("p", "x", "v")
    parts = [names.select("p", "o", (F.col("r") - 1).alias("n"))]
    for residue in (1, 2):
        got, _ = _less(known.mapInArrow(keys(residue), "p long, o long, kind int, a long, b long, c long"), ["a", "b", "c"], "merge")
        own = F.col("less0") + F.col("less1") if residue == 1 else F.col("less1")
        parts.append(got.select("p", "o", F.when(F.col("kind") == 0, own).otherwise(F.col("less0")).alias("n")))
    return parts[0].union(parts[1]).union(parts[2]).groupBy("p", "o").agg((F.sum("n") + 1).alias("r"))


def classes(strings: DataFrame, length: int) -> DataFrame:
    """(p, o, class): a class for each offset from which string p has ``length`` bytes, equal where those are."""
    listed = strings.join(ranks(strings, length).groupBy("p").agg(F.collect_list(F.struct("o", "r")).alias("v")), "p").select("p", "x", "v")

    def windows(batches):
        for batch in batches:
            for p, raw, v in zip(*(batch.column(c).to_pylist() for c in ("p", "x", "v"))):
                own = [(p, r["o"], r["r"], raw[r["o"] : r["o"] + length]) for r in v if r["o"] + length <= len(raw)]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), (*[pa.int64()] * 3, pa.binary()))], names=["p", "o", "r", "w"])

    def compared(batches):
        part, last, k = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            w = batch.column("w").to_pylist()
            own = np.empty(len(w), dtype=np.int64)
            ends = []
            for i, x in enumerate(w):
                k += x != last
                ends.append(x if x != last else None)
                last = x
                own[i] = k
            yield _batch({"part": np.full(len(w), part, dtype=np.int32), "p": batch.column("p"), "o": batch.column("o"), "k": own, "w": pa.array(ends, pa.binary())})

    rows = listed.mapInArrow(windows, "p long, o long, r long, w binary").repartitionByRange("r").sortWithinPartitions("r")
    done = common.persisted(rows.mapInArrow(compared, "part int, p long, o long, k long, w binary"), "classes")
    # the first and the last prefix of each partition: a class may go on in the next one
    ends = done.where("w is not null").groupBy("part").agg(F.min_by("w", "k").alias("first"), F.max_by("w", "k").alias("last"), F.max("k").alias("k")).orderBy("part").collect()
    base, at, last = [], 0, None
    for r in ends:
        at -= last is not None and bytes(r["first"]) == last
        base.append((r["part"], at))
        at, last = at + r["k"] + 1, bytes(r["last"])
    offsets = done.sparkSession.createDataFrame(base, "part int, at long")
    return done.join(F.broadcast(offsets), "part").select("p", "o", (F.col("k") + F.col("at")).alias("class"))  # a row a partition
