"""Removal of byte strings that occur before, by sorted suffixes.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier (smaller document id, or the same document and an earlier start).

A suffix array of the whole corpus would send every suffix through several
shuffles, so the suffixes are first dealt into independent groups:

1. Each window of ``length`` bytes names its anchor, the least hash among its
   GRAM-byte strings.  Equal windows name equal anchors at equal places, so
   only suffixes of one anchor can share ``length`` bytes.  One row for each
   anchor and the run of windows that name it (about 2 rows for each
   ``length`` bytes) is shuffled by the anchor's hash.
2. Runs whose whole context is equal need no sorting: all but the first repeat.
   Each batch settles its own before the shuffle, so a string that is in a third
   of the rows is a few rows there.  An anchor that occurs once has no repeat.
3. The first contexts of anchors that have several different ones are sorted by
   the difference-cover algorithm: sort the triples at positions of residue 1
   and 2, recurse on their names, merge the remaining suffixes, then compare
   the ``length``-byte prefixes of neighbours.  A context goes to the left or
   the right half of its windows, by the bytes that all of them share beside
   the anchor, so that common short strings do not gather unlike contexts.
   Groups of more than GROUP_BYTES are sorted by ``difference_cover``, in which
   no task holds a group.
4. What step 2 found equal by hash is joined to the longest runs, and each run is
   compared with its source by the SHA-256 of both byte strings; if any differ,
   the job fails and nothing is removed.  Step 3 compares bytes.

Defined cases: null is an empty text; texts shorter than ``length`` keep all;
matches never cross documents; rows of equal id and text count as one
document, so each gets the same result; rows of equal id (or of null id) whose
texts differ are documents of their own, neither earlier than the other; a null
id counts as smaller than all others; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from graphspark.llm import common, difference_cover
from graphspark.llm.difference_cover import edges

LENGTH, GRAM = 100, 24
#: Window starts of one block, and context bytes that are sorted at once (whole groups).
BLOCK, SORT_BYTES = 100_000, 1_000_000
#: Context bytes of a group that one task may hold.
GROUP_BYTES = 4_000_000
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 17) - 1)


def _powers(x: int, n: int) -> np.ndarray:
    a = np.full(n, x % 2**64, dtype=np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


_SPAN = BLOCK + 300
_POW, _INV = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 2**64), _SPAN)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first start, last start, place of the anchor) of each run of windows."""
    n_windows = len(raw) - length + 1
    width = length - gram + 1
    parts = []
    for at in range(0, max(0, n_windows), BLOCK):
        own = np.frombuffer(raw, np.uint8, min(BLOCK, n_windows - at) + length - 1, at)
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[own] * _POW[: len(own)], out=sums[1:])
        n = len(own) - gram + 1
        h = _mix((sums[gram:] - sums[:-gram]) * _INV[:n])
        key = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))  # of equal ones the last
        least, k = key, 1
        while 2 * k <= width:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        m = n - width + 1
        least = np.minimum(least[:m], least[width - k : width - k + m])
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        hi = np.append(lo[1:], m) - 1
        pos = (_LOW - (least[lo] & _LOW)).astype(np.int64)
        shape = ((pos - lo) << 8 | (hi - lo)).astype(np.uint64)
        context = _mix((sums[hi + length] - sums[lo]) * _INV[lo] ^ _mix(shape + np.uint64(1)))
        parts.append((h[pos], context, lo + at, hi + at, pos + at))
    if not parts:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All suffixes of an integer array in order, by the difference cover {1, 2} modulo 3.

    A suffix that is a prefix of another comes first.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    t = np.unique(t, return_inverse=True)[1].ravel().astype(np.int64) + 1
    pad = np.concatenate([t, np.zeros(3, dtype=np.int64)])
    # residue 1 gets one more place where n leaves 1, so that its last triple ends the text
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    base = int(t.max()) + 1
    triple = (pad[sample] * base + pad[sample + 1]) * base + pad[sample + 2] if base < 1 << 20 else None
    if triple is None:
        _, name = np.unique(np.stack([pad[sample], pad[sample + 1], pad[sample + 2]], axis=1), axis=0, return_inverse=True)
        name = name.ravel()
    else:
        name = np.unique(triple, return_inverse=True)[1].ravel()
    n_names = int(name.max()) + 1
    order = np.argsort(name, kind="stable") if n_names == len(sample) else suffix_array(name)
    rank = np.zeros(n + 4, dtype=np.int64)  # of sample suffixes, from 1 on
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    zeros = np.arange(0, n, 3)
    big = len(sample) + 2
    key0 = pad[zeros] * big + rank[zeros + 1]
    by = np.argsort(key0, kind="stable")
    zeros, key0 = zeros[by], key0[by]
    in_order = sample[order]
    in_order = in_order[in_order < n]
    is_one = in_order % 3 == 1
    before = np.empty(len(in_order), dtype=np.int64)  # zeros that come before each sample suffix
    at = in_order[is_one]
    before[is_one] = np.searchsorted(key0, pad[at] * big + rank[at + 1])
    at = in_order[~is_one]
    # two symbols as one: equal pairs get equal numbers
    pairs = np.unique(np.concatenate([pad[zeros] * base + pad[zeros + 1], pad[at] * base + pad[at + 1]]), return_inverse=True)[1].ravel()
    before[~is_one] = np.searchsorted(pairs[: len(zeros)] * big + rank[zeros + 2], pairs[len(zeros) :] * big + rank[at + 2])
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(in_order)) + before
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = in_order
    out[free] = zeros
    return out


def equal_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class for each start: equal where the ``length`` bytes from there are equal.

    ``data`` holds bytes plus 1, with 0 after each piece; windows lie inside pieces.
    """
    order = suffix_array(data)
    at = np.full(len(data), -1, dtype=np.int64)
    at[starts] = np.arange(len(starts))
    order = order[at[order] >= 0]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    raw = np.ascontiguousarray((data - 1).astype(np.uint8))
    eight = np.lib.stride_tricks.as_strided(raw, (max(0, len(raw) - 7), 8), (1, 1))
    for k in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = (eight[a[live] + k] == eight[b[live] + k]).all(axis=1)
    out = np.empty(len(starts), dtype=np.int64)
    out[at[order]] = np.concatenate([[0], np.cumsum(~same)]) if len(order) else []
    return out


_NULL = -(1 << 63)
#: Repeats settled on the way carry x, four integers: windows after the first, and the document and start that they repeat.
_ROW = "h long, c long, d long, m long, s long, x binary"


def mark(raw: bytes) -> int:
    """A hash that tells apart texts of one id; every repeat found by it is compared with its source."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


class _Settled:
    """Settles sorted rows (h, c, d, m, s) by equal anchors and contexts, over any number of batches.

    A row repeats if its context comes before in a document of a smaller id or in its own document;
    documents of one id with unlike texts repeat nothing of each other.
    """

    def __init__(self):
        self.last = self.first = self.own = None  # the last row, the first of its context, and of its document there

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows without copies of rows, whether each is the first of its h, whether it repeats, sources (d, m, s))."""
        last = self.last
        rows = rows[:, edges(*rows, before=last)]
        h, c, d, m, s = rows
        n = len(h)
        if not n:
            return rows, *(np.zeros(0, dtype=bool),) * 2, rows[:3]
        new_h = edges(h, before=None if last is None else last[:1])
        new = new_h | edges(c, before=None if last is None else last[1:2])
        other = new | edges(d, m, before=None if last is None else last[2:4])
        held = np.stack([np.zeros(3, dtype=np.int64) if self.first is None else self.first, np.zeros(3, dtype=np.int64) if self.own is None else self.own])

        def back(starts: np.ndarray, k: int) -> np.ndarray:
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            return np.where(at >= 0, rows[2:, np.maximum(at, 0)], held[k][:, None])

        first, own = back(new, 0), back(other, 1)
        repeats = ~new & ((d != first[0]) | ~other)
        self.last, self.first, self.own = rows[:, -1], first[:, -1], own[:, -1]
        return rows, new_h, repeats, np.where(d != first[0], first, own)


def _joined(d, m, lo, n, sd, sm, so) -> list[np.ndarray]:
    """Repeats with those that follow each other, in the text and in the source, made one."""
    order = np.lexsort([lo, so - lo, sm, sd, m, d])
    d, m, lo, n, sd, sm, so = (x[order] for x in (d, m, lo, n, sd, sm, so))
    cut = edges(d, m, sd, sm, so - lo)
    cut[1:] |= lo[1:] > lo[:-1] + n[:-1] + 1
    at = np.flatnonzero(cut)
    if not len(at):
        return [d, m, lo, n, sd, sm, so]
    end = np.maximum.reduceat(lo + n, at)
    return [d[at], m[at], lo[at], end - lo[at], sd[at], sm[at], so[at]]


def _packed_repeats(n, sd, sm, so) -> pa.Array:
    raw = np.stack([n, sd, sm, so], axis=1).astype("<i8").tobytes()
    return pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary())


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Repeated byte runs: d (document key), m (hash of its text), lo (start), n (bytes past ``length``)."""
    common.importable(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)

    def sample(batches):
        common.claim("suffix_dedup")
        for whole in batches:
            for batch in common.slices(whole, "t"):
                cols: list[list] = [[], [], [], [], []]
                for d, text in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()):
                    if text and len(text) * 4 >= length:
                        raw = text.encode()
                        h, c, lo, hi, pos = anchors(raw, length, gram)
                        if len(h):
                            own = np.full((2, len(h)), [[d], [mark(raw)]], dtype=np.int64)
                            for col, x in zip(cols, (h.view(np.int64), c.view(np.int64), *own, (lo << 16) + ((hi - lo) << 8) + (pos - lo))):
                                col.append(x)
                if not cols[0]:
                    continue
                got = np.stack([np.concatenate(x) for x in cols])
                # what repeats inside the batch is settled here, so that common strings are few rows of the shuffle
                code = got[0] + got[1] * 3
                order = np.argsort(code)
                new = edges(code[order])
                many = np.ones(len(code), dtype=bool)
                many[order] = ~(new & np.append(new[1:], True))
                alone, got = got[:, ~many], got[:, many]
                got, _, again, source = _Settled()(got[:, np.lexsort(got[::-1])])
                d, m, s = got[2:, again]
                d, m, lo, n, sd, sm, so = _joined(d, m, s >> 16, s >> 8 & 255, source[0][again], source[1][again], source[2][again] >> 16)
                key = ((d ^ lo).view(np.uint64) * np.uint64(_BASE)).view(np.int64)  # any, to spread them
                left = np.concatenate([alone, got[:, ~again]], axis=1)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(left, (key, np.zeros_like(d), d, m, lo))), pa.concat_arrays([pa.nulls(left.shape[1], pa.binary()), _packed_repeats(n, sd, sm, so)])], names=["h", "c", "d", "m", "s", "x"])
        common.release()

    runs = rows.mapInArrow(sample, _ROW).repartition("h").sortWithinPartitions("h", "c", "d", "m", "s").mapInArrow(_sift, "kind int, h long, d long, m long, s long, x binary")
    runs = common.persisted(runs, "repeats")
    whole = common.persisted(runs.where("kind = 0").groupBy("d", "m").agg(F.collect_list(F.struct("s", "x")).alias("w")).mapInArrow(_merged, "d long, m long, lo long, n long, sd long, sm long, so long"), "merged")
    # each repeat and its source are looked up in their documents, and so are the contexts that differ
    sources = whole.select("sd", "sm", "so", "n").distinct().select(F.col("sd").alias("d"), F.col("sm").alias("m"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), F.col("so").alias("s"), "n", "sd", "sm", "so")
    targets = whole.select("d", "m", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), F.col("lo").alias("s"), "n", "sd", "sm", "so")
    differing = runs.where("kind = 1").select("d", "m", "kind", "h", "s", *[F.lit(0).cast("long").alias(k) for k in ("n", "sd", "sm", "so")])
    wanted = targets.union(sources).union(differing).groupBy("d", "m").agg(F.collect_list(F.struct("kind", "h", "s", "n", "sd", "sm", "so")).alias("w"))
    # side: 0 left, 1 right; k: hash of the anchor, the side and the bytes that all its windows share
    pieces = _packed(rows, "t").join(wanted, ["d", "m"]).mapInArrow(_contexts(length, gram), "k long, kind int, d long, m long, s long, n long, b binary")
    alike = common.persisted(pieces.repartition("k").sortWithinPartitions("k", "kind", "d", "m", "s", "n").mapInArrow(_sorted(length, group_bytes), "d long, m long, lo long, n long, k long, b binary"), "alike")
    found = whole.select("d", "m", "lo", "n").union(alike.where("b is null").select("d", "m", "lo", "n"))
    large = alike.where("b is not null")
    return found if large.isEmpty() else found.union(_of_large_groups(large, length))


def _of_large_groups(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows among contexts (d, m, lo, b): their classes by distributed sorting, then the rule of repeats."""
    rows = common.persisted(rows.select("d", "m", "lo", "b", F.monotonically_increasing_id().alias("p")), "large")
    classes = difference_cover.classes(rows.select("p", F.col("b").alias("x")), length)
    windows = rows.drop("b").join(classes, "p").select("class", "d", "m", (F.col("lo") + F.col("o")).alias("s"))

    def run(batches):
        settled = _Settled()
        for batch in batches:
            k, d, m, s = (np.asarray(batch.column(c)) for c in ("class", "d", "m", "s"))
            got, _, again, _ = settled(np.stack([k, np.zeros_like(k), d, m, s]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[again]) for x in got[2:]), pa.array(np.zeros(int(again.sum()), dtype=np.int64))], names=["d", "m", "lo", "n"])

    return windows.repartition("class").sortWithinPartitions("class", "d", "m", "s").mapInArrow(run, "d long, m long, lo long, n long")


def _packed(df: DataFrame, text_col: str) -> DataFrame:
    """The text column compressed, as it goes through shuffles, and a column m, the hash of the text; null stays null."""
    schema = StructType([*(StructField(f.name, BinaryType()) if f.name == text_col else f for f in df.schema.fields), StructField("m", LongType())])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for whole in batches:
            for batch in common.slices(whole, text_col):
                made, marks = [], []
                for text in batch.column(text_col).to_pylist():
                    raw = None if text is None else text.encode()
                    made.append(None if raw is None else struct.pack("<I", len(raw)) + codec.compress(raw, asbytes=True))
                    marks.append(mark(raw or b""))
                cols = [pa.array(made, pa.binary()) if n == text_col else batch.column(n) for n in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(marks, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def _unpack(data: bytes | None) -> bytes | None:
    return None if data is None else pa.decompress(data[4:], struct.unpack("<I", data[:4])[0], codec="zstd", asbytes=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("d"), F.col(text_col).alias("t"))


def _sift(batches):
    """Sorted rows to kind 0 (all windows repeat) and 1 (a context that does not, of an anchor that has others)."""
    settled, held = _Settled(), None  # held: the first row of the last h, while it is the only one that repeats nothing
    for batch in batches:
        done = np.array(batch.column("x").is_valid())
        if done.any():
            own = batch.filter(pa.array(done))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(own.num_rows, dtype=np.int32)), *(own.column(k) for k in ("h", "d", "m", "s", "x"))], names=["kind", "h", "d", "m", "s", "x"])
        rows = np.stack([np.asarray(batch.column(k)) for k in ("h", "c", "d", "m", "s")])[:, ~done]
        rows, new_h, again, source = settled(rows)
        if not rows.shape[1]:
            continue
        h, _, d, m, s = rows
        at = np.flatnonzero(~again)
        many = np.zeros(len(at), dtype=bool)
        many[:-1] = ~new_h[at[1:]]
        many |= ~new_h[at]
        cols = [[np.zeros(int(again.sum()), dtype=np.int32), np.ones(int(many.sum()), dtype=np.int32)], *([x[again], x[at[many]]] for x in (h, d, m))]
        cols.append([s[again] >> 16, s[at[many]]])
        if len(at) and not new_h[at[0]] and held is not None:
            for col, x in zip(cols, (np.array([1], dtype=np.int32), *(np.array([v]) for v in held))):
                col.append(x)
        if len(at):
            held = (h[at[-1]], d[at[-1]], m[at[-1]], s[at[-1]]) if new_h[at[-1]] else None
        x = _packed_repeats(s[again] >> 8 & 255, source[0][again], source[1][again], source[2][again] >> 16)
        cols = [pa.array(np.concatenate(c)) for c in cols]
        yield pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([x, pa.nulls(len(cols[0]) - len(x), pa.binary())])], names=["kind", "h", "d", "m", "s", "x"])


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """(ends of each row's items, all items) of a column of lists."""
    lists = batch.column(name)
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()


def _merged(batches):
    """The repeats of each document, joined."""
    for batch in batches:
        if batch.num_rows:
            ends, items = _lists(batch, "w")
            d, m = (np.repeat(np.asarray(batch.column(k)), np.diff(ends)) for k in ("d", "m"))
            n, sd, sm, so = np.frombuffer(b"".join(items.field("x").to_pylist()), "<i8").reshape(-1, 4).T.astype(np.int64)
            cols = _joined(d, m, np.asarray(items.field("s")), n, sd, sm, so)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["d", "m", "lo", "n", "sd", "sm", "so"])


def _contexts(length: int, gram: int):
    """Documents with what is wanted of them to rows of kind 0 (digests of repeats and sources) and 1 (contexts)."""
    side = (length - gram) // 2  # bytes beside the anchor that windows of a side share

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "t"):
                rows, digests = [], set()
                ends, items = _lists(batch, "w")
                ends, own = ends.tolist(), list(zip(*(items.field(k).to_pylist() for k in ("kind", "s", "n", "sd", "sm", "so"))))
                for row, (d, m, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("d", "m", "t")))):
                    raw = _unpack(data) or b""
                    for kind, s, n, *source in own[ends[row] : ends[row + 1]]:
                        if kind == 0:
                            name = struct.pack("<4q", n, *source)
                            digests.add((xxhash.xxh3_64_intdigest(name) >> 1, 0, *source, n, hashlib.sha256(raw[s : s + n + length]).digest()))
                            continue
                        lo, n, off = s >> 16, s >> 8 & 255, s & 255
                        pos, hi = lo + off, lo + n
                        a, b = lo, min(hi, pos - side)
                        if a <= b:
                            rows.append((xxhash.xxh3_64_intdigest(raw[pos - side : pos + gram]) >> 1, 1, d, m, a, b - a, raw[a : b + length]))
                        a, b = max(lo, pos - side + 1), hi
                        if a <= b:
                            rows.append((xxhash.xxh3_64_intdigest(raw[pos : pos + length - side + 1], 1) >> 1, 1, d, m, a, b - a, raw[a : b + length]))
                rows += digests
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()))], names=["k", "kind", "d", "m", "s", "n", "b"])

    return run


def repeated(classes: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows, in order of id, text and start, have an equal one (by class) before in a smaller id or in their document."""
    order = np.argsort(classes, kind="stable")
    k, doc, d = classes[order], docs[order], ids[order]
    new = edges(k)
    first = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    out = np.zeros(len(k), dtype=bool)
    out[order] = ~new & ((d != first) | ~edges(doc))
    return out


def _sorted(length: int, group_bytes: int):
    """Groups of contexts to repeated runs (b null); rows of groups beyond ``group_bytes`` go on as they are."""
    names = ["d", "m", "lo", "n", "k", "b"]
    key = ("k", "d", "m", "s", "n")

    def settled(batch: pa.RecordBatch):
        """Contexts of whole groups, in order, to repeated runs."""
        k, d, m, s, n = (np.asarray(batch.column(c)) for c in key)
        b = batch.column("b")
        sizes = np.asarray(pc.binary_length(b)).astype(np.int64) + 1
        base = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(b.to_pylist()), np.uint8)
        data = np.zeros(int(sizes.sum()), dtype=np.int32)
        data[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = raw.astype(np.int32) + 1
        count = sizes - length
        row = np.repeat(np.arange(len(sizes)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        same = equal_windows(data, base[row] + offset, length)
        # rows are in order of id, text and start, windows of a row too
        again = np.flatnonzero(repeated(same, np.cumsum(edges(k, d, m))[row], d[row]))
        if not len(again):
            return None
        cut = edges(row[again])
        cut[1:] |= np.diff(offset[again]) != 1
        at = np.flatnonzero(cut)
        lo, hi = again[at], again[np.append(at[1:] - 1, len(again) - 1)]
        zero = np.zeros(len(lo), dtype=np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, (d[row[lo]], m[row[lo]], s[row[lo]] + offset[lo], offset[hi] - offset[lo], zero)), pa.nulls(len(lo), pa.binary())], names=names)

    def compare(batch: pa.RecordBatch, told):
        """A repeat and its source have one digest; ``told`` is the last one before."""
        rows = [*([told] if told else []), *zip(*(batch.column(c).to_pylist() for c in ("d", "m", "s", "n", "b")))]
        if any(x[:4] == y[:4] and x[4] != y[4] for x, y in zip(rows, rows[1:])):
            raise RuntimeError("unlike byte strings have equal hashes: no byte is removed")
        return rows[-1]

    def whole(batch: pa.RecordBatch):
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "m", "s", "n", "k", "b")], names=names)

    def run(batches):
        held, size, told, passing = [], 0, None, None  # batches of whole groups but for the last, which may go on
        for batch in batches:
            digests = np.asarray(batch.column("kind")) == 0
            if digests.any():
                told = compare(batch.filter(pa.array(digests)), told)
                batch = batch.filter(pa.array(~digests))
            if not batch.num_rows:
                continue
            k = np.asarray(batch.column("k"))
            if passing is not None:  # a group too large for one task goes on
                n = int(np.searchsorted(k, passing, side="right"))
                if n:
                    yield whole(batch.slice(0, n))
                batch, k = batch.slice(n), k[n:]
                if not len(k):
                    continue
                passing = None
            held.append(batch)
            size += _bytes(batch)
            if size < SORT_BYTES:
                continue
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            k = np.asarray(joined.column("k"))
            cut = int(np.searchsorted(k, k[-1]))
            yield from groups(joined.slice(0, cut))
            rest = joined.slice(cut)
            held, size = [rest], _bytes(rest)
            if size > group_bytes:
                yield whole(rest)
                held, size, passing = [], 0, int(k[-1])
        if held:
            yield from groups(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        held = []
        common.release()

    def groups(batch: pa.RecordBatch):
        """Rows of whole groups: those of one row repeat nothing, large ones go on, the others are sorted."""
        if not batch.num_rows:
            return
        cols = [np.asarray(batch.column(c)) for c in key]
        batch = batch.filter(pa.array(edges(*cols)))  # rows of one document that comes twice count once
        k = np.asarray(batch.column("k"))
        at = np.flatnonzero(edges(k))
        count = np.diff(np.append(at, len(k)))
        sizes = np.add.reduceat(np.asarray(pc.binary_length(batch.column("b"))).astype(np.int64), at)
        large = np.repeat(sizes > group_bytes, count)
        if large.any():
            yield whole(batch.filter(pa.array(large)))
        batch = batch.filter(pa.array(~large & np.repeat(count > 1, count)))
        if batch.num_rows and (out := settled(batch)) is not None:
            yield out

    return run


def _bytes(batch: pa.RecordBatch) -> int:
    return pc.sum(pc.binary_length(batch.column("b"))).as_py() or 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans, kept (its remaining bytes)."""
    return _apply(docs, id_col, text_col, length, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", lambda batch, texts, cols: cols)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """As :func:`remove_repeats`, with the SHA-256 of what is kept in its place."""
    hashed = lambda batch, texts, cols: [*cols[:4], [hashlib.sha256(x).hexdigest() for x in cols[4]]]
    return _apply(docs, id_col, text_col, length, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hashed, group_bytes)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with repeats cut from their texts; columns are kept.

    A character that a cut splits goes whole; n_chars, where there is one, is counted anew.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    chars = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None

    def put(batch, olds, cols):
        texts = [None if old is None else (kept if n else old).decode("utf-8", "ignore") for old, kept, n in zip(olds, cols[4], cols[2])]
        out = []
        for n in names:
            if n == text:
                out.append(pa.array(texts, pa.string()))
            elif n == chars:
                out.append(pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column(n).type))
            else:
                out.append(batch.column(n))
        return out

    return _apply(inner, key, text, length, inner.schema, put).toDF(*docs.columns)


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, schema, shape, group_bytes: int = GROUP_BYTES) -> DataFrame:
    spans = find_repeats(docs, id_col, text_col, length, group_bytes=group_bytes).groupBy("d", "m").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    own = docs
    if isinstance(schema, str):
        own, id_col, text_col = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")), "c0", "c1"
    joined = _packed(own, text_col).withColumn("d", F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL))).join(spans, ["d", "m"], "left").drop("d", "m")
    names = [f.name for f in schema.fields] if not isinstance(schema, str) else [x.split()[0] for x in schema.split(", ")]
    kinds = None if not isinstance(schema, str) else [common._TYPES[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, text_col):
                cols: list[list] = [[], [], [], [], []]
                texts = [_unpack(x) for x in batch.column(text_col).to_pylist()]
                for key, raw, spans in zip(batch.column(id_col).to_pylist(), texts, batch.column("spans").to_pylist()):
                    raw = raw or b""
                    kept, removed, n = cut(raw, [(r["lo"], r["n"]) for r in spans or ()], length)
                    for col, x in zip(cols, (key, len(raw), removed, n, kept)):
                        col.append(x)
                made = shape(batch, texts, cols)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(made, kinds or [None] * len(made))], names=names)

    return joined.mapInArrow(run, schema)


def cut(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(what is kept, bytes removed, maximal runs removed)."""
    out, at, removed, n, end = [], 0, 0, 0, -1
    for lo, hi in sorted((lo, lo + more + length) for lo, more in spans):
        if lo > end:
            n += 1
            out.append(raw[at:lo])
            removed += hi - lo
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    out.append(raw[at:])
    return b"".join(out), removed, n
