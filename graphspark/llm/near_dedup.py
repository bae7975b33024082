"""Near-duplicate classes by Order MinHash and banded alignment.

A document's words (as in decontamination) give k-mers of K words, each labelled
by its occurrence number.  For each of SKETCHES hash functions the two labelled
k-mers of least hash are taken; their k-mers in text order make one sketch, so
two texts share it only if they share both k-mers in the same order.  Shared
sketches give candidates, which are aligned word by word inside a band as wide
as the greatest distance allowed; pairs of at least ``similarity`` (1 less the
edits for each word of the longer text) are linked, and classes are the
connected components.

Texts of equal words collapse first, so a group of copies is one row.  Then all
pairs of a bucket are settled: a pair is in one class already, fails an exact
test (lengths; counts of words and of word pairs in bins, then the common words
themselves, all of which bound the edits from below) or is aligned.  A pair that
meets in several buckets is tested in the first of them.  To have most of them in one class early, each member
is first aligned with its most alike leader of all buckets (a leader is a member
that resembles no leader before it, from either end of the bucket), then with
those of single buckets and the member of another class that has most words in
common with it; only aligned links make classes.  A bucket of many texts that have
most words in common but are just too different to link takes pairs by the
square of its rows.

Pairs that align are missed only where they share none of the sketches.  In a
simulation (texts of 100, 400 and 1500 words, a share of the words substituted at
random places) 0.99 to 1.00 of the pairs share one at 8 % of the words, 0.97 to
0.99 at 10 %, 0.91 to 0.95 at 12 %, 0.83 to 0.86 at 15 %, and 0.57 to 0.71 at
19.5 %, just inside the limit.  Edits that stand together cost fewer sketches.

Defined cases: documents without words (null, empty) are classes of their own;
texts of fewer than K words have one k-mer.  The work is keyed by texts, so rows
of equal or null id whose texts differ are kept apart: such an id comes once for
each class its texts are in.  Rows equal in id and text count as one document.
A null id counts as the smallest id and comes back as null; classes whose least
ids are equal (or null) have equal names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm import common
from graphspark.llm.components import connected
from graphspark.llm.decontaminate import words

K, SKETCHES, SIMILARITY = 5, 24, 0.8
#: Minima in a sketch.
SAMPLED = 2
#: Share of the SAMPLED * SKETCHES equal minima from which a member is first aligned with a leader; it only sets
#: the order of the work, as all other pairs of a bucket follow.
RESEMBLE = 0.33
#: Bins of the counts that rule out alignments.
WORD_BINS, PAIR_BINS = 64, 128
#: Rows that one row of a bucket is compared with at a time, and pairs in a batch.
BLOCK = 1 << 15
_NULL = -(1 << 63)
_SEEDS = np.random.default_rng(11).integers(0, 2**63, SKETCHES, dtype=np.uint64)[:, None]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """64-bit hashes of words, kept for the most recent ones."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= 400_000:
            self.clear()
        self[word] = value
        return value


_hashes = _Hashes()


def word_hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, own), dtype=np.uint64, count=len(own))


def sketch(h: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, a byte of each first and then each second minimum) of a text of these word hashes."""
    n = max(1, len(h) - k + 1)
    mers = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(h))):
        mers = _mix(mers * np.uint64(31) + h[j : j + n] + np.uint64(j))
    order = np.argsort(mers, kind="stable")
    s = mers[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    times = np.empty(n, dtype=np.uint64)
    times[order] = (np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))).astype(np.uint64)
    labelled = mers + times * np.uint64(0x9E3779B97F4A7C15)
    places = np.zeros((SKETCHES, SAMPLED), dtype=np.int64)
    low = np.empty((SAMPLED, SKETCHES), dtype=np.uint64)
    taken = np.uint64(2**64 - 1)
    for j in range(SKETCHES):
        x = (labelled ^ _SEEDS[j]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        for k in range(SAMPLED):
            i = places[j, k] = x.argmin()
            low[k, j] = x[i]
            if n > k + 1:
                x[i] = taken
    out = np.arange(SKETCHES, dtype=np.uint64)
    for place in np.sort(places, axis=1).T:  # in the order of the text
        out = _mix(out + mers[place])
    return out, _mix(low).astype(np.uint8).ravel()


def bins(h: np.ndarray) -> bytes:
    """Counts (255 at most) of the words and of the pairs of adjacent words of a text, in WORD_BINS and PAIR_BINS bins."""
    w = h & np.uint64(0xFFFFFFFF)
    two = _mix(w[:-1] * np.uint64(31) + w[1:]) % np.uint64(PAIR_BINS)
    one = np.bincount((w % np.uint64(WORD_BINS)).astype(np.int64), minlength=WORD_BINS)
    return np.minimum(np.concatenate([one, np.bincount(two.astype(np.int64), minlength=PAIR_BINS)]), 255).astype(np.uint8).tobytes()


def may_align(counts: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Whether texts of these bins and sizes may align with one; never false for a pair that does.

    An edit takes away at most one word and two pairs, and brings as many.
    """
    longer = np.maximum(sizes, size)
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    ok = longer - np.minimum(sizes, size) <= most
    at = np.flatnonzero(ok)
    d = counts[at].astype(np.int16) - one.astype(np.int16)
    for part, times in ((d[:, :WORD_BINS], 1), (d[:, WORD_BINS:], 2)):
        more, fewer = np.maximum(part, 0).sum(axis=1), np.maximum(-part, 0).sum(axis=1)
        ok[at] &= np.maximum(more, fewer) <= times * most[at]
    return ok


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edits between two arrays if at most ``most``, by bit-parallel dynamic programming."""
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return None
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return abs(len(a) - len(b))
    lo = int(differ[0])
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    cut = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b) if len(b) <= most else None
    # a word beyond those that both have costs an edit
    x, y = np.sort(a), np.sort(b)
    left = np.arange(len(y)) - np.searchsorted(y, y)  # which of its equals a word is
    common = int((left < np.searchsorted(x, y, side="right") - np.searchsorted(x, y)).sum())
    if len(b) - common > most:
        return None
    # Myers' and Hyyro's bits: a column's steps up and down are one integer each
    at: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << k
    full, top, got, left_over = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a), len(b)
    up, down, get = full, 0, at.get
    for w in b.tolist():
        same = get(w, 0)
        x = same | down
        y = (((same & up) + up) ^ up) | same
        more = down | (full & ~(y | up))
        less = up & y
        left_over -= 1
        if more & top:
            got += 1
            if got - left_over > most:
                return None
        elif less & top:
            got -= 1
        more = more << 1 | 1
        up = full & ((less << 1) | ~(x | more))
        down = full & more & x
    return got if got <= most else None


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    size = max(len(a), len(b))
    return distance(a, b, int((1 - similarity) * size + 1e-9)) is not None


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_rows): one row for each id and class; a class is named by its least id."""
    back = lambda c: F.when(F.col(c) == _NULL, None).otherwise(F.col(c))
    found = _classed(docs, id_col, text_col, similarity).groupBy("i", "ci", "cx").agg(F.sum("n").alias("n_rows"))
    return found.select(back("i").alias("doc_id"), back("ci").alias("class_id"), "n_rows")


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """The id (null as the smallest) and the hash of the text, which together name a document."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)), F.xxhash64(F.col(text_col))


def _classed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(i, x, n, ci, cx): the documents by id and text, their rows, and the least document of their class."""
    common.importable(docs.sparkSession)
    own_id, own_text = _named(docs, id_col, text_col)
    rows = docs.select(own_id.alias("i"), own_text.alias("x"), F.col(text_col).alias("t"))

    def sketches(batches):
        common.claim("near_dedup", _hashes.clear)
        for whole in batches:
            for batch in common.slices(whole, "t"):
                keys, made = [], []
                for text in batch.column("t").to_pylist():
                    own = words(text)
                    if own:
                        h = word_hashes(own)
                        s, low = sketch(h)
                        keys.append(hashlib.blake2b(b" ".join(own), digest_size=12).digest())
                        made.append(s.astype("<u8").tobytes() + low.tobytes() + struct.pack("<I", len(own)))
                    else:
                        keys.append(None)
                        made.append(None)
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("x"), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["i", "x", "k", "s"])

    made = common.persisted(rows.mapInArrow(sketches, "i long, x long, k binary, s binary"), "sketches")
    # each text has a number, i, and is read from its least document (di, dx)
    texts = common.persisted(made.where("k is not null").groupBy("k").agg(F.min(F.struct("i", "x", "s")).alias("f")).select("k", F.monotonically_increasing_id().alias("i"), F.col("f.i").alias("di"), F.col("f.x").alias("dx"), "f.s"), "texts")

    met = common.persisted(_buckets(texts).repartition("h").sortWithinPartitions("h", "i").mapInArrow(_pairs(similarity), "a long, b long, e int"), "met")
    members = met.where("e = -1").select(F.col("a").alias("h"), F.col("b").alias("i"))
    pairs = common.persisted(met.where("e >= 0").groupBy("a", "b").agg(F.max("e").alias("e")), "pairs")
    # joined by shuffles at every size, as the candidates grow with the texts
    ends = texts.join(members.select("i").distinct().hint("merge"), "i").select(F.col("i").alias("number"), F.col("di").alias("i"), F.col("dx").alias("x"), F.expr(f"substring(s, 1, {8 * SKETCHES})").alias("s"))
    arrays = common.persisted(rows.join(ends.hint("merge"), ["i", "x"]).select(F.col("number").alias("i"), "t", "s").mapInArrow(_arrays, "i long, w binary, s binary"), "words").dropDuplicates(["i"])
    best = pairs.groupBy("b").agg(F.max(F.struct("e", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    linked = common.persisted(_verified(best, arrays, similarity), "links")
    parts = common.persisted(connected(linked), "parts")
    at = lambda col: parts.select(F.col("node").alias(col), F.col("component").alias(f"{col}_part"))
    open_ = pairs.join(best, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(a_part, a) <> coalesce(b_part, b)").select("a", "b")
    counts = arrays.select("i", "w", "s").mapInArrow(_bags, "i long, m binary")

    def unsettled(parts: DataFrame, tested: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of a bucket that may align and whose ends are still in different classes."""
        placed = members.join(parts.select(F.col("node").alias("i"), "component"), "i", "left").select("h", "i", F.coalesce("component", "i").alias("p"))
        mixed = placed.groupBy("h").agg(F.min("p").alias("x"), F.max("p").alias("y")).where("x <> y").select("h")
        wide = placed.join(mixed.hint("merge"), "h", "left_semi").join(counts.hint("merge"), "i").repartition("h").sortWithinPartitions("h", "i")
        return wide.mapInArrow(_rest(similarity, nearest), "a long, b long").join(tested, ["a", "b"], "left_anti")

    # each member's most alike one of another class first: that leaves few classes, so few pairs for the last step
    open_ = common.persisted(open_.union(unsettled(parts, pairs.select("a", "b"), True)), "open")
    linked = common.persisted(linked.union(_verified(open_, arrays, similarity)), "links")
    parts = common.persisted(connected(linked), "parts")
    rest = unsettled(parts, pairs.select("a", "b").union(open_), False)
    more = linked.union(_verified(common.persisted(rest, "rest"), arrays, similarity))
    parts = connected(more.distinct()).withColumnRenamed("node", "i")
    placed = texts.join(parts, "i", "left").select("k", "di", "dx", F.coalesce("component", "i").alias("c"))
    first = placed.groupBy("c").agg(F.min(F.struct(F.col("di").alias("ci"), F.col("dx").alias("cx"))).alias("f")).select("c", "f.ci", "f.cx")
    counted = made.groupBy("i", "x", "k").agg(F.count("*").alias("n"))
    found = counted.join(placed.join(first, "c").select("k", "ci", "cx"), "k", "left")
    return found.select("i", "x", "n", F.coalesce("ci", "i").alias("ci"), F.coalesce("cx", "x").alias("cx"))


def _buckets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, raw = batch.column("i").to_numpy(), batch.column("s").to_pylist()
            h = np.frombuffer(b"".join([x[: 8 * SKETCHES] for x in raw]), dtype="<i8")
            low = [x[8 * SKETCHES : 8 * SKETCHES + SAMPLED * SKETCHES + 4] for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(ids, SKETCHES)), pa.array([x for x in low for _ in range(SKETCHES)], pa.binary())], names=["h", "i", "m"])

    return texts.select("i", "s").mapInArrow(run, "h long, i long, m binary")


def leader_pairs(minima: np.ndarray, sizes: np.ndarray, similarity: float = SIMILARITY, least: float = RESEMBLE) -> list[tuple[int, int, int]]:
    """(row, row, equal minima): each row that resembles a leader with the most alike one, leaders from the top and the bottom.

    Texts whose lengths alone keep them apart are no pair.
    """
    n, need = len(minima), least * minima.shape[1]
    most, other = np.zeros(n, dtype=np.int64), np.full(n, -1)
    for rows in (range(n), range(n - 1, -1, -1)):
        covered = np.zeros(n, dtype=bool)
        for i in rows:
            if not covered[i]:
                same = (minima == minima[i]).sum(axis=1)
                near = (same >= need) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
                covered |= near
                near[i] = False
                j = np.flatnonzero(near)
                if len(j):
                    j = np.append(j[same[j] > most[j]], i) if same[j].max() > most[i] else j[same[j] > most[j]]
                    best = int(np.argmax(np.where(near, same, -1)))
                    most[j], other[j] = np.where(j == i, same[best], same[j]), np.where(j == i, best, i)
    return list({(min(i, int(k)), max(i, int(k)), int(e)) for i, (k, e) in enumerate(zip(other, most)) if k >= 0})


def _pairs(similarity: float):
    return lambda batches: _of_buckets(batches, ["m"], lambda *rows: _candidates(*rows, similarity))


def _rest(similarity: float, nearest: bool = False):
    return lambda batches: _of_buckets(batches, ["p", "m"], lambda *rows: _unsettled(*rows, similarity, nearest))


def _of_buckets(batches, names: list[str], work):
    """``work`` on (h, ids, columns) of whole buckets of rows sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, ids, cols = batch.column("h").to_numpy(), batch.column("i").to_numpy(), [batch.column(c).to_pylist() for c in names]
        if held:
            h, ids, cols = np.concatenate([held[0], h]), np.concatenate([held[1], ids]), [x + y for x, y in zip(held[2], cols)]
        cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
        held = h[cut:], ids[cut:], [x[cut:] for x in cols]
        if cut:
            yield from work(h[:cut], ids[:cut], *(x[:cut] for x in cols))
    if held:
        yield from work(held[0], held[1], *held[2])
    held = None
    common.release()


def _groups(h: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    many = np.flatnonzero(np.diff(edge) > 1)
    return list(zip(edge[many].tolist(), edge[many + 1].tolist()))


def _candidates(h, ids, low, similarity: float):
    """(leader, member, equal minima), and (bucket, member, -1) of all members; buckets of one row give none."""
    rows = []
    for lo, hi in _groups(h):
        raw = np.frombuffer(b"".join(low[lo:hi]), dtype=np.uint8).reshape(hi - lo, -1)
        sizes = np.ascontiguousarray(raw[:, -4:]).view("<u4").ravel().astype(np.int64)
        rows += [(int(ids[lo + a]), int(ids[lo + b]), e) for a, b, e in leader_pairs(raw[:, :-4], sizes, similarity)]
        rows += [(int(h[lo]), i, -1) for i in ids[lo:hi].tolist()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "e"])


class _Bags:
    """The bags of a bucket's rows."""

    def __init__(self, raw: list[bytes]):
        head = 4 + 8 * SKETCHES + WORD_BINS + PAIR_BINS
        fixed = np.frombuffer(b"".join([x[:head] for x in raw]), dtype=np.uint8).reshape(len(raw), head)
        self.sizes = np.ascontiguousarray(fixed[:, :4]).view("<u4").ravel().astype(np.int64)
        self.sketches = np.ascontiguousarray(fixed[:, 4 : 4 + 8 * SKETCHES]).view("<i8")
        self.bins = fixed[:, 4 + 8 * SKETCHES :]
        self.n = [(len(x) - head) // 3 for x in raw]
        self.words = [np.frombuffer(x, "<u2", n, head) for x, n in zip(raw, self.n)]
        self.times = [np.frombuffer(x, np.uint8, n, head + 2 * n) for x, n in zip(raw, self.n)]
        self.total = np.array([int(x.sum()) for x in self.times])
        self.table = np.zeros(1 << 16, dtype=np.uint8)

    def partners(self, i: int, j: np.ndarray, h: int, similarity: float, nearest: bool = False) -> np.ndarray:
        """Those of ``j`` that meet row i in no bucket before h and may align with it; the one of most common words, if so asked."""
        j = j[may_align(self.bins[j], self.sizes[j], self.bins[i], self.sizes[i], similarity)]
        if not len(j):
            return j
        before = int(np.argmax(self.sketches[i] == h))
        j = j[~(self.sketches[j, :before] == self.sketches[i, :before]).any(axis=1)]
        if not len(j):
            return j
        # an edit takes away at most one word, and brings one
        self.table[self.words[i]] = self.times[i]
        at = j.tolist()
        start = np.cumsum([0, *(self.n[k] for k in at[:-1])])
        shared = np.add.reduceat(np.minimum(self.table[np.concatenate([self.words[k] for k in at])], np.concatenate([self.times[k] for k in at])).astype(np.int64), start)
        self.table[self.words[i]] = 0
        longer, edits = np.maximum(self.sizes[j], self.sizes[i]), np.maximum(self.total[i], self.total[j]) - shared
        may = edits <= ((1 - similarity) * longer + 1e-9).astype(np.int64)
        if nearest and may.any():
            return j[[int(np.argmin(np.where(may, edits / longer, 2.0)))]]
        return j[may]


def _unsettled(h, ids, parts, raw, similarity: float, nearest: bool = False):
    """Pairs of a bucket whose classes differ and that no exact test rules out; with ``nearest`` one a row (and BLOCK)."""
    a, b, held = [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    for lo, hi in _groups(h):
        own, part = ids[lo:hi], np.array(parts[lo:hi], dtype=np.int64)
        if (part == part[0]).all():
            continue
        bags = _Bags(raw[lo:hi])
        for i in range(hi - lo - 1):
            for at in range(i + 1, hi - lo, BLOCK):
                j = at + np.flatnonzero(part[at : at + BLOCK] != part[i])
                if len(j):
                    j = bags.partners(i, j, int(h[lo]), similarity, nearest)
                if len(j):
                    a.append(np.minimum(own[i], own[j]))
                    b.append(np.maximum(own[i], own[j]))
                    held += len(j)
                    if held >= BLOCK:
                        yield batch()
                        a, b, held = [], [], 0
    if held:
        yield batch()


def _arrays(batches):
    common.claim("near_dedup", _hashes.clear)
    for whole in batches:
        for batch in common.slices(whole, "t"):
            w = [(word_hashes(words(t)) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(w, pa.binary()), batch.column("s")], names=["i", "w", "s"])


def _bags(batches):
    """What rules out alignments: size, sketches, bins, and 16 bits and the count (255 at most) of each word."""
    for batch in batches:
        made = []
        for raw, s in zip(batch.column("w").to_pylist(), batch.column("s").to_pylist()):
            h = np.frombuffer(raw, "<u4")
            word, times = np.unique((h & 0xFFFF).astype("<u2"), return_counts=True)
            made.append(struct.pack("<I", len(h)) + s + bins(h.astype(np.uint64)) + word.tobytes() + np.minimum(times, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(made, pa.binary())], names=["i", "m"])


def _verified(pairs: DataFrame, arrays: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts align; word ids are 32 bits of the words' hashes."""

    def run(batches):
        for batch in batches:
            keep = [alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = lambda key, col: arrays.select(F.col("i").alias(key), F.col("w").alias(col))
    return pairs.join(own("b", "y").hint("merge"), "b").join(own("a", "x").hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the least id (of its texts, that of the least hash), with all its columns."""
    found = common.persisted(_classed(docs, id_col, text_col, similarity), "classes")
    first = found.where("i = ci and x = cx").groupBy(F.col("i").alias("first"), F.col("x").alias("own")).agg(F.sum("n").alias("n"))
    inner = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    own_id, own_text = _named(inner, key, text)
    kept = inner.join(first.select("first", "own"), (own_id == F.col("first")) & (own_text == F.col("own")), "left_semi")
    # only rows equal in id and text are left to drop
    kept = kept.dropDuplicates([key, text]) if first.where("n > 1").limit(1).count() else kept
    return kept.toDF(*docs.columns)
