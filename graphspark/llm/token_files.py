"""Token-id files: one concatenated id array with Elias-Fano document bounds.

``write_tokens`` encodes whole texts, orders documents by id over range
partitions and writes shards; ``read_tokens`` reads shards back document by
document.  A shard is

    ids (2 bytes each where the vocabulary allows, else 4) | bounds | keys |
    JSON footer | footer length (4 bytes) | b"GSTK"

``bounds`` (n + 1 values) and ``keys`` (document ids less the first one) are
Elias-Fano lists, so no table of 64-bit offsets is kept.  ``Shard.doc(i)``
finds one document by two selects.

Defined cases: a null text has no ids but the end id; rows with equal ids keep
their own entries, in the order of their texts; null ids come first, counted in the footer; an empty table
gives no shard.  A task that runs again writes files of new names; the
manifest, which Spark commits once, names those that count.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.llm import common, elias_fano
from graphspark.llm.tokens import Encoder

MAGIC = b"GSTK"
#: Ids after which a shard is closed.
SHARD_IDS = 16_000_000
_MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def open_fs(path: str):
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Writer:
    def __init__(self, folder: str, name: str, width: int):
        self.fs, at = open_fs(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.at, self.width = f"{folder}/{name}", f"{at}/{name}", width
        self.out = self.fs.open_output_stream(self.at)
        self.bounds, self.keys, self.nulls, self.n = [0], [], 0, 0

    def add(self, key, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.n += len(ids)
        self.bounds.append(self.n)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> None:
        first = self.keys[0] if self.keys else 0
        bounds = elias_fano.encode(np.array(self.bounds))
        keys = elias_fano.encode(np.array([k - first for k in self.keys], dtype=np.uint64))
        foot = json.dumps({"width": self.width, "n_ids": self.n, "n_docs": len(self.bounds) - 1, "nulls": self.nulls, "first": first, "bounds": len(bounds), "keys": len(keys)}).encode()
        self.out.write(bounds + keys + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()


class Shard:
    """One shard, opened for random access; only what is asked for is read."""

    def __init__(self, path: str):
        where, at = open_fs(path)
        self.file = where.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(8, size - 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self.file.read_at(n, size - 8 - n))
        f = self.foot
        at = f["n_ids"] * f["width"]
        self.bounds = elias_fano.EliasFano(self.file.read_at(f["bounds"], at))
        self.keys = elias_fano.EliasFano(self.file.read_at(f["keys"], at + f["bounds"]))

    def __len__(self) -> int:
        return self.foot["n_docs"]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        w = self.foot["width"]
        return np.frombuffer(self.file.read_at((hi - lo) * w, lo * w), f"<u{w}").astype("<u4")

    def key(self, i: int):
        k = i - self.foot["nulls"]
        return None if k < 0 else self.foot["first"] + self.keys.select(k)

    def doc(self, i: int) -> np.ndarray:
        """Ids of document i."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def docs(self, block: int = 1_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start in the shard, ids) of each document in order."""
        bounds = self.bounds.all()
        keys = [None] * self.foot["nulls"] + (self.foot["first"] + self.keys.all()).tolist()
        i = 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, side="right")) - 1)
            part = self.ids(int(bounds[i]), int(bounds[j]))
            for k in range(i, j):
                yield keys[k], int(bounds[k]), part[bounds[k] - bounds[i] : bounds[k + 1] - bounds[i]]
            i = j


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int | None = 0, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all texts in ascending order of ``id_col``; gives the manifest.

    Manifest rows (part, seq, path, n_docs, n_ids) in order of (part, seq) hold the documents in order.
    """
    spark = docs.sparkSession
    common.importable(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        enc, part, seq, out = Encoder.of(tokenizer_path), TaskContext.get().partitionId(), 0, None
        width = 2 if max(enc.lib.get_vocab_size(), end_id or 0) <= 1 << 16 else 4
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        rows = []

        def close():
            out.close()
            rows.append((part, out.seq, out.path, len(out.bounds) - 1, out.n))

        for batch in batches:
            for key, text in zip(batch.column("i").to_pylist(), batch.column("t")):
                if out is None:
                    out = _Writer(folder, f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok", width)
                    out.seq = seq
                out.add(key, np.concatenate([enc.ids(text.as_py()), tail]))
                if out.n >= shard_ids:
                    close()
                    out, seq = None, seq + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).repartitionByRange(n, "i").sortWithinPartitions("i", "t")
    out = f"{folder}/_manifest"
    rows.mapInArrow(run, _MANIFEST).write.parquet(out)
    return spark.read.schema(_MANIFEST).parquet(out)


def read_tokens(manifest: DataFrame, schema: str, make, partitions: int | None = None) -> DataFrame:
    """Map each document of the shards: ``make(key, start, ids)`` gives a row of ``schema``.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    spark: SparkSession = manifest.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    names, kinds = zip(*(x.split() for x in schema.split(", ")))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                for key, start, ids in Shard(path).docs():
                    rows.append(make(key, base + start, ids))
                    if len(rows) == 4096:
                        yield _batch(rows, names, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    shards = manifest.select("path", "n_docs", before)  # one row a shard: bounded by the number of files
    return shards.repartition(n, "path").select("path", "base").mapInArrow(run, schema)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, common._TYPES[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))
