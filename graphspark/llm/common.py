"""Helpers shared by the corpus operators: tables, durable cuts, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.plans.durable import drop, persisted, shared_dir  # noqa: F401

#: Rows of one Arrow batch handed to slices of work, so that very long texts
#: cannot multiply a batch's temporary objects.
SLICE_CHARS = 4_000_000


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *([have] if have else [])])


_memos: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called as a task begins: memos of other operators that the worker process still holds are given up."""
    others = [k for k in _memos if k != owner]
    for k in others:
        _memos.pop(k)()
    _memos[owner] = clear
    if others:
        gc.collect()
        release()


def release() -> None:
    """Gives freed memory back to the system, as worker processes live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of at most SLICE_CHARS bytes of the text column (one row at least)."""
    n = batch.num_rows
    if not n or batch.column(text).nbytes <= SLICE_CHARS:
        yield batch
        return
    sizes = [len(x) if x is not None else 0 for x in batch.column(text).to_pylist()]
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > SLICE_CHARS:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    yield batch.slice(at)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list, list], dict]]) -> DataFrame:
    """Map (id, text) rows to columns.

    ``make()`` runs once a task and returns a function of (ids, texts) giving
    the output columns by name.  Only the two columns reach Python.
    """
    return map_texts_to_end(df, id_col, text_col, schema, lambda: (make(), None))


def map_texts_to_end(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable) -> DataFrame:
    """As :func:`map_texts`; ``make()`` returns that function and one that gives last rows (or None)."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))

    def batch_of(cols: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[n] if isinstance(cols[n], pa.Array) else pa.array(cols[n], type=_TYPES[k]) for n, k in zip(names, kinds)], names=list(names))

    def run(batches):
        work, end = make()
        for whole in batches:
            for batch in slices(whole, "t"):
                yield batch_of(work(batch.column("i").to_pylist(), batch.column("t").to_pylist()))
        if end:
            yield batch_of(end())

    importable(df.sparkSession)
    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
