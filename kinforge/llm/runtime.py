"""Session helpers shared by the operators: table access, lineage cuts, worker imports."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow tables are joined by broadcast up to this many rows, and by a shuffle beyond.
BROADCAST_ROWS = 2_000_000
#: Rows and bytes in an Arrow batch: bound what JVM and worker hold of long texts.
BATCH_ROWS, ROWS_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_SETTING = 64 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is set, a local session gets a temporary one; a cluster has to name it.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinforge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder; a lost executor doesn't bring its lineage back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str = "table") -> tuple[DataFrame, str]:
    """df written once as Parquet into a new folder below the shared one and read back, and that folder."""
    path = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def filesystem(uri: str):
    """(file system, path) for workers, of a folder that Spark names by URI."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each followed by as many underscores as it takes to differ from all columns of df."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def map_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package, wherever the driver was started.

    Batches hold at most BATCH_ROWS rows and, but for a single longer row, about BATCH_BYTES bytes. The plan reads both
    settings when it is made, long after this call, so the session keeps the lower of its own values and these.
    """
    conf = df.sparkSession.conf
    for setting, most in ((ROWS_SETTING, BATCH_ROWS), (BYTES_SETTING, BATCH_BYTES)):
        if not 0 < int(str(conf.get(setting)).rstrip("bB")) <= most:
            conf.set(setting, str(most))
    environment = df.sparkSession.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH", "")]))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give freed memory back, as workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled df, to be broadcast if it has few enough rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def without(docs: DataFrame, leave: DataFrame, repeats: DataFrame, keys: list[str]) -> DataFrame:
    """docs without the rows whose keys are in leave, and with one row for each key in repeats; both are settled."""
    match = lambda other: [docs[k].eqNullSafe(other[k]) for k in keys]
    kept = docs.join(small(leave), match(leave), "left_anti")
    if repeats.isEmpty():
        return kept
    once = kept.join(repeats, [kept[k].eqNullSafe(repeats[k]) for k in keys], "left_semi").dropDuplicates(keys)
    return kept.join(repeats, [kept[k].eqNullSafe(repeats[k]) for k in keys], "left_anti").unionByName(once)


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from name -> (values, type)."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def texts(column: pa.Array) -> Iterator[str]:
    """The column's strings one by one; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups, and where each group lies, from batches whose rows are ordered by the columns in by."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if held.num_rows and any(held.column(x)[0] != held.column(x)[-1] for x in by):
            bounds = edges(held, by)
            yield held, bounds[:-1]
            held = held.slice(bounds[-1][0])
    if held is not None and held.num_rows:
        yield held, edges(held, by)


def edges(held: pa.Table, by: tuple[str, ...]) -> list[tuple[int, int]]:
    """(start, end) of each run of rows that agree in by."""
    columns = [held.column(x).to_numpy() for x in by]
    cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1
    bounds = [0, *cuts.tolist(), held.num_rows]
    return list(zip(bounds, bounds[1:], strict=False))
