"""Values by key that reach the texts they belong to, by joins alone.

A first pass over the texts asks: each task tells the distinct keys of its partition, under the partition's number. The
keys are joined with a table of values, sharded by key, and the answers are written in the shared folder, a folder a
partition. A second pass over the same plan reads its own partition's answers. No table passes through the driver or
has to fit a worker whole, and the texts are read once to ask and once to look up, however large the table is.

Partitions are numbered alike in both passes as long as the scan is split alike. Where it isn't, a task finds keys that
its answers lack, and reads those from the whole table, file by file; results don't depend on the numbering.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from kinforge.llm.runtime import filesystem, shared_dir


def deliver(asked: DataFrame, table: DataFrame, key: str, value: str) -> str:
    """Write the table's values for the asked (part, key), but not for negative parts; return the folder. Keys that the table lacks are told as null."""
    path = f"{shared_dir(table.sparkSession)}/answers-{uuid.uuid4().hex}"
    answers = asked.filter("part >= 0").select("part", key).join(table.select(key, value), key, "left")
    answers.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def parquet_files(folder: str) -> tuple[object, list[str]]:
    """(file system, the Parquet files of a folder)."""
    from pyarrow import fs

    store, top = filesystem(folder)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return store, sorted(f.path for f in found if f.path.endswith(".parquet"))


class Answers:
    """The values of one partition's keys; otherwise (null, or absent from the whole table) the value is NaN."""

    def __init__(self, folder: str, part: int, whole: str, key: str, value: str):
        self.whole, self.key, self.value = whole, key, value
        keys, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
        store, files = parquet_files(f"{folder}/part={part}")
        for f in files:
            k, v = self.read(store, f)
            keys.append(k)
            values.append(v)
        self.hold(np.concatenate(keys), np.concatenate(values))

    def read(self, store, path: str) -> tuple[np.ndarray, np.ndarray]:
        # Opened as a stream: a path would be searched for partition columns.
        with store.open_input_file(path) as f:
            t = pq.read_table(f, columns=[self.key, self.value])
        return t.column(self.key).to_numpy(), t.column(self.value).to_numpy().astype(np.float32)

    def hold(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The values of distinct keys."""
        at, known = self.places(wanted)
        if not known.all():
            self.fetch(wanted[~known])
            at, known = self.places(wanted)
        return self.values[at].astype(np.float64)

    def fetch(self, wanted: np.ndarray) -> None:
        found_keys, found = [wanted], [np.full(len(wanted), np.nan, dtype=np.float32)]
        store, files = parquet_files(self.whole)
        for f in files:
            keys, values = self.read(store, f)
            here = np.isin(keys, wanted)
            found_keys.append(keys[here])
            found.append(values[here])
        keys, values = np.concatenate(found_keys), np.concatenate(found)
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.hold(np.concatenate([self.keys, keys[last]]), np.concatenate([self.values, values[last]]))
