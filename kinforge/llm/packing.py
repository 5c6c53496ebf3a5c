"""Best-fit packing of token sequences, online and in bounded space.

Each task packs the documents of its own partition as they come, so nothing is shuffled; small partitions are put together
first, until there is one for every TASK_CHARS characters. A fixed number of bins is open;
a bitset keyed by free space holds which amounts of free space are on offer, so that the tightest bin for a piece is the
lowest set bit at or above its length. When one bin too many would be open, the fullest closes first. Partitions share
no bin, which leaves at most OPEN bins of each partition short of full.

Null text counts as empty: a document is its ids and one end id, so an empty one is a piece of length 1. Only documents
longer than a bin are cut, and long texts are encoded whole first. Ids may be null or repeat: every row is packed on its
own, and equal rows are packed as often as they come. An empty table has no pieces. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm import pretokens
from kinforge.llm.runtime import batch, map_batches, texts
from kinforge.llm.token_counts import chunks

#: Bins open at once in a task.
OPEN = 1024
END_ID = 0
#: Texts that are encoded together: distinct words are looked up once for all of them.
BATCH_CHARS = 2_000_000
#: Characters a task: bins left open are few beside those that so much text fills.
TASK_CHARS = 16_000_000


class BestFit:
    """Online best fit over bins of one capacity, of which at most open_bins are open."""

    def __init__(self, capacity: int, open_bins: int = OPEN, first_bin: int = 0):
        self.capacity, self.open_bins, self.next_bin = capacity, open_bins, first_bin
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        self.count -= 1
        if not bins:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1..capacity tokens."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.count += 1
        return found, self.capacity - free


def together(docs: DataFrame, text_col: str, task_chars: int = TASK_CHARS) -> DataFrame:
    """docs in no more partitions than their characters ask for."""
    chars = docs.agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 1)).first()[0] or 0
    return docs.coalesce(max(1, chars // task_chars))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN) -> DataFrame:
    """Per piece: id_col, piece, start, length, sequence_id, offset and ids (little-endian unsigned 32-bit token ids)."""
    kind = dict(docs.dtypes)[id_col]
    end = END_ID.to_bytes(4, "little")

    def pack(batches):
        encoder = pretokens.ids(tokenizer_path)
        fit = BestFit(capacity, open_bins, first_bin=TaskContext.get().partitionId() << 40)
        for b in batches:
            at = 0
            for some in chunks(texts(b.column(1)), BATCH_CHARS):
                rows, pieces, starts, lengths, bins, offsets, ids = [], [], [], [], [], [], []
                for row, coded in enumerate(encoder.encode(some), at):
                    coded += end
                    total = len(coded) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        found, offset = fit.place(length)
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        bins.append(found)
                        offsets.append(offset)
                        ids.append(coded[4 * start : 4 * (start + length)])
                at += len(some)
                yield batch({"id": (b.column(0).take(pa.array(rows, pa.int64())), b.column(0).type), "piece": (pieces, pa.int32()), "start": (starts, pa.int64()), "length": (lengths, pa.int64()), "sequence_id": (bins, pa.int64()), "offset": (offsets, pa.int64()), "ids": (ids, pa.binary())})

    return map_batches(together(docs.select(id_col, text_col), text_col), pack, f"id {kind}, piece int, start long, length long, sequence_id long, offset long, ids binary").withColumnRenamed("id", id_col)
