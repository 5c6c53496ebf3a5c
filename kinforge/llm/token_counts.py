"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast to every worker: its entries are bounded by
``FREQUENT`` and come from bounded summaries of all partitions. Tier two is each worker's own bounded cache, filled by
encoding the misses of a batch together. Pre-tokens are never shuffled: only the summaries are.

Null and empty texts have no tokens. Ids may be null or repeat; every input row gives one output row. Other columns of
the input may have any name and are ignored, as is an empty table.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm import pretokens
from kinforge.llm.runtime import batch, map_batches, texts

#: Entries of the broadcast table, of a partition's summary, and of the counter behind it.
FREQUENT, SUMMARY, COUNTER = 65_536, 8_192, 200_000
BATCH_CHARS = 4_000_000


def chunks(items, size=BATCH_CHARS):
    """Lists of texts of about size characters together."""
    held, n = [], 0
    for x in items:
        held.append(x)
        n += len(x)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def frequent_pretokens(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent pre-tokens over all partitions, by lossy counting in each; a hint for speed that no result depends on."""

    def summarise(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for text in texts(b.column(0)):
                if pretokens.plain(text):
                    seen.update(pretokens.BYTE_LEVEL.findall(text))
                if len(seen) > 2 * COUNTER:
                    seen = Counter(dict(seen.most_common(COUNTER)))
        top = seen.most_common(SUMMARY)
        yield batch({"pretoken": ([x for x, _ in top], pa.string()), "n": ([n for _, n in top], pa.int64())})

    found = map_batches(docs.select(text_col), summarise, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return [r.pretoken for r in found.orderBy(F.desc("n"), "pretoken").limit(FREQUENT).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes (UTF-8) and n_tokens as the tokenizer library gives them for the whole text."""
    spark = docs.sparkSession
    words = frequent_pretokens(docs, text_col)
    lengths = pretokens.Lengths(tokenizer_path)._learn(words) if words else {}
    shared = spark.sparkContext.broadcast(lengths)
    kind = dict(docs.dtypes)[id_col]

    def count(batches):
        counter = pretokens.Lengths(tokenizer_path, shared.value)
        for b in batches:
            n = [k for some in chunks(texts(b.column(1))) for k in counter.counts(some)]
            yield batch({"id": (b.column(0), b.column(0).type), "n_bytes": (pc.fill_null(pc.cast(pc.binary_length(b.column(1)), pa.int64()), 0), pa.int64()), "n_tokens": (n, pa.int64())})

    return map_batches(docs.select(id_col, text_col), count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
