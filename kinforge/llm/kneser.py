"""Interpolated modified Kneser-Ney over packed character n-grams, trained and looked up by joins on count tables.

An n-gram is one long: WIDTH bits per character, the last character lowest, so that dropping the first character is a
mask and the context is a shift. Counts come from every text given; all tables grow with the corpus. ``score_table``
gives the interpolated log-probability of every n-gram that occurs in the corpus, seen in training or not; lookups then
need no backing off. Counts are sharded by n-gram and joined with the n-grams that each partition of the texts holds
(``lookups``), which takes one pass over the texts to count and one to add up, whatever the size of the tables.

Characters of the basic plane have a number each. The numbers that no text can hold (surrogates) mark repetitions, and
stand for the rarer characters beyond the plane, several of which share one. A repetition mark is a symbol like any
other: its probability is what the trusted text makes of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.lookups import Answers, deliver
from kinforge.llm.runtime import batch, map_batches, settle, stored

WIDTH, ORDER = 16, 4
#: Character numbers: 0 starts a text; REPEAT + k stands for the k-th repetition of a word in a row, up to RUN; characters beyond the basic plane share RARE to PLANE.
REPEAT, RUN, PLANE = 0xD800, 90, 0xE000
RARE = REPEAT + RUN + 1
BATCH_CHARS = 1_000_000


def without_repeats(text: str) -> str:
    """The text with a character for the k-th repetition in place of each word that equals the one before it."""
    words = text.split(" ")
    if any(map(str.__eq__, words, words[1:])):
        out, run = [words[0]], 0
        for a, b in zip(words, words[1:], strict=False):
            run = min(run + 1, RUN) if a == b and a else 0
            out.append(chr(REPEAT + run) if run else b)
        return " ".join(out)
    return text


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """One packed n-gram for each character of the text."""
    points = np.frombuffer(without_repeats(text).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    points = np.where(points < 1 << WIDTH, points, RARE + points % (PLANE - RARE))
    padded = np.concatenate([np.zeros(order - 1, dtype=np.int64), points])
    packed = np.zeros(len(points), dtype=np.int64)
    for k in range(order):
        packed = (packed << WIDTH) | padded[k : k + len(points)]
    return packed


def in_bulk(rows: Iterator, size: int = BATCH_CHARS) -> Iterator[list]:
    """Lists of (text, ...) rows of about size characters together."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def part_counts(docs: DataFrame, text_col: str, trained_col: str, order: int = ORDER) -> DataFrame:
    """part, g, n: the n-grams of each partition and how often its training texts (trained_col) hold them."""

    def count(batches):
        total: dict | pd.Series = pd.Series(dtype=np.int64)
        for b in batches:
            rows = ((t.as_py() or "", bool(y.as_py())) for t, y in zip(b.column(0), b.column(1), strict=True))
            for some in in_bulk(rows):
                each = [grams(t, order) for t, _ in some]
                codes, uniques = pd.factorize(np.concatenate(each))
                trained = np.repeat([y for _, y in some], [len(x) for x in each])
                n = np.bincount(codes, weights=trained, minlength=len(uniques)).astype(np.int64)
                total = total.add(pd.Series(n, index=uniques), fill_value=0)
        part = np.full(len(total), TaskContext.get().partitionId(), dtype=np.int32)
        yield batch({"part": (pa.array(part), pa.int32()), "g": (pa.array(total.index.to_numpy(dtype=np.int64)), pa.int64()), "n": (pa.array(total.to_numpy(dtype=np.int64)), pa.int64())})

    return map_batches(docs.select(text_col, trained_col), count, "part int, g long, n long")


def gram_counts(docs: DataFrame, text_col: str, trained_col: str, order: int = ORDER) -> DataFrame:
    """g, n: every n-gram of the corpus and how often training texts (trained_col) hold it, added up in each task first."""
    return corpus_counts(part_counts(docs, text_col, trained_col, order))


def corpus_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's D1, D2 and D3+ from counts of counts."""
    r = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, r[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def discount(n: Column, d: list[float]) -> Column:
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


def score_table(corpus: DataFrame, order: int = ORDER) -> DataFrame:
    """g, logp for each n-gram of the corpus (g, n); n is its count in training texts, 0 if they lack it."""
    seen = corpus.filter("n > 0")
    levels = {order: seen}
    for k in range(order - 1, 0, -1):  # continuation counts: in how many longer n-grams it occurs
        levels[k] = levels[k + 1].groupBy((F.col("g").bitwiseAND((1 << WIDTH * k) - 1)).alias("g")).agg(F.count("*").alias("n"))
    asked = {order: corpus.select("g")}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.col("g").bitwiseAND((1 << WIDTH * k) - 1).alias("g")).distinct()
    lower = None
    for k in range(1, order + 1):
        d = discounts(levels[k])
        context = F.shiftrightunsigned("g", WIDTH)
        by_context = levels[k].groupBy(context.alias("h")).agg(F.sum("n").alias("total"), F.sum(discount(F.col("n"), d)).alias("cut"))
        own = asked[k].join(levels[k], "g", "left").withColumn("h", context).join(by_context, "h", "left")
        if lower is None:
            own = own.withColumn("below", F.lit(1.0 / (1 << WIDTH)))
        else:
            own = own.withColumn("s", F.col("g").bitwiseAND((1 << WIDTH * (k - 1)) - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
        n = F.coalesce("n", F.lit(0))
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((n - discount(n, d) + F.col("cut") * F.col("below")) / F.col("total"))
        lower = own.select("g", p.alias("p"))
        lower = settle(lower) if k == order - 1 else lower
    return lower.select("g", F.log("p").alias("logp"))


def log_likelihoods(docs: DataFrame, counts: DataFrame, table: DataFrame, keep: list[str], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The columns in keep, n_grams and loglik of each text, under a score table; counts are the texts' own part_counts, settled."""
    table, whole = stored(table.select("g", F.col("logp").cast("float").alias("logp")), "scores")
    folder = deliver(counts, table, "g", "logp")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_grams long, loglik double"

    def score(batches):
        answers = Answers(folder, TaskContext.get().partitionId(), whole, "g", "logp")
        for b in batches:
            sums, sizes = [], []
            for some in in_bulk((t.as_py() or "",) for t in b.column(len(keep))):
                each = [grams(t, order) for (t,) in some]
                size = np.array([len(x) for x in each])
                codes, uniques = pd.factorize(np.concatenate(each))
                value = np.nan_to_num(answers.of(uniques)) if len(uniques) else np.zeros(0)
                along = np.concatenate([[0.0], np.cumsum(value[codes])])
                ends = np.cumsum(size)
                sums += (along[ends] - along[ends - size]).tolist()
                sizes += size.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=[*keep, "n_grams", "loglik"])

    return map_batches(docs.select(*keep, text_col), score, schema)
