"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each partition of the scan is a leaf, whose run holds one row per digest: the best row there and how many rows it stands
for. There are as many places as leaves, rounded up to a power of two (and at most LEAVES; further leaves share places). In
round r every place exchanges with the place whose number differs in bit r: either keeps the digests that agree with
its own number in that bit, and merges the sorted runs that reach it. After as many rounds as the number has bits, each
place holds the digests that end in its number, once each. No place gets more than its share of the rows, and a digest
that a third of all rows hold is one row a run from the start.

Every level keeps the best row, and digests only meet when a second, independent hash and the normalised length agree
too. Winners return to the leaves' runs, and from there to the rows of each leaf, so that no join meets more than
LEAVES rows of one digest, or the rows of one leaf.

Null text counts as empty, and texts of white space alone are equal to it. Long texts are read whole, and only their
digests move. Of equal texts the one with the most code points stays, then the smallest id (null last), then the first
row read: repeated rows are copies like any others, and exactly one row of a group is kept. An empty table has no
groups. Other columns are ignored by ``exact_groups`` and returned by ``drop_copies``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.runtime import settle, unused, without

#: The most places that runs are merged in.
LEAVES = 4096
KEY = ["digest", "check", "size"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def fingerprint(text: Column) -> Column:
    """(digest, check, size): SHA-256 of the normalised text, an independent hash of it, and its bytes."""
    plain = normalised(text)
    return F.struct(F.unhex(F.sha2(plain, 256)).alias("digest"), F.xxhash64(plain).alias("check"), F.octet_length(plain).alias("size"))


def rounds_for(leaves: int) -> int:
    """The bits that number the places of so many leaves: one round each."""
    return (min(max(leaves, 1), LEAVES) - 1).bit_length()


def exchanged(run: DataFrame, r: int, places: int) -> DataFrame:
    """Round r: rows go to the place that has bit r from their digest and the rest from where they are; the runs that meet are merged."""
    bit = 1 << r
    place = F.col("place").bitwiseAND(places - 1 - bit).bitwiseOR(F.col("check").bitwiseAND(bit).cast("int"))
    met = run.withColumn("place", place).repartitionById(places, "place").sortWithinPartitions("place", *KEY)
    return met.groupBy("place", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, keep_id, group_size, kept and text_sha256."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        fingerprint(F.col(text_col)).alias("print"),
        (-F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("rank"),
        F.spark_partition_id().alias("leaf"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = settle(rows.select("id", "print.digest", "print.check", "print.size", "rank", "leaf", "row"))
    rounds = rounds_for((rows.agg(F.max("leaf")).first()[0] or 0) + 1)
    places = 1 << rounds
    rows = rows.withColumn("place", F.col("leaf").bitwiseAND(places - 1))
    best = F.struct("rank", F.col("id").isNull().alias("unknown"), "id", "row")
    leaves = rows.groupBy("place", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    run = leaves
    for r in range(rounds):
        run = exchanged(run, r, places)
    won = settle(run.filter("n > 1").select(*KEY, F.col("best").alias("won"), F.col("n").alias("group_size")))
    told = leaves.select("place", *KEY).join(won, KEY)
    joined = rows.join(told, ["place", *KEY], "left")
    alone = F.col("won").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("won.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("won.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows find their verdict by id and digest; rows that agree in both are one row told several times, and one of them stays.
    """
    keys = unused(docs, "kinforge_id", "kinforge_digest")
    dropped = settle(exact_groups(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias(keys[0]), F.col("keep_id").alias("_keep"), F.unhex("text_sha256").alias(keys[1])))
    told_again = F.col(keys[0]).eqNullSafe(F.col("_keep"))
    leave, repeats = (settle(dropped.filter(c).select(*keys).distinct()) for c in (~told_again, told_again))
    marked = docs.withColumns({keys[0]: F.col(id_col), keys[1]: F.unhex(F.sha2(normalised(F.col(text_col)), 256))})
    return without(marked, leave, repeats, keys).drop(*keys)
