"""Train and validation splits, and integrity checks."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def s1_ids(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("entity_id").alias("s1_id")).distinct()


def placed_by(rows: DataFrame, digest: Column) -> DataFrame:
    """rows with _place, their rank from 1 by a hexadecimal digest (ties in any order).

    A histogram over the digests' first digits tells what lies before each slice, so rows are only ranked within slices.
    """
    sliced = rows.withColumn("_digest", digest).withColumn("_slice", F.conv(F.substring("_digest", 1, 5), 16, 10).cast("int"))
    before = W.partitionBy(F.lit(1)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = sliced.groupBy("_slice").agg(F.count("*").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    placed = sliced.join(ahead, "_slice").withColumn("_place", F.col("_ahead") + F.row_number().over(W.partitionBy("_slice").orderBy("_digest")))
    return placed.drop("_digest", "_slice", "_ahead")


def lowest(rows: DataFrame, digest: Column, most: int) -> DataFrame:
    """The rows with the most smallest digests."""
    return placed_by(rows, digest).filter(F.col("_place") <= most).drop("_place")


def split_ids(ids: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """s1_id, split: exactly floor(n * share) ids go to val, those with the smallest MD5 of id and seed."""
    wanted = int(ids.count() * share)
    placed = placed_by(ids.select(F.col(ids.columns[0]).alias("s1_id")), F.md5(F.concat_ws(":", "s1_id", F.lit(seed))))
    return placed.select("s1_id", F.when(F.col("_place") <= wanted, "val").otherwise("train").alias("split"))


def replayed_split(ids: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """s1_id, split by a seeded shuffle of the sorted ids on the driver: an exact replay of published splits of small tables.

    Memory on the driver grows with the ids; use split_ids where that matters.
    """
    found = sorted(r[0] for r in ids.select(ids.columns[0]).distinct().toLocalIterator())
    random.Random(seed).shuffle(found)
    cut = len(found) - int(len(found) * share)
    return ids.sparkSession.createDataFrame([(x, "train" if i < cut else "val") for i, x in enumerate(found)], "s1_id string, split string")


def for_split(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The ground truth of a split's entities."""
    return links.join(ids.select(F.col(ids.columns[0]).alias("s1_id")).distinct(), "s1_id", "left_semi")


def check_split(split: DataFrame, ids: DataFrame, links: DataFrame) -> DataFrame:
    """One row: sizes, overlap, uncovered ids, uncovered ground truth, and whether all is well."""
    each = split.groupBy("s1_id").agg(F.max((F.col("split") == "train").cast("int")).alias("train"), F.max((F.col("split") == "val").cast("int")).alias("val"))
    joined = ids.select(F.col(ids.columns[0]).alias("s1_id")).distinct().withColumn("known", F.lit(1)).join(each, "s1_id", "full").join(links.select("s1_id").distinct().withColumn("truth", F.lit(1)), "s1_id", "left").fillna(0)
    split_any = (F.col("train") + F.col("val")) > 0
    counts = joined.agg(F.count_if(F.col("known") == 1).alias("total"), F.count_if(F.col("train") == 1).alias("train"), F.count_if(F.col("val") == 1).alias("val"), F.count_if((F.col("train") == 1) & (F.col("val") == 1)).alias("overlap"), F.count_if((F.col("known") == 1) & ~split_any).alias("uncovered"), F.count_if((F.col("truth") == 1) & ~split_any).alias("uncovered_truth"))
    return counts.withColumn("ok", (F.col("overlap") == 0) & (F.col("uncovered") == 0) & (F.col("uncovered_truth") == 0) & (F.col("train") + F.col("val") == F.col("total")))


def check_targets(targets: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links whose target is missing, and target ids that repeat."""
    known = targets.select(F.col("entity_id").alias("cand_id"))
    lost = links.join(known, "cand_id", "left_anti").agg(F.count("*").alias("missing_targets"))
    repeated = known.groupBy("cand_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("repeated_ids"))
    return lost.crossJoin(repeated).withColumn("ok", (F.col("missing_targets") == 0) & (F.col("repeated_ids") == 0))


def first_ids(ids: DataFrame, n: int) -> DataFrame:
    """The first n ids in string order."""
    return ids.orderBy(ids.columns[0]).limit(n)
