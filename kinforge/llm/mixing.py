"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a target in words: its share of all words by weight, at most CAP times its own words, the excess going
to the others by weight. A source is taken in complete epochs first; the rest comes from the head of the source in the
order of exponential keys -ln(u) / quality, u being a hash of id and seed.

The prefix sums behind that run over slices of the keys' logarithm, STEP of them to a unit. Quality only shifts that
logarithm, so whatever a source's quality, a slice holds at most 1 / (e * STEP) of the rows of any one quality. Slices are
summed GROUP at a time first, and the groups after that. Where a source's budget ends inside a slice, that slice alone is
sorted, to find the last document that fits; every other row only compares itself with that one, so that neither texts
nor rows are shuffled. Only one row a source meets in one task, to share the words out.

Null and empty texts have no words, no weight in the order and nothing to take; long texts are counted whole. A null source is a
source of its own that comes last. Ids may be null or repeat: rows that agree in id, size and text tie and are
interchangeable, and of those at the edge as many are taken as fit.
A document is taken whole: the one at the edge counts if half of it fits. An empty table gives an empty mix. Other
columns are returned if keep names them, and ignored if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.llm.runtime import settle, small

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 42
#: Slices in a unit of the keys' logarithm, and slices that are summed together.
STEP, GROUP = 4096, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A document's quality weight, in (0, 1]: the share of letters among its characters that aren't blank."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return (1 + F.char_length(F.regexp_replace(solid, r"[^\p{L}]+", ""))) / (1 + F.char_length(solid))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The columns in keep (id_col if none are named), and size, source_size, target, copies and taken."""
    keep = keep or [id_col]
    rows = docs.select(
        F.struct(*keep).alias("kept"),
        F.struct(F.col(source_col).isNull().alias("last"), F.col(source_col).alias("name")).alias("s"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("sk"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        letter_share(F.col(text_col)).alias("quality"),
        F.xxhash64(text_col).alias("hash"),
    )
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(u) / F.col("quality")).withColumn("bucket", F.floor(STEP * F.log("key")).cast("int"))
    narrow = settle(rows if text_col not in keep else rows.drop("kept"))
    if text_col not in keep:
        rows = narrow
    slices = narrow.groupBy("s", "sk", "bucket").agg(F.sum("size").alias("slice"))

    # One row per source from here on.
    sources = slices.groupBy("s", "sk").agg(F.sum("slice").alias("source_size"))
    numbered = sources.withColumn("nth", F.row_number().over(W.orderBy("s")) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    everything = W.partitionBy(F.lit(1))
    by_ratio = W.partitionBy(F.lit(1)).orderBy((F.col("cap") / F.col("weight")), "nth")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    shares = (
        numbered.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("open_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weights", F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("open_weights") <= F.col("weight") * F.col("open_words"))
        .withColumn("left_words", F.max(F.when(~F.col("capped"), F.col("open_words"))).over(everything))
        .withColumn("left_weights", F.max(F.when(~F.col("capped"), F.col("open_weights"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left_words")).cast("double") / F.col("left_weights")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("sk", "source_size", "target", "epochs", "rest")
    )
    group = F.floor(F.col("bucket") / GROUP).cast("int")
    upto = lambda total, over: F.coalesce(F.sum(total).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = slices.groupBy("sk", group.alias("group")).agg(F.sum("slice").alias("words"))
    groups = groups.select("sk", "group", upto("words", W.partitionBy("sk").orderBy("group")).alias("before"))
    ahead = slices.withColumn("group", group).withColumn("within", upto("slice", W.partitionBy("sk", "group").orderBy("bucket")))
    ahead = ahead.join(groups, ["sk", "group"]).withColumn("ahead", F.col("before") + F.col("within"))
    reached = ahead.join(shares, "sk").filter((F.col("rest") > 0) & (F.col("ahead") <= F.col("rest"))).groupBy("sk").agg(F.max(F.struct("bucket", "ahead")).alias("m"))
    edges = settle(shares.join(reached, "sk", "left").select("sk", "source_size", "target", "epochs", "rest", F.col("m.bucket").alias("edge"), F.col("m.ahead").alias("ahead")))

    # The slice in which a source's budget ends, and the last document that fits.
    place = F.struct("key", "id", "size", "hash")
    at_edge = narrow.join(small(edges.select("sk", "edge", "ahead", "rest")), "sk").filter("bucket = edge")
    inside = upto("size", W.partitionBy("sk").orderBy("key", "id", "size", "hash"))
    at_edge = at_edge.withColumn("fits", F.col("ahead") + inside + F.col("size") / 2.0 <= F.col("rest")).select("sk", place.alias("place"), "fits")
    ends = at_edge.groupBy("sk", "place").agg(F.count_if("fits").alias("fitting"), F.count("*").alias("tied")).filter("fitting > 0")
    ends = ends.groupBy("sk").agg(F.max(F.struct("place", "fitting", "tied")).alias("e")).select("sk", F.col("e.place").alias("end"), "e.fitting", "e.tied")
    cuts = settle(edges.join(ends, "sk", "left").select("sk", "source_size", "target", "epochs", "edge", "end", "fitting", "tied"))

    placed = rows.join(small(cuts), "sk")
    here = F.col("bucket") == F.col("edge")
    tie = F.coalesce(here & (place == F.col("end")), F.lit(False))
    fits = F.coalesce((F.col("bucket") < F.col("edge")) | here & (place < F.col("end")), F.lit(False)) | tie
    told = lambda df, fits: df.select("kept.*", "size", "source_size", "target", (F.col("epochs") + F.when(fits, 1).otherwise(0)).cast("long").alias("copies"))
    if cuts.filter("fitting < tied").isEmpty():
        out = told(placed, fits)
    else:
        some = tie & (F.col("fitting") < F.col("tied"))
        nth = F.row_number().over(W.partitionBy("sk").orderBy("size"))
        out = told(placed.filter(~some), fits).unionByName(told(placed.filter(some).withColumn("nth", nth), F.col("nth") <= F.col("fitting")))
    return out.withColumn("taken", F.col("copies") * F.col("size"))
