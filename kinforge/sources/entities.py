"""Entity tables, ground truth and split files: scans and sinks."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions.text import strip

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share: the session's spark.checkpoint.dir.

    Where none is set, a local session gets a temporary one; a cluster has to name it.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="kinforge-")
        sc.setCheckpointDir(shared)
    return f"{shared}/scratch-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, written once below the shared folder and read back, so that neither later plans nor lost executors compute it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table_path(folder: str, split: str, source: str) -> str:
    """Where a source of a split lies; any split but train is the test split."""
    kind = "train" if split == "train" else "test"
    return os.path.join(folder, kind, f"{kind}_{source}.tsv")


def read_entities(spark: SparkSession, path: str, quoted: bool = True, multi_line: bool = False) -> DataFrame:
    """A tab-separated entity table with a header; short rows and blanks give empty strings. quoted=False splits at every tab."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"' if quoted else "", escape='"', multiLine=multi_line, mode="PERMISSIVE", enforceSchema=True)
    return raw.select(*[strip(F.col(c)).alias(c) for c in COLUMNS])


def write_entities(entities: DataFrame, path: str) -> None:
    """An entity table as quoted tab-separated files with headers."""
    told = entities.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS])
    told.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_ground_truth(links: DataFrame, s1_ids: DataFrame, path: str) -> None:
    """A row an entity with the ids that it matches, comma-joined in order; blank for none."""
    matched = links.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("matched_entity_ids"))
    asked = s1_ids.select(F.col(s1_ids.columns[0]).alias("source1_entity_id")).distinct()
    asked.join(matched, "source1_entity_id", "left").fillna("", ["matched_entity_ids"]).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"')


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id, matched (array); of repeated rows the last in the file counts."""
    raw = with_ordinal(spark.read.csv(path, sep="\t", header=True, schema="source1_entity_id string, matched_entity_ids string", quote='"', escape='"'))
    matched = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), strip), lambda x: x != "")
    told = raw.select(strip(F.col("source1_entity_id")).alias("source1_entity_id"), matched.alias("matched"), "ordinal").filter("source1_entity_id <> ''")
    return told.groupBy("source1_entity_id").agg(F.max_by("matched", "ordinal").alias("matched"))


def links(ground_truth: DataFrame) -> DataFrame:
    """s1_id, cand_id: one row a link."""
    return ground_truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode("matched").alias("cand_id")).distinct()


def by_source(matched):
    """(links into S2, links into S3) of an array of ids."""
    return F.filter(matched, lambda x: x.startswith("S2-")), F.filter(matched, lambda x: x.startswith("S3-"))


def normalised_store(entities: DataFrame, ids: DataFrame | None = None, normaliser=None) -> DataFrame:
    """Normalised entities, only those that are asked for: the others go before anything is made of them. None asks for all."""
    from kinforge.operators.blocking import normalised

    return normalised(entities if ids is None else only_ids(entities, ids), normaliser)


def with_ordinal(df: DataFrame) -> DataFrame:
    """The rows with their place in the file, from each partition's size and the place within it."""
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_part").withColumn("ordinal", F.col("_before") + F.col("_place")).drop("_at", "_part", "_place", "_before")


def only_ids(entities: DataFrame, ids: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Entities whose id is among ids (first column)."""
    return entities.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def target_subset(entities: DataFrame, required: DataFrame, least: int) -> DataFrame:
    """All required rows, and the first others in order until there are least rows together; needs an ordinal column.

    A row that isn't required is taken while fewer rows than the target come before it, so required rows that come later
    may lead beyond it. The first rows are a distributed top-k, never a sort of all rows in one task.
    """
    needed = required.select(F.col(required.columns[0]).alias("entity_id")).distinct()
    target = max(least, needed.count())
    others = entities.orderBy("ordinal").limit(target).join(needed, "entity_id", "left_anti")
    return entities.join(needed, "entity_id", "left_semi").unionByName(others)


def sample_in_order(entities: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The first n entities in order whose id is among ids; all of them if n is 0 or less."""
    found = only_ids(entities, ids)
    return found.orderBy("ordinal").limit(n) if n > 0 else found


def write_ids(ids: DataFrame, path: str) -> None:
    """One id a line."""
    ids.select(F.col(ids.columns[0]).cast("string")).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """entity_id: the distinct ids of a file with one a line."""
    return spark.read.text(path).select(strip(F.col("value")).alias("entity_id")).filter("entity_id <> ''").distinct()


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows (aggregates only) as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_text(report: DataFrame) -> str:
    """A report as indented JSON, all of its rows: reports are aggregates, and the text is made on the driver."""
    return json.dumps([r.asDict(recursive=True) for r in report.toLocalIterator()], indent=2, default=str)


def save_model(model, path: str) -> None:
    """A fitted model as one line of JSON."""
    SparkSession.active().createDataFrame([(model.told(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(path: str):
    from kinforge.operators.matching import LinearModel

    return LinearModel.read(SparkSession.active().read.text(path).first().value)
