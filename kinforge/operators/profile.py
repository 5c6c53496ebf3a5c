"""Profiles of entity tables, ground truth and block sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.operators.evaluate import distribution  # noqa: F401

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def entity_profile(entities: DataFrame) -> DataFrame:
    """One row: rows, blanks a column, ids, names, lengths and countries, all exact."""
    stripped = entities.select(*[text.strip(F.col(c)).alias(c) for c in COLUMNS], F.coalesce("entity_id", F.lit("")).alias("id"))
    n, m = F.length("business_name"), F.length("business_address")
    lengths = [e for of, name in ((n, "name"), (m, "addr")) for e in (F.min(of).alias(f"{name}_min"), F.max(of).alias(f"{name}_max"), F.round(F.avg(of), 2).alias(f"{name}_mean"), F.percentile(of, 0.5).alias(f"{name}_median"))]
    row = stripped.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c) == "").alias(f"missing_{c}") for c in COLUMNS], F.countDistinct("id").alias("unique_ids"), F.countDistinct(F.lower("business_name")).alias("unique_names"), F.countDistinct("country").alias("countries"), *lengths)
    return row.withColumn("duplicate_ids", F.col("rows") - F.col("unique_ids")).withColumn("duplicate_names", F.col("rows") - F.col("unique_names"))


def top_values(values: DataFrame, column: Column, name: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return values.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def top_names(entities: DataFrame, n: int = 5) -> DataFrame:
    return top_values(entities, F.lower(text.strip(F.col("business_name"))), "name", n)


def countries(entities: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent countries as written; the set of countries is open."""
    return top_values(entities, text.strip(F.col("country")), "country", n)


def truth_profile(links: DataFrame, s1_ids: DataFrame) -> DataFrame:
    """One row: entities with no, one and several links, links by source, and links an entity."""
    counts = link_counts(links, s1_ids)
    k = F.col("k")
    of = lambda s: F.coalesce(F.sum(f"{s}_links"), F.lit(0)).alias(f"{s}_links")
    return counts.agg(F.count("*").alias("entities"), F.count_if(k == 0).alias("zero"), F.count_if(k == 1).alias("single"), F.count_if(k > 1).alias("multi"), *[F.round(F.count_if(c) * 100.0 / F.count("*"), 2).alias(f"{n}_pct") for n, c in (("zero", k == 0), ("single", k == 1), ("multi", k > 1))], of("s2"), of("s3"), F.min(k).alias("least"), F.max(k).alias("most"), F.round(F.avg(k), 2).alias("mean"), F.percentile(k, 0.5).alias("median"))


def link_counts(links: DataFrame, s1_ids: DataFrame) -> DataFrame:
    """s1_id, k, s2_links, s3_links: how many links each entity has."""
    asked = s1_ids.select(F.col(s1_ids.columns[0]).alias("s1_id")).distinct()
    counts = links.groupBy("s1_id").agg(F.count("*").alias("k"), *[F.count_if(F.col("cand_id").startswith(f"{s.upper()}-")).alias(f"{s}_links") for s in ("s2", "s3")])
    return asked.join(counts, "s1_id", "left").fillna(0)


def link_distribution(links: DataFrame, s1_ids: DataFrame) -> DataFrame:
    """k, entities: how many entities have k links."""
    return link_counts(links, s1_ids).groupBy("k").agg(F.count("*").alias("entities"))


def block_stats(rows: DataFrame, key: Column) -> DataFrame:
    """One row: blocks, their sizes (p95 and p99 as sorted[floor(n * q)]), and how many exceed 100, 500 and 1000.

    Order statistics come from a histogram of the sizes, so sizes are never sorted in one task.
    """
    from pyspark.sql import Window as W

    sizes = rows.groupBy(key.alias("key")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("blocks"))
    one = W.partitionBy(F.lit(1))
    placed = sizes.withColumn("upto", F.sum("blocks").over(one.orderBy("size"))).withColumn("n", F.sum("blocks").over(one))
    size, n = F.col("size"), F.col("n")
    nth = lambda place: F.min(F.when(F.col("upto") > place, size))
    over = lambda k: F.coalesce(F.sum(F.when(size > k, F.col("blocks"))), F.lit(0)).alias(f"over_{k}")
    return placed.agg(
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.sum(size * F.col("blocks")) / F.sum("blocks"), 2).alias("mean_size"),
        ((nth(F.floor((n - 1) / 2)) + nth(F.floor(n / 2))) / 2.0).alias("median_size"), nth(F.floor(n * F.lit(0.95))).alias("p95_size"), nth(F.floor(n * F.lit(0.99))).alias("p99_size"), over(100), over(500), over(1000),
    )


def key_strategies(entities: DataFrame) -> DataFrame:
    """Block statistics of raw lower-case names, analysis names, and analysis names with the country."""
    name = text.analysis_name(F.col("business_name"))
    told = {"raw": F.lower("business_name"), "norm": name, "norm_country": F.concat(name, F.lit("___"), F.lower("country"))}
    parts = [block_stats(entities, key).withColumn("strategy", F.lit(s)) for s, key in told.items()]
    return parts[0].union(parts[1]).union(parts[2])


def _tokens(words: Column) -> Column:
    return F.explode(F.filter(words, lambda w: F.length(w) > 2))


def frequent_name_tokens(entities: DataFrame, n: int = 10) -> DataFrame:
    """token, n, pct: name words that aren't suffixes, by how often they occur, as a share of entities."""
    words = F.filter(text.analysis_words(F.col("business_name")), lambda w: ~w.isin(*text.ANALYSIS_SUFFIXES))
    return _frequent(entities, words, n)


def frequent_address_tokens(entities: DataFrame, n: int = 10) -> DataFrame:
    return _frequent(entities, text.words_of(text.standard(F.col("business_address")), 1), n)


def _frequent(entities: DataFrame, words: Column, n: int) -> DataFrame:
    top = top_values(entities.select(_tokens(words).alias("token")), F.col("token"), "token", n)
    total = entities.agg(F.count("*").alias("total"))
    return top.crossJoin(F.broadcast(total)).select("token", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"))


def frequent_postal_codes(entities: DataFrame, n: int = 10) -> DataFrame:
    return top_values(entities.withColumn("postal", text.postal_code(F.col("business_address"))).filter("postal <> ''"), F.col("postal"), "postal", n)


def key_alignment(links: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: true pairs, and how many agree in country, raw name, analysis name, both, and one or two name words."""
    words = F.array_distinct(F.filter(text.analysis_words(F.col("business_name")), lambda w: ~w.isin(*text.ANALYSIS_SUFFIXES)))
    side = entities.select("entity_id", F.struct(text.country(F.col("country")).alias("country"), F.lower(text.strip(F.col("business_name"))).alias("raw"), text.analysis_name(F.col("business_name")).alias("norm"), words.alias("words")).alias("e"))
    pairs = links.join(side.select(F.col("entity_id").alias("s1_id"), F.col("e").alias("x")), "s1_id").join(side.select(F.col("entity_id").alias("cand_id"), F.col("e").alias("y")), "cand_id")
    common = F.size(F.array_intersect("x.words", "y.words"))
    country, norm = F.col("x.country") == F.col("y.country"), (F.col("x.norm") == F.col("y.norm")) & (F.col("x.norm") != "")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(country).alias("same_country"), F.count_if(F.col("x.raw") == F.col("y.raw")).alias("same_raw"), F.count_if(norm).alias("same_norm"), F.count_if(norm & country).alias("same_norm_country"), F.count_if(common >= 1).alias("one_word"), F.count_if((common >= 2) | ((F.size("x.words") == 1) & (common == 1))).alias("two_words"))


def column_tables(entities: DataFrame) -> DataFrame:
    """source, column, rows, blank, blank_pct, distinct_values and longest: each column of each source, from one pass."""
    columns = [c for c in entities.columns if c != "entity_id"]
    value = {c: text.strip(F.coalesce(F.col(c), F.lit(""))) for c in columns}
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in value.items()]))
    source = F.substring_index("entity_id", "-", 1).alias("source")
    by_value = entities.select(source, long).groupBy("source", "column", "value").agg(F.count("*").alias("n"))
    rows = F.sum("n")
    blank = F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0))
    return by_value.groupBy("source", "column").agg(rows.alias("rows"), blank.alias("blank"), F.round(blank * 100.0 / rows, 2).alias("blank_pct"), F.count_if(F.col("value") != "").alias("distinct_values"), F.max(F.length("value")).alias("longest"))
