"""Error taxonomies: cascades of conditions, the first that holds names the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.functions.similarity import char_grams
from kinforge.operators.features import paired

# Words of generic business names, and the generic address words of the diagnostic (fewer than blocking's).
GENERIC_NAMES = tuple("care health center group services partners associates clinic hospital".split())
DIAGNOSTIC_GENERIC = tuple(
    "road rd street st drive dr avenue ave lane ln unit floor fl suite ste apt apartment null box po no near opp opposite behind phase plot sector "
    "flat block house hno kh door nd th east west north south city nagar colony bhavan complex building tower plaza market bazaar center centre".split()
)


def _jaccard0(a: Column, b: Column) -> Column:
    """Jaccard of arrays without repeats, 0.0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def _prefix(p: Column, q: Column) -> Column:
    return (p.startswith(q) | q.startswith(p)) & (p != q)


def error_category(a: str = "e1", b: str = "e2") -> Column:
    """Why a scored pair may have gone wrong, from two structs of normalised entities."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    s, t = F.array_distinct(x("name_tokens")), F.array_distinct(y("name_tokens"))
    some = (F.size(s) > 0) & (F.size(t) > 0)
    subset = (F.size(F.array_except(s, t)) == 0) | (F.size(F.array_except(t, s)) == 0)
    first = F.coalesce(_prefix(F.get(x("name_tokens"), F.lit(0)), F.get(y("name_tokens"), F.lit(0))), F.lit(False))
    names = _jaccard0(x("name_3grams"), y("name_3grams"))
    places = _jaccard0(F.array_distinct(x("addr_tokens")), F.array_distinct(y("addr_tokens")))
    return (
        # The category labels and their limits.
        F.when((x("norm_address") == "") | (y("norm_address") == ""), "missing_address")
        .when((x("raw_name") != y("raw_name")) & (x("norm_name") == y("norm_name")), "transliteration")
        .when(some & subset, "legal_suffix")
        .when(some & first, "abbreviation")
        .when((names >= 0.70) & (places < 0.20), "address_conflict")
        .when(names >= 0.75, "spelling_typo")
        .when((F.length(x("norm_name")) < 12) | (F.length(y("norm_name")) < 12), "generic_name")
        .otherwise("uncategorized")
    )


def missed_category(a: str = "e1", b: str = "e2") -> Column:
    """Why blocking may have missed a true link, from two structs of normalised entities."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    s, t = F.array_distinct(x("name_tokens")), F.array_distinct(y("name_tokens"))
    some = (F.size(s) > 0) & (F.size(t) > 0)
    same = some & (F.size(F.array_except(s, t)) == 0) & (F.size(F.array_except(t, s)) == 0)
    initials = lambda words: F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    first = F.coalesce(_prefix(F.get(x("name_tokens"), F.lit(0)), F.get(y("name_tokens"), F.lit(0))), F.lit(False))
    acronym = F.array_contains(y("name_tokens"), initials(x("name_tokens"))) | F.array_contains(x("name_tokens"), initials(y("name_tokens")))
    generic = (F.size(F.array_intersect(s, F.array(*[F.lit(w) for w in GENERIC_NAMES]))) > 0) & ((F.size(s) <= 2) | (F.size(t) <= 2))
    long = lambda side: F.array_distinct(F.filter(side("addr_tokens"), lambda w: F.length(w) >= 3))
    return (
        # The category labels and their limits.
        F.when(x("country") != y("country"), "country-related issue")
        .when((x("raw_name") != y("raw_name")) & (x("norm_name") == y("norm_name")), "transliteration")
        .when(same & (x("name_tokens") != y("name_tokens")), "word-order variation")
        .when(some & (first | acronym), "abbreviation")
        .when(_jaccard0(x("name_3grams"), y("name_3grams")) >= 0.65, "typo")
        .when(generic, "generic name")
        .when((x("norm_address") == "") | (y("norm_address") == ""), "missing address")
        .when(_jaccard0(long(x), long(y)) >= 0.40, "address variation")
        .when(F.size(F.array_intersect(s, t)) == 0, "exact/name normalization failure")
        .otherwise("unknown")
    )


def errors(scored: DataFrame, normal: DataFrame, threshold: float, score: str = "probability") -> DataFrame:
    """s1_id, cand_id, score, kind (fp, fn), category of the wrong decisions over pairs; n-grams are only made for these."""
    yes, true = F.col(score) >= threshold, F.col("label") == 1
    wrong = scored.filter(yes != true).select("s1_id", "cand_id", F.col(score).alias("score"), F.when(yes, "fp").otherwise("fn").alias("kind"))
    pairs = paired(wrong, normal.drop("name_3grams", "addr_3grams"))
    pairs = pairs.withColumns({e: F.col(e).withField("name_3grams", char_grams(F.col(f"{e}.norm_name"))) for e in ("e1", "e2")})
    return pairs.select("s1_id", "cand_id", "score", "kind", error_category().alias("category"))


def worst(errors: DataFrame, n: int = 10) -> DataFrame:
    """The n most confident errors of each kind and category; ties by ids."""
    confidence = F.when(F.col("kind") == "fp", -F.col("score")).otherwise(F.col("score"))
    ranked = errors.withColumn("rank", F.row_number().over(W.partitionBy("kind", "category").orderBy(confidence, "s1_id", "cand_id")))
    return ranked.filter(F.col("rank") <= n)


def missed_errors(missed: DataFrame, normal: DataFrame) -> DataFrame:
    """s1_id, cand_id, category of missed links."""
    return paired(missed, normal).select("s1_id", "cand_id", missed_category().alias("category"))


def token_frequency(targets: DataFrame) -> DataFrame:
    """token, df: in how many target addresses each word occurs."""
    return targets.select("entity_id", F.explode(F.array_distinct("addr_tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def shared_address_tokens(missed: DataFrame, normal: DataFrame, targets: DataFrame, rare: int = 100) -> DataFrame:
    """s1_id, cand_id, token, df and what the token is: postal, building, distinctive, rare; one row a shared address word."""
    both = paired(missed, normal).select("s1_id", "cand_id", F.explode(F.array_intersect("e1.addr_tokens", "e2.addr_tokens")).alias("token"))
    number = F.col("token").rlike("^[0-9]+$")
    postal = number & F.length("token").isin(5, 6)
    distinctive = (F.length("token") >= 3) & ~F.col("token").isin(*DIAGNOSTIC_GENERIC)
    return both.join(token_frequency(targets), "token", "left").fillna(0, ["df"]).select("s1_id", "cand_id", "token", "df", postal.alias("postal"), (number & ~postal).alias("building"), distinctive.alias("distinctive"), (distinctive & (F.col("df") <= rare)).alias("rare"))


def overlap_report(missed: DataFrame, normal: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: missed links, and how many share a postal code, a building number, a rare word, only common words, or nothing."""
    shared = shared_address_tokens(missed, normal, targets).groupBy("s1_id", "cand_id").agg(*[F.max(c).alias(c) for c in ("postal", "building", "rare")])
    each = missed.select("s1_id", "cand_id").join(shared.withColumn("any", F.lit(True)), ["s1_id", "cand_id"], "left").fillna(False, ["postal", "building", "rare", "any"])
    telling = F.col("postal") | F.col("building") | F.col("rare")
    return each.agg(F.count("*").alias("missed_links"), F.count_if("postal").alias("shared_postal"), F.count_if("building").alias("shared_building"), F.count_if("rare").alias("shared_rare"), F.count_if(F.col("any") & ~telling).alias("only_common"), F.count_if(~F.col("any")).alias("no_overlap"))


def useful_signals(missed: DataFrame, normal: DataFrame, targets: DataFrame, n: int = 50) -> DataFrame:
    """signal, links: the words, postal codes and numbers that missed links share most often; ties by signal."""
    shared = shared_address_tokens(missed, normal, targets)
    signals = F.array_compact(F.array(F.when(F.col("distinctive"), F.col("token")), F.when(F.col("postal"), F.concat(F.lit("POSTAL:"), "token")), F.when(F.col("building"), F.concat(F.lit("NUM:"), "token"))))
    return shared.select(F.explode(signals).alias("signal")).groupBy("signal").agg(F.count("*").alias("links")).orderBy(F.desc("links"), "signal").limit(n)
