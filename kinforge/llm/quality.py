"""Quality classifier: perplexity under a language model of trusted text, judged against each language's own quantiles.

Trusted text is what the labels call good. Four of five trusted documents train an interpolated modified Kneser-Ney
character model; the rest, which the model hasn't seen, give the quantiles. A document is rejected when its perplexity
lies above its language's threshold, the QUANTILE of the language's trusted perplexities. That quantile can't be seen in
fewer than 1 / (1 - QUANTILE) texts: a language with fewer held-out ones takes the quantile over all trusted texts of
all languages where that is higher. Quantiles come from mergeable sketches of bounded size.

Null and empty texts have no characters and are kept. Long texts are scored whole, and a text's score depends on its
characters alone. A null language is a language of its own. Ids may be null (then unlabelled) or repeat: every row is
judged, and rows that tie are judged alike. A table without trusted text rejects nothing, an empty table has no rows.
Other columns are ignored by ``judge`` and returned by ``keep_good``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm import kneser
from kinforge.llm.runtime import BROADCAST_ROWS, settle, small, stored, unused, without

QUANTILE = 0.999
#: Of the sketches: ranks are right to one in so many.
ACCURACY = 100_000


def folds(id_col: str):
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (id_col if none are named), and n_grams, perplexity, threshold (null if nothing is trusted) and good."""
    keep = keep or [id_col]
    trusted = settle(labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("_id", folds("_id").alias("_fold")))
    texts = docs.select(text_col, F.col(id_col).alias("_id"))
    if trusted.count() <= BROADCAST_ROWS:
        marked = texts.join(F.broadcast(trusted), "_id", "left").select(text_col, (F.coalesce(F.col("_fold"), F.lit(0)) > 0).alias("trained"))
        counts = kneser.part_counts(marked, text_col, "trained")
    else:  # training texts meet their labels by a shuffle, and all texts ask from where they lie
        training = texts.join(trusted.filter("_fold > 0"), "_id").withColumn("trained", F.lit(True))
        counts = kneser.part_counts(texts.withColumn("trained", F.lit(False)), text_col, "trained")
        counts = counts.union(kneser.part_counts(training, text_col, "trained").withColumn("part", F.lit(-1)))
    counts, _ = stored(counts, "grams")
    table = kneser.score_table(settle(kneser.corpus_counts(counts)))
    kept = docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("_doc"), F.col(lang_col).alias("_lang"), text_col)
    scored = settle(kneser.log_likelihoods(kept, counts, table, ["kept", "_doc", "_lang"], text_col))
    scored = scored.withColumn("bits", -F.col("loglik") / F.greatest(F.col("n_grams"), F.lit(1)))
    known = settle(scored.filter("n_grams > 0").join(small(trusted.withColumnRenamed("_id", "_doc")), "_doc").select("_lang", "_fold", "bits"))
    at = F.percentile_approx("bits", quantile, ACCURACY)
    overall = known.agg(at.alias("overall"))
    by_lang = known.filter("_fold = 0").groupBy(F.col("_lang").alias("_known")).agg(at.alias("own"), F.count("*").alias("seen"))
    judged = scored.join(F.broadcast(overall)).join(by_lang, F.col("_lang").eqNullSafe(F.col("_known")), "left")
    edge = F.when(F.col("seen") * (1 - quantile) >= 1, F.col("own")).otherwise(F.greatest("own", "overall"))
    good = F.coalesce((F.col("bits") <= edge) | (F.col("n_grams") == 0), F.lit(True))
    return judged.select("kept.*", "n_grams", F.exp("bits").alias("perplexity"), F.exp(edge).alias("threshold"), good.alias("good"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are good, with all their columns."""
    keys = unused(docs, "kinforge_id", "kinforge_lang", "kinforge_hash")
    marked = docs.withColumns(dict(zip(keys, (F.col(id_col), F.col(lang_col), F.xxhash64(text_col)), strict=True)))
    rejected = settle(judge(marked, labels, id_col, text_col, lang_col, keep=keys).filter("not good").select(*keys).distinct())
    return without(marked, rejected, rejected.limit(0), keys).drop(*keys)
