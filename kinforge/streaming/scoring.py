"""Score new master records as they arrive: each micro-batch is joined with postings that stay the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators import blocking, features, matching


def scorer(targets: DataFrame, write: Callable[[DataFrame, int], None], config: blocking.Config = blocking.Config(), model=None) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch: blocks, scores by rules or by a model, and writes s1_id, cand_id, source and score.

    A batch without candidates writes an empty table, so that its records still count as seen.
    """

    def each(batch: DataFrame, number: int) -> None:
        queries = blocking.normalised(batch)
        pairs = blocking.candidates(queries, targets, config)
        both = queries.unionByName(targets)
        if model is None:
            made = features.pair_features(pairs, both, ("name_exact", "name_token_jaccard", "country_match"))
            scored = made.withColumn("score", matching.rule_score())
        else:
            scored = matching.score(features.pair_features(pairs, both), model).withColumn("score", F.col("probability"))
        write(scored.select("s1_id", "cand_id", "source", "score"), number)

    return each
