"""Whole runs over entity tables, each a dictionary of small report tables.

What several reports share (normalised entities, pairs, features) is persisted: lost blocks come back from their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators import blocking, errors, evaluate, features, matching, profile, splits


def sources(entities: DataFrame, source: str) -> DataFrame:
    return entities.filter(F.col("entity_id").startswith(f"{source}-"))


def blocking_run(entities: DataFrame, links: DataFrame, config: blocking.Config = blocking.Config(), s1_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index statistics, frequent keys, recall and candidate counts of each stage, and what was missed."""
    normal = blocking.normalised(entities).persist()
    queries, targets = sources(normal, "S1"), normal.filter(~F.col("entity_id").startswith("S1-"))
    ids = s1_ids if s1_ids is not None else splits.s1_ids(queries)
    queries = queries.join(ids.select(F.col(ids.columns[0]).alias("entity_id")), "entity_id", "left_semi")
    pairs = blocking.candidates(queries, targets, config).persist()
    missed = blocking.missed(links.join(ids.select(F.col(ids.columns[0]).alias("s1_id")), "s1_id", "left_semi"), pairs)
    postings = blocking.prune(blocking.keys(targets, config), config)
    return {
        "index": blocking.index_stats(targets, config),
        **{f"top_{p}": blocking.top_keys(postings, p) for p in ("b3", "b4", "b5a", "b5b")},
        "recall": evaluate.recall_by_stage(pairs, links, ids),
        "candidates": evaluate.candidate_distribution(pairs, ids),
        "incremental": evaluate.incremental(pairs, links),
        "missed": errors.missed_errors(missed, normal).groupBy("category").agg(F.count("*").alias("n")),
        "missed_overlap": errors.overlap_report(missed, normal, targets),
    }


def matching_run(entities: DataFrame, links: DataFrame, split: DataFrame, config: blocking.Config = blocking.Config(), most_negatives: int | None = None, thresholds=evaluate.THRESHOLDS, seed: int = 42) -> dict[str, DataFrame]:
    """Train on the split's train entities, score those of val, and report metrics, the sweep, cardinality and errors.

    All train pairs are fitted on; most_negatives bounds the negatives among them, if it is given.
    """
    normal = blocking.normalised(entities).persist()
    targets = normal.filter(~F.col("entity_id").startswith("S1-"))
    pairs = blocking.labelled(blocking.candidates(sources(normal, "S1"), targets, config), links).join(split, "s1_id")
    made = features.pair_features(pairs, normal).persist()
    train = made.filter("split = 'train'")
    model = matching.fit(train if most_negatives is None else matching.sample_negatives(train, most_negatives, seed))
    val_ids = split.filter("split = 'val'").select("s1_id")
    scored = matching.score(made.filter("split = 'val'"), model).withColumn("rule", matching.rule_score())
    truth = splits.for_split(links, val_ids)
    sweep = evaluate.entity_metrics(scored, truth, val_ids, thresholds)
    best = float(evaluate.best_threshold(sweep).first().threshold)
    wrong = errors.errors(scored, normal, best)
    return {
        "rule": evaluate.pairwise(scored, 0.5, "rule"),
        "rule_entities": evaluate.entity_metrics(scored, truth, val_ids, (0.5,), "rule"),
        "sweep": sweep,
        "pairwise": evaluate.pairwise(scored, best),
        "cardinality": evaluate.by_cardinality(scored, truth, val_ids, best),
        "recall": evaluate.recall_by_stage(pairs.filter("split = 'val'"), truth, val_ids),
        "errors": wrong.groupBy("kind", "category").agg(F.count("*").alias("n")),
        "worst_errors": errors.worst(wrong),
    }


def profile_run(entities: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Profiles of a table and its ground truth."""
    ids = splits.s1_ids(sources(entities, "S1"))
    return {
        "profile": profile.entity_profile(entities),
        "names": profile.top_names(entities),
        "countries": profile.countries(entities),
        "truth": profile.truth_profile(links, ids),
        "links": profile.link_distribution(links, ids),
        "blocks": profile.key_strategies(entities),
        "alignment": profile.key_alignment(links, entities),
    }
