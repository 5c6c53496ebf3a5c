import pytest
from pyspark.sql import functions as F

from kinforge.operators import evaluate, matching, profile, splits


@pytest.fixture(scope="module")
def toy(spark):
    scored = spark.createDataFrame([("a", "S2-1", 1, 0.9), ("a", "S2-2", 0, 0.8), ("b", "S2-3", 1, 0.4), ("d", "S3-1", 0, 0.1)], "s1_id string, cand_id string, label int, probability double")
    links = spark.createDataFrame([("a", "S2-1"), ("b", "S2-3"), ("b", "S3-9")], "s1_id string, cand_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    return scored, links, ids


def test_missed_candidates_count_as_misses(toy):
    scored, links, ids = toy
    r = evaluate.entity_metrics(scored, links, ids, (0.5,)).first()
    assert (r.s1_tp, r.s1_fp, r.s1_fn, r.exact, r.total_s1) == (1, 1, 2, 2, 4)
    assert r.s1_precision == 0.5 and r.s1_recall == pytest.approx(1 / 3)
    low = evaluate.entity_metrics(scored, links, ids, (0.3,)).first()
    assert (low.s1_tp, low.s1_fp, low.s1_fn) == (2, 1, 1)


def test_pairwise_and_cardinality(toy):
    scored, links, ids = toy
    r = evaluate.pairwise(scored, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1) and r.f1 == 0.5
    got = {r.group: (r.entities, r.exact) for r in evaluate.by_cardinality(scored, links, ids, 0.5).collect()}
    assert got == {"zero": (2, 2), "single": (1, 0), "multi": (1, 0)}


def test_nothing_at_all(spark, toy):
    scored, links, ids = toy
    r = evaluate.entity_metrics(scored.limit(0), links.limit(0), ids, (0.5,)).first()
    assert (r.s1_tp, r.exact, r.s1_precision, r.s1_f05) == (0, 4, 0.0, 0.0)


def test_best_threshold_takes_the_first_on_ties(spark):
    sweep = spark.createDataFrame([(0.3, 0.90001), (0.4, 0.90004), (0.5, 0.9)], "threshold double, s1_f05 double")
    assert evaluate.best_threshold(sweep).first().threshold == 0.4
    assert evaluate.best_threshold(sweep, rounded=True).first().threshold == 0.3


def test_order_statistics_are_places_not_interpolations(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(100) for _ in range(i + 1)], "key string")
    r = profile.block_stats(rows, F.col("key")).first()
    assert (r.blocks, r.p95_size, r.p99_size, r.median_size, r.over_100) == (100, 96, 100, 50.5, 0)


def test_split(spark):
    ids = spark.range(1003).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    split = splits.split_ids(ids)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"val": 200, "train": 803}
    assert split.exceptAll(splits.split_ids(ids.repartition(7))).count() == 0
    assert splits.check_split(split, ids, ids.limit(5)).first().ok
    assert not splits.check_split(split.limit(10), ids, ids).first().ok
    replay = splits.replayed_split(ids)
    assert replay.filter("split = 'val'").count() == 200


def test_negatives_are_sampled_exactly(spark):
    pairs = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("s1_id"), F.lit("c").alias("cand_id"), (F.col("id") < 50).cast("int").alias("label"))
    got = matching.sample_negatives(pairs, 700)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {1: 50, 0: 700}
    assert got.exceptAll(matching.sample_negatives(pairs.repartition(3), 700)).count() == 0
    assert matching.sample_negatives(pairs, 10**9).count() == 5000


def test_model(spark, tmp_path):
    from kinforge.sources.entities import load_model, save_model

    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    with pytest.raises(ValueError):
        matching.fit(df.limit(0), ("x", "y"))
    with pytest.raises(RuntimeError):
        matching.score(df, None)
    model = matching.fit(df, ("x", "y"))
    scored = matching.predicted(matching.score(df, model))
    assert scored.filter("predicted = label").count() > 380
    save_model(model, str(tmp_path / "m"))
    again = matching.score(df, load_model(str(tmp_path / "m")))
    assert again.select(F.sum("probability")).first()[0] == pytest.approx(scored.select(F.sum("probability")).first()[0])
