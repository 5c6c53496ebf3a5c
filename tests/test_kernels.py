"""Features over arrays of pairs against their expressions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge import catalog
from kinforge.operators import blocking, features, kernels


def entities(spark, long=False):
    rng = random.Random(11)
    words = ["oak", "ferry", "oakferry", "elm", "x", "yew 77", "elmo", "ferri"] + ["verylongwordofanamethatgoeson" * 3] * long
    name = lambda: rng.choice(["", "*", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))])
    place = lambda: rng.choice(["", f"{rng.randint(1, 9)}{rng.randint(1, 9)} {rng.choice(['Quay', 'Lowmoor', 'Q'])} {rng.choice(['Street 12', 'St', 'x7 hill'])}"])
    rows = [(f"S{1 + i % 3}-{i // (6 if long else 3)}", name(), place(), rng.choice(["x", "X ", "y", None])) for i in range(240)]
    return blocking.normalised(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))


@pytest.mark.parametrize("long", [False, True])
def test_features_of_arrays_are_those_of_expressions(spark, monkeypatch, long):
    monkeypatch.setattr(blocking, "MEETINGS", 200)  # groups in several parts
    normal = entities(spark, long).cache()
    config = blocking.Config(b2_most=60, b5_most=30)
    pairs = blocking.candidates(normal.filter("entity_id like 'S1-%'"), normal.filter("entity_id not like 'S1-%'"), config)
    want = features.pair_features(pairs, normal).select("s1_id", "cand_id", "source", *features.FEATURES)
    asked = F.col("entity_id").startswith("S1-")
    got = blocking.postings(normal, asked, features.FEATURES, config).listed()
    told = lambda df: sorted(df.collect())
    a, b = told(got), told(want)
    assert len(a) > 300 and a == b
    some = ("name_jaro_winkler", "country_match")
    assert told(blocking.postings(normal, asked, some, config).listed()) == told(want.select("s1_id", "cand_id", "source", *some))
    linked = normal.withColumn("links", F.when(asked, F.array(F.lit(a[0].cand_id), F.lit("S2-none"), F.lit(a[-1].cand_id))))
    met = blocking.postings(linked, asked, features.FEATURES, config, ("links",))
    label = F.col("cand_id").isin(a[0].cand_id, a[-1].cand_id).cast("int").alias("label")
    counted = want.select(label, *features.FEATURES).groupBy("label", *features.FEATURES).agg(F.count("*").alias("n"))
    assert told(met.counted()) == told(counted) and counted.filter("label = 1").count() > 0
    assert told(met.listed().select("s1_id", "cand_id", "label")) == told(want.select("s1_id", "cand_id", label))


@pytest.mark.parametrize("name", ["pair_features_full", "sim_jaccard3", "sim_jaro_winkler"])
def test_pairs_are_compared_as_arrays(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(f in plan.split("MapInArrow")[0] for f in ("array_intersect", "lambda"))


def test_groups_go_on_in_later_batches(monkeypatch):
    """Blocks of few rows and pairs of few at a time meet as one block does."""
    import pyarrow as pa

    rows = [(c, 0, asked, f"{'ST'[not asked]}{i}", "S2", [10 + i % 3, c], f"n{i}", "", "") for c in (1, 2, 3) for asked in (False, True) for i in range(7 * c)]
    table = pa.Table.from_pylist([dict(zip(("code", "salt", "asked", "entity_id", "source", "codes", "norm_name", "norm_address", "country"), r)) for r in rows])
    run = lambda size: sorted(p for b in kernels.listed(("name_levenshtein",), False)(iter(table.to_batches(size))) for p in zip(*[c.to_pylist() for c in b.columns]))
    want = run(1000)
    monkeypatch.setattr(kernels, "ROWS", 3)
    monkeypatch.setattr(kernels, "PAIRS", 5)
    assert len(want) > 50 and run(2) == want and run(5) == want


def test_tallies_add_up_equal_rows():
    x = np.array([[0.0, 1.0], [2.0, 1.0], [0.0, 1.0]])
    assert [c.tolist() for c in kernels.tallied(x, np.array([1.0, 2.0, 3.0]))][1] in ([4.0, 2.0], [2.0, 4.0])


def test_weighted_rows_fit_as_repeated_ones(spark):
    from kinforge.operators import matching

    rng = random.Random(2)
    rows = [(rng.randint(0, 3) / 3, 0.85, int(rng.random() < 0.4)) for _ in range(60)]
    plain = spark.createDataFrame(rows, "a double, b double, label int")
    each = matching.fit(plain, ("a", "b"))
    tally = matching.fit(plain.groupBy("a", "b", "label").agg(F.count("*").alias("n")), ("a", "b"))
    assert np.allclose(each.weights, tally.weights, atol=1e-9) and each.intercept == pytest.approx(tally.intercept, abs=1e-9) and each.scales[1] == tally.scales[1] == 1.0
