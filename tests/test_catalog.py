"""Every query against its SQL in DuckDB, and the whole runs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    place = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def plain_fit(x, y):
    """The optimum of the penalised, balanced loss over standardised columns, by plain gradient steps along conjugate directions."""
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    a = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.array([0.0, *[1.0] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.lstsq((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), -(a.T @ (weight * (p - y)) + penalty * w), rcond=None)[0]
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return a @ w


def test_regression_is_fitted_on_one_split_and_judged_on_the_other(spark, data):
    t = catalog.Tables(spark, data)
    split = {r.s1_id: r.split for r in catalog.splits.split_ids(t.ids).collect()}
    pairs = catalog.blocking.labelled(t.pairs, t.links)
    rows = catalog.features.pair_features(pairs, t.normal).toPandas()
    names = list(catalog.features.FEATURES)
    train = rows[[split[i] == "train" for i in rows.s1_id]]
    model = catalog.matching.fit(spark.createDataFrame(train[[*names, "label"]]))
    x, y = train[names].to_numpy(), train["label"].to_numpy()
    mine = model.intercept + (x - np.array(model.means)) / np.array(model.scales) @ np.array(model.weights)
    assert np.abs(mine - plain_fit(x, y)).max() < 1e-3
    val = rows[[split[i] == "val" for i in rows.s1_id]]
    got = {(r.s1_id, r.cand_id): (r.label, r.probability) for r in catalog.QUERIES["lr_scores"](spark, data).collect()}
    assert set(got) == set(zip(val.s1_id, val.cand_id))
    m = catalog.QUERIES["lr_metrics"](spark, data).first()
    yes = [(label, p >= 0.5) for label, p in got.values()]
    assert (m.tp, m.fp, m.fn, m.tn) == tuple(yes.count(k) for k in ((1, True), (0, True), (1, False), (0, False)))
    assert m.f05 > 0.8  # of entities that the fit has not seen
    best = catalog.QUERIES["lr_best_threshold"](spark, data).first()
    sweep = catalog.QUERIES["lr_threshold_sweep"](spark, data).collect()
    assert best.s1_f05 >= max(r.s1_f05 for r in sweep) - 5e-5 and len(sweep) == 14
    true = [r for r in t.links.collect() if split[r.s1_id] == "val"]
    assert all(r.s1_tp + r.s1_fn == len(true) for r in sweep)


def test_regression_is_fitted_on_all_train_pairs(spark, data, monkeypatch):
    """Also with more negatives than a sample of the fit would hold."""
    t = catalog.Tables(spark, data)
    want = catalog.blocking.labelled(t.pairs, t.links).join(catalog.splits.split_ids(t.ids), "s1_id").filter("split = 'train'").groupBy("label").count()
    monkeypatch.setattr(catalog, "MOST_NEGATIVES", 10, raising=False)
    seen, fit = [], catalog.matching.fit
    monkeypatch.setattr(catalog.matching, "fit", lambda rows, **k: seen.append(rows) or fit(rows, **k))
    catalog.QUERIES["lr_best_threshold"](spark, data)
    total = F.sum("n") if "n" in seen[0].columns else F.count("*")
    assert len(seen) == 1 and sorted(seen[0].groupBy("label").agg(total).collect()) == sorted(want.collect())


def test_index_stats_with_default_limits(spark, data):
    t = catalog.Tables(spark, data)
    got = {r.source: r for r in catalog.QUERIES["index_stats_default"](spark, data).collect()}
    counts = {(r.source, r["pass"]): r.n for r in catalog.blocking.keys(t.targets).groupBy("source", "pass").agg({"key": "count"}).withColumnRenamed("count(key)", "n").collect()}
    assert set(got) == {"S2", "S3"}
    for source, r in got.items():
        assert r.b2_pruned_keys == r.b5a_pruned_keys == r.b5b_pruned_keys == 0  # no key of this table has 500 postings
        assert (r.b4_total_postings, r.b5a_total_postings, r.b5b_total_postings) == tuple(counts[source, p] for p in (3, 4, 5))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_runs(spark, data):
    from kinforge.operators import splits
    from kinforge.plans import runs

    t = catalog.Tables(spark, data)
    e = t.entities.drop("business").cache()
    links = t.links.cache()
    blocked = runs.blocking_run(e, links)
    assert blocked["index"].count() == 2 and blocked["recall"].count() == 11
    assert runs.profile_run(e, links)["profile"].first()["rows"] == e.count()
    split = splits.split_ids(t.ids, 0.5)
    report = runs.matching_run(e, links, split)
    assert report["sweep"].count() == 14 and report["cardinality"].count() == 3


def test_streaming_scores_new_records(spark, data, tmp_path):
    from kinforge.operators import blocking
    from kinforge.streaming.scoring import scorer

    t = catalog.Tables(spark, data)
    e = t.entities.drop("business")
    e.filter("entity_id like 'S1-%'").repartition(3).write.parquet(str(tmp_path / "in"))
    targets = blocking.normalised(e.filter("entity_id not like 'S1-%'")).cache()
    out = str(tmp_path / "out")
    each = scorer(targets, lambda df, n: df.write.mode("append").parquet(out))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out).filter("score > 0").select("s1_id", "cand_id", "score")
    want = catalog.QUERIES["rule_scores"](spark, data)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
