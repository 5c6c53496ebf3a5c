from pyspark.sql import functions as F

from kinforge.operators import blocking, evaluate

E = "entity_id string, business_name string, business_address string, country string"
S1 = ("S1-1", "Oak Ferrywright Pty Ltd", "Flat No. 418, Lindenhall, Colony, Marrow Gate, Tarnbeck, Eastmoor", "Norland")
S3 = ("S3-1", "*oakferrywright", "House 418, Lindenhall, Colony, Marrow Gate, Tarnbeck, EM", "NORLAND ")


def keys(spark, row):
    got = blocking.keys(blocking.normalised(spark.createDataFrame([row], E))).collect()
    return {p: {r.key for r in got if r["pass"] == i} for i, p in enumerate(blocking.PASSES)}


def test_worked_example(spark):
    """The prefix takes the blank after a short first word, generic address words give no b5 keys, and b4 takes any long address word."""
    k = keys(spark, S1)
    assert k["b1"] == {"oak ferrywright___norland"}
    assert k["b2"] == {"tok_oak___norland", "tok_ferrywright___norland"}
    assert k["b3"] == {"pref_oak ___norland"}
    assert k["b4"] == {f"na_{n}___{a}" for n in ("oak", "ferrywright") for a in ("flat", "lindenhall", "colony")}
    assert k["b5a"] == {f"b5_num_418_{t}___norland" for t in ("lindenhall", "marrow", "gate")}
    assert k["b5b"] == {f"b5_pair_{x}_{y}___norland" for x, y in (("lindenhall", "marrow"), ("gate", "lindenhall"), ("lindenhall", "tarnbeck"), ("gate", "marrow"), ("marrow", "tarnbeck"), ("gate", "tarnbeck"))}


def test_address_passes_alone_link_the_pair(spark):
    normal = blocking.normalised(spark.createDataFrame([S1, S3], E))
    pairs = blocking.candidates(normal.filter("entity_id = 'S1-1'"), normal.filter("entity_id = 'S3-1'"))
    assert [r.pass_mask for r in pairs.collect()] == [0b110000]
    assert blocking.in_stage(pairs, "b1_b4").count() == 0 and blocking.in_stage(pairs, "b5_a").count() == 1 and blocking.in_stage(pairs, "all").count() == 1


def test_blank_fields_give_no_keys(spark):
    assert not any(keys(spark, ("S1-2", None, "", None)).values())
    assert blocking.keys(blocking.normalised(spark.createDataFrame([], E))).count() == 0


def test_pruning_is_by_source_and_spares_other_passes(spark):
    rows = [(f"S2-{i}", "Alpha Beta", "", "x") for i in range(4)] + [("S3-1", "Alpha Beta", "", "x")]
    postings = blocking.keys(blocking.normalised(spark.createDataFrame(rows, E)))
    config = blocking.Config(b2_most=3)
    gone = {(r.source, r.key, r.n) for r in blocking.pruned_keys(postings, config).collect()}
    assert gone == {("S2", "tok_alpha___x", 4), ("S2", "tok_beta___x", 4)}
    left = blocking.prune(postings, config)
    assert left.filter("source = 'S2' and pass = 1").count() == 0 and left.filter("source = 'S3' and pass = 1").count() == 2 and left.filter("pass = 0").count() == 5


def test_aliases():
    config = blocking.Config(passes=("exact_name_country", "b5_a", "b5b_distinctive_pair_country"))
    assert config.enabled() == {"b1", "b5a", "b5b"}


def test_recall_grows_with_stages(spark, data):
    from kinforge.catalog import Tables

    t = Tables(spark, data)
    got = {r.stage: r for r in evaluate.recall_by_stage(t.pairs, t.links, t.ids).collect()}
    order = ["b1", "b1_b2", "b1_b3", "b1_b4", "b1_b5a", "all"]
    found = [got[s].found_all for s in order]
    assert found == sorted(found) and all(got[s].true_all == t.links.count() for s in order)
    assert t.pairs.select(F.countDistinct("s1_id", "cand_id") == F.count("*")).first()[0]


def test_hot_keys_are_dealt_out(spark, data, monkeypatch):
    from kinforge.catalog import Tables

    t = Tables(spark, data)
    want = t.pairs
    monkeypatch.setattr(blocking, "HOT", 3)
    large = blocking.large_keys(blocking.keys(t.targets))
    assert large.filter("not gone").count() > 0 and large.filter("not gone and n <= 3").count() == 0
    got = t.pairs
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pairs_are_made_once_and_not_grouped(spark, monkeypatch):
    """Against sets of keys compared by hand: with ids that repeat, pruned and hot keys, and codes that two keys have at first."""
    words = ["oak", "elm", "fir", "yew", "ash"]
    rows = [(f"S{1 + i % 3}-{i // 6}", f"{words[i % 5]} {words[i * i % 4]}", f"{i % 4} Quay Street Lowmoor {words[i % 3]}hill", "xy"[i % 2]) for i in range(60)]
    normal = blocking.normalised(spark.createDataFrame(rows, E))
    s1, targets = normal.filter("entity_id like 'S1-%'"), normal.filter("entity_id not like 'S1-%'")
    monkeypatch.setattr(blocking, "MEETINGS", 2)
    coded = blocking.coded
    monkeypatch.setattr(blocking, "coded", lambda k, seed: coded(k, seed) if seed else coded(k, 0).withColumn("codes", F.expr("transform(codes, c -> c & 15)")))
    for passes in (blocking.PASSES, ("b3",), ("b4",)):
        config = blocking.Config(passes=passes, b2_most=9, b5_most=4)
        kept, asked = {}, {}
        for r in blocking.prune(blocking.keys(targets, config), config).collect():
            kept.setdefault((r["pass"], r.key), set()).add((r.entity_id, r.source))
        for r in blocking.keys(s1, config).collect():
            asked.setdefault((r["pass"], r.key), set()).add(r.entity_id)
        want = {}
        for k in kept.keys() & asked.keys():
            for a in asked[k]:
                for b in kept[k]:
                    want[(a, *b)] = want.get((a, *b), 0) | 1 << k[0]
        pairs = blocking.candidates(s1, targets, config)
        assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]
        got = pairs.collect()
        assert len(want) > 20 and len(got) == len(want) and {(r.s1_id, r.cand_id, r.source): r.pass_mask for r in got} == want, passes
