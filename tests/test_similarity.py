import random

import pytest
from pyspark.sql import functions as F

from kinforge.functions import similarity as sim


def jaro_winkler(a, b, p=0.1, most=4):
    """A plain version with its own bookkeeping."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if j not in used and b[j] == ch:
                used.add(j)
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [b[j] for j in sorted(used)]
    k, moved = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (k / len(a) + k / len(b) + (k - moved) / k) / 3
    prefix = 0
    for x, y in zip(a[:most], b[:most]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * p * (1 - jaro)


def test_jaro_winkler(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))
    pairs = [("martha", "marhta"), ("abcdef", "abzzzz"), ("", ""), ("a", ""), ("dwayne", "duane")] + [(word(), word()) for _ in range(600)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", sim.jaro_winkler(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        assert r.s == pytest.approx(jaro_winkler(a, b), abs=1e-12), (a, b)
    assert got[0].s == pytest.approx(0.9611111111) and got[1].s == pytest.approx(0.6444444444)


def test_edges(spark):
    df = spark.createDataFrame([("kitten", "sitting", ["12", "main"], ["12", "34"], [], ["main"], ["oak"])], "a string, b string, x array<string>, y array<string>, e array<string>, m array<string>, o array<string>")
    c = F.col
    r = df.select(
        sim.levenshtein(c("a"), c("b")).alias("lev"), sim.levenshtein_similarity(F.lit(""), F.lit("")).alias("l0"), sim.levenshtein_similarity(F.lit("a"), F.lit("")).alias("l1"),
        sim.char_grams(F.lit("ab")).alias("g2"), sim.char_grams(F.lit("abcd")).alias("g4"), sim.char_grams(F.lit("")).alias("g0"), sim.jaccard(c("e"), c("e")).alias("j0"), sim.jaccard(c("e"), c("m")).alias("j1"),
        sim.number_overlap(c("x"), c("y")).alias("n"), sim.number_overlap(c("m"), c("o")).alias("n0"), sim.dice(c("x"), c("y")).alias("d"), sim.overlap(c("x"), c("m")).alias("o"),
    ).first()
    assert (r.lev, r.l0, r.l1, r.g2, sorted(r.g4), r.g0) == (3, 1.0, 0.0, ["ab"], ["abc", "bcd"], [])
    assert (r.j0, r.j1, r.n, r.n0, r.d, r.o) == (1.0, 0.0, 1.0, 1.0, 0.5, 1.0)


def test_gram_codes_share_what_grams_share(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab_0 ") for _ in range(rng.randint(0, 9)))
    df = spark.createDataFrame([(word(), word()) for _ in range(400)], "a string, b string")
    grams = [sim.char_grams(F.col(c)) for c in "ab"]
    codes = [sim.gram_codes(g) for g in grams]
    assert df.filter(~sim.jaccard(*grams).eqNullSafe(sim.jaccard(*codes)) | (F.size(F.array_distinct(codes[0])) != F.size(grams[0]))).count() == 0


def joined(df):
    """What the optimised plan has above its topmost join, where each expression is computed once a pair."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[0]


def test_features_make_sets_once_an_entity(spark, data):
    from kinforge import catalog

    plan = joined(catalog.QUERIES["pair_features"](spark, data))
    assert "array_intersect" in plan and not any(f in plan for f in ("lambda", "RLIKE", "array_distinct"))
    assert plan.count("array_intersect") == 5  # once a set, however many features it has


def test_numbers_are_found_once_an_entity(spark, data):
    from kinforge import catalog

    assert not any(f in joined(catalog.QUERIES["sim_numeric"](spark, data)).split("shared#")[0] for f in ("RLIKE", "array_distinct"))
