"""Exact copies, near copies, vectors, components: against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.llm import components, exact, jaccard, vectors

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def named(ids, roots):
    """Each row's component by its smallest id, null if it has none."""
    best = {}
    for i, r in enumerate(roots):
        known = [x for x in (best.get(r), ids[i]) if x is not None]
        best[r] = min(known) if known else None
    return [best[r] for r in roots]


def low(rows):
    return sorted(rows, key=repr)


def test_exact_groups(odd, none, docs):
    for df in (odd, docs, docs.repartition(7).unionByName(docs.limit(20))):
        rows = df.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in rows:
            groups[BLANK.sub("", r.text or "")].append(r)
        want = []
        for plain, members in groups.items():
            order = sorted(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
            digest = hashlib.sha256(plain.encode()).hexdigest()
            want += [(r.doc_id, order[0].doc_id, len(members), i == 0, digest) for i, r in enumerate(order)]
        got = [tuple(r) for r in exact.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert low(got) == low(want)
        kept = exact.drop_copies(df)
        assert kept.columns == df.columns
        assert kept.count() == len(groups)
    assert exact.exact_groups(none).count() == 0 and exact.drop_copies(none).count() == 0


def shingles(text, k):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def family(spark, n=60, seed=5):
    """Near copies around both sides of the thresholds, short texts, shared passages, and repeated rows."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 30))
    rows = []
    for b in range(6):
        base = list(rng.choice(words, rng.integers(3, 150)))
        for _ in range(n // 6):
            text = list(base)
            for _ in range(rng.integers(0, 1 + max(1, len(base) // 18))):
                text[rng.integers(0, len(text))] = str(rng.choice(words))
            rows.append(" ".join(text) + (" " + passage if b % 2 else ""))
    rows += ["a", "A", "a b", "b a", "a b c", "a b c"]
    return spark.createDataFrame([(100 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("words, share", [(3, (9, 10)), (5, (4, 5))])
def test_jaccard(spark, odd, none, docs, words, share):
    for df in (odd, docs, family(spark), family(spark, 120, 9)):
        rows = df.select("doc_id", "text").collect()
        sets = [shingles(r.text, words) for r in rows]
        links = []
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(x & sets[j])
                if x and both * share[1] >= share[0] * (len(x) + len(sets[j]) - both):
                    links.append((j, i))
        roots = named([r.doc_id for r in rows], union(len(rows), links))
        want = [(r.doc_id, len(s), c if s else r.doc_id) for r, s, c in zip(rows, sets, roots)]
        got = [tuple(r) for r in jaccard.jaccard_components(df, words=words, share=share).drop("text_hash").collect()]
        assert low(got) == low(want)
    assert jaccard.jaccard_components(none, words=words, share=share).count() == 0


def test_one_of_each_near_group_stays(spark, odd, none):
    df = family(spark)
    whole = df.unionByName(df.limit(7))
    components_ = jaccard.jaccard_components(df, words=5, share=(4, 5)).select("component_id").distinct().count()
    kept = jaccard.drop_near_copies(whole)
    assert kept.columns == whole.columns and kept.count() == components_ == kept.select("doc_id").distinct().count()
    left = [(r.doc_id, r.text) for r in jaccard.drop_near_copies(odd).collect()]
    assert left.count((8, "Word ")) == 0 and (7, "word") in left and sum(i is None for i, _ in left) == 2
    assert jaccard.drop_near_copies(none).count() == 0


def test_hot_blocks_are_dealt_out_in_chunks(spark, monkeypatch):
    want = {r.doc_id: r.component_id for r in jaccard.jaccard_components(family(spark, 120, 9)).collect()}
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    monkeypatch.setattr(jaccard, "FREQUENT", 10)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(family(spark, 120, 9)).collect()} == want


def test_tree_loses_nothing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(5, 400, 900)
    points = np.stack([np.bincount(rng.integers(0, jaccard.GROUPS, n), minlength=jaccard.GROUPS) for n in sizes]).astype("<u4")
    points[1::3], sizes[1::3] = points[0::3], sizes[0::3]
    tree = jaccard.CountTree(points, sizes, (9, 10))
    for i in range(0, 900, 37):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = set(np.flatnonzero(bound * 19 >= 9 * (sizes + sizes[i])).tolist())
        found, shared = tree.search(points[i], sizes[i])
        assert set(found.tolist()) == want and shared.tolist() == bound[found].tolist()
        assert jaccard.overlaps(points.astype("u1"), points[i].astype("u1")).tolist() == bound.tolist()


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = rng.permutation(300).tolist()
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000, 2000)] + [(5000, 5001)] * 3
    got = {r.node: r.root for r in components.connected(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 for i in range(80)) and got[5001] == 5000 and 2000 not in got
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.9):
    ids, xs = [r.vec_id for r in rows], []
    for r in rows:
        v = r.embedding
        ok = v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.linalg.norm(v) > 0
        xs.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if ok else None)
    links = [(j, i) for i in range(len(xs)) for j in range(i) if xs[i] is not None and xs[j] is not None and len(xs[i]) == len(xs[j]) and xs[i] @ xs[j] >= threshold]
    n = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(xs)) if links else np.zeros(len(xs), dtype=int)
    return links, n, named(ids, union(len(xs), links))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((25, 32))
    tight = [b + rng.standard_normal((8, 32)) * s for b, s in zip(base, rng.uniform(0.02, 0.6, 25))]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(np.concatenate([*tight, rng.standard_normal((100, 32))]))]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [None] + [1.0] * 31), (904, []), (905, [1.0, 0.0]), (906, [2.0, 0.1]), (7, rows[7][1]), (None, rows[3][1]), (907, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("c", F.lit(1)).withColumn("key", F.lit("x"))
    links, n, names = brute_vectors(df.select("vec_id", "embedding").collect())
    got = low(tuple(r) for r in vectors.near_duplicates(df).collect())
    want = low((i, int(k), c, i == c if c is not None and i is not None else i == c) for (i, _), k, c in zip(rows, n, names))
    assert sum(r[1] for r in got) >= 0.9 * n.sum() and sum(r[1] for r in got) <= n.sum()
    same = sum(a == b for a, b in zip(got, want))
    assert same >= 0.9 * len(rows)
    told = {r[0]: r for r in got}
    for i in (900, 901, 902, 903, 904, 907):
        assert told[i][1:] == (0, i, True)
    assert told[905][1] == told[906][1] == 1 and told[906][2] == 905
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    big = rows.unionByName(rows.filter("vec_id % 3 = 0").select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(1.02).cast("float")).alias("embedding"), "label"))
    _, n, names = brute_vectors(big.collect())
    got = vectors.near_duplicates(big).collect()
    assert sum(r.n_links for r in got) >= 0.9 * n.sum() > 0
    assert low(r.component_id for r in got) == low(names)


def test_recall_at_the_edge_with_the_keys_of_a_large_table(spark):
    rng = np.random.default_rng(3)
    bits, tables = vectors.plan(1_000_000, 0.9)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, 0.9 * a + np.sqrt(1 - 0.81) * b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    keys = {r.id: np.array(r["keys"]) for r in vectors.encoded(df, "vec_id", "embedding", bits, tables).select("id", "keys").collect()}
    assert np.mean([(keys[i] == keys[i + 1500]).any() for i in range(1500)]) >= 0.9


def test_unrelated_rows_that_share_an_id_stay(spark):
    x, y = (" ".join(f"{w}{i}" for i in range(30)) for w in "xy")
    rows = [(5, x), (5, y), (6, x + " more"), (7, y), (5, x)]
    left = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left)) == [(5, x), (5, y)]


def test_runs_merge_in_as_many_rounds_as_places_have_bits(spark):
    assert [exact.rounds_for(n) for n in (0, 1, 2, 3, 8, 9, 211, 10**6)] == [0, 0, 1, 2, 3, 4, 8, 12]
    rows = [(i, "same text" if i % 3 else f"text {i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11, "doc_id")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = {i: (min(g, key=lambda x: (-len(t), x)), len(g), i == min(g)) for t, g in groups.items() for i in g}
    assert got == want
    run = spark.createDataFrame([(p, bytes([d]), d, 1, d, p) for p in range(8) for d in range(40)], "place int, digest binary, check long, size int, best int, n long")
    for r in range(3):
        run = exact.exchanged(run, r, 8)
        assert run.count() == 8 * 40 >> (r + 1)  # runs of pairs of places have met
        assert run.filter(f"(place & {(1 << r + 1) - 1}) != (check & {(1 << r + 1) - 1})").count() == 0
        parts = run.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("place").alias("n")).collect()
        assert all(x.n == 1 for x in parts)  # a place is a partition
    assert run.filter("place != check % 8").count() == 0


def test_links_at_the_edge_are_exact(spark):
    t = np.arccos(0.9) - 3e-9
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 1e-8, 0.0]), (3, [float(np.cos(t)), float(-np.sin(t)), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, n, _ = brute_vectors(df.collect())
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    assert all(got[i] <= int(k) for (i, _), k in zip(rows, n)) and got[1] >= 1 and n.tolist() == [2, 1, 1]


def test_hot_buckets_of_vectors(spark, monkeypatch):
    """Groups of near copies that are many times a chunk, with links across their edges."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((4, 24))
    parts = [c + rng.standard_normal((150, 24)) * s for c, s in zip(centre, (0.0, 0.01, 0.1, 0.3))]
    near = centre[1] + rng.standard_normal((40, 24)) * 0.42
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([*parts, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    ordered = sorted(df.collect(), key=lambda r: r.vec_id)
    links, n, names = brute_vectors(ordered)
    monkeypatch.setattr(vectors, "CHUNK", 20)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert sum(got[i].n_links for i, _ in rows) >= 0.9 * n.sum() and all(got[i].n_links <= n[i] for i, _ in rows)
    assert sum(got[i].component_id == c for (i, _), c in zip(rows, names)) >= 0.97 * len(rows)
    assert all(got[i].n_links >= 149 for i in range(300))
    usable = vectors.encoded(df, "vec_id", "embedding", *vectors.plan(len(rows), 0.9)).withColumn("c", F.col("id"))
    member = vectors.with_caps(usable, 0.9).collect()
    assert len({r.cap for r in member if r.c < 300}) <= 8  # of 300 rows, two groups
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    assert all(2 * np.arcsin(min(1.0, np.linalg.norm(x[r.c] - x[r.cap]) / 2)) <= r.angle + 1e-9 <= np.arccos(0.9) / 2 for r in member)


def test_estimates_hold(spark):
    """The most that an inner product may be, from codes, is hardly ever below what it is."""
    rng = np.random.default_rng(6)
    a = rng.standard_normal((300, 48))
    b = np.concatenate([a + rng.standard_normal((300, 48)) * rng.uniform(0.05, 2, (300, 1))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    rows = sorted(vectors.encoded(df, "vec_id", "embedding", 4, 2).collect(), key=lambda r: r.id)
    est = vectors.Estimates(*([bytes(r.x8) for r in rows], np.array([r.scale for r in rows], dtype=np.float32), [bytes(r.code) for r in rows], [bytes(r.factors) for r in rows]), vectors.rotations(48).astype(np.float32))
    x = np.stack([np.frombuffer(r.x, dtype=np.float64) for r in rows])
    real, whole = x @ x.T, slice(0, 600)
    assert np.mean(est.most(whole, whole) >= real) > 0.9995
    assert abs(float(np.mean(est.between(whole, whole) - real))) < 0.01
