"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors, and exact recomputation.

Codes. A unit vector is turned by ROTATIONS random rotations and keeps the signs, one bit a dimension, and for each
rotation the factor <turned, signs> / sqrt(dim). For another vector q, <turned q, signs> / (sqrt(dim) * factor) is an
unbiased estimate of the inner product whose error is known from the factor; q itself goes along rounded to eight bits
a dimension, whose error is bounded and added. A pair goes on to exact recomputation unless the estimate plus SIGMAS
errors stays below the threshold. Whole vectors are only fetched for the pairs that are left.

Candidates. Bucket keys are signs under random rotations of their own, each used for one bit of one table. Bits grow with
the logarithm of the rows, which keeps buckets at about 2 ** SPREAD unrelated vectors, and tables grow so that a pair right
at the threshold shares a bucket with probability 1 - exp(-TRIES) (0.95), or nearly, at any size; closer pairs do nearly
always. Nothing is fitted, every row is indexed. Keys with more than CHUNK members are found by partial counts and dealt
out by hash before anything meets.

Caps. A row within half the threshold's angle of a leader may join the leader's cap; members of one cap are all linked with
each other, which settles large groups of near copies without their pairs. Caps needn't be found to be complete: a few
tables are searched, chunks of a hot bucket each for itself, and the leaders again until no bucket is hot. Work on a
group of near copies so grows with its size. From there on a cap is its leader, with the radius that its members lie in,
and a bucket holds it once. The leaders' angle and the radii tell most pairs of caps apart as all or none; what is left is
decided for a member against a cap, and then for two members, by exact cosines. Angles come from the length of the
difference, which is exact for near vectors, and within SLACK of an edge nothing is decided by them.

Vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing, as do vectors of different
lengths; long vectors are compared whole. Ids may be null or repeat: every row counts as a vector of its own, equal rows
are linked; a component is named after its smallest id. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.components import connected
from kinforge.llm.runtime import batch, grouped, map_batches, settle, small

ROTATIONS, SIGMAS, TRIES, SPREAD, SEED = 2, 4.0, 3.0, 7, 7
#: Members of a bucket that are compared in one task; rows of a product that are estimated at once.
CHUNK, BLOCK = 4096, 1024
#: Tables that caps are looked for in, and how often leaders are searched again at most.
CAP_TABLES, CAP_ROUNDS = 4, 8
SLACK = 1e-7
CODED = ["x8", "scale", "code", "factors"]


def rotations(dim: int, seed: int = SEED) -> np.ndarray:
    """dim x (ROTATIONS * dim): random orthogonal matrices side by side."""
    rng = np.random.default_rng((seed, dim))
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(ROTATIONS)], axis=1)


def key_rotations(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """dim x (bits * tables): a direction for each bit of each table, from as many random orthogonal matrices as that takes.

    All tables' first bits come first, then their second ones, and so on: signs under one matrix differ more evenly than
    by chance, which would make a table whose bits all came from it agree less often.
    """
    rng = np.random.default_rng((seed, dim, bits))
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits * tables // dim))], axis=1)[:, : bits * tables]


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables)."""
    bits = min(max(1, round(math.log2(max(rows, 2))) - SPREAD), 48)
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(TRIES / agree**bits)


def unit_vectors(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the lists that can link, for each length."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    start = np.cumsum(size) - size
    found = []
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = flat[start[at][:, None] + np.arange(dim)]
        most = np.abs(x).max(axis=1)
        fine = np.isfinite(most) & (most > 0)  # NaN and infinity show in the maximum
        at, x = at[fine], x[fine] / most[fine][:, None]
        found.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return [(at, x) for at, x in found if len(at)]


def encoded(vectors: DataFrame, id_col: str, vector_col: str, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """Per row: id, x (unit vector, 64-bit), x8 and scale (rounded), code, factors and keys (one a table); all null, and no keys, where nothing can link."""
    kind = dict(vectors.dtypes)[id_col]

    def each(batches):
        drawn: dict[int, tuple] = {}
        for b in batches:
            out = {n: [None] * len(b) for n in ("x", *CODED)}
            keys = np.zeros((len(b), tables), dtype=np.int64)
            usable = np.zeros(len(b), dtype=bool)
            for at, x in unit_vectors(b.column(1)):
                dim = x.shape[1]
                if dim not in drawn:
                    drawn[dim] = rotations(dim, seed), key_rotations(dim, bits, tables, seed)
                turn, own = drawn[dim]
                turned = x @ turn
                scale = np.abs(x).max(axis=1).astype(np.float32) / np.float32(127)
                x8 = np.rint(x / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
                code = np.packbits(turned >= 0, axis=1)
                factors = (np.abs(turned).reshape(len(x), ROTATIONS, dim).sum(axis=2) / math.sqrt(dim)).astype(np.float32)
                signs = (x @ own >= 0).reshape(len(x), bits, tables)
                keys[at] = np.tensordot(signs.astype(np.int64), 1 << np.arange(bits, dtype=np.int64), axes=([1], [0])) + (dim << 48)
                usable[at] = True
                for i, place in enumerate(at.tolist()):
                    out["x"][place], out["x8"][place], out["scale"][place] = x[i].tobytes(), x8[i].tobytes(), float(scale[i])
                    out["code"][place], out["factors"][place] = code[i].tobytes(), factors[i].tobytes()
            ends = np.concatenate([[0], np.cumsum(np.where(usable, tables, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[usable].ravel()))
            yield batch({"id": (b.column(0), b.column(0).type), **{n: (v, pa.float32() if n == "scale" else pa.binary()) for n, v in out.items()}, "keys": (lists, pa.list_(pa.int64()))})

    return map_batches(vectors.select(id_col, vector_col), each, f"id {kind}, x binary, x8 binary, scale float, code binary, factors binary, keys array<long>")


class Estimates:
    """Estimates of inner products between coded vectors of one length, and how far they may be off."""

    def __init__(self, x8: list[bytes], scale: np.ndarray, code: list[bytes], factors: list[bytes], turn: np.ndarray):
        n, dim = len(x8), len(turn)
        f = np.maximum(np.frombuffer(b"".join(factors), dtype=np.float32).reshape(n, ROTATIONS), 1e-6)
        x = np.frombuffer(b"".join(x8), dtype=np.int8).reshape(n, dim).astype(np.float32) * scale[:, None]
        signs = np.unpackbits(np.frombuffer(b"".join(code), dtype=np.uint8).reshape(n, -1), axis=1)[:, : ROTATIONS * dim]
        self.turned = x @ turn
        self.weighed = (signs.astype(np.float32) * 2 - 1) / np.repeat(f * (ROTATIONS * math.sqrt(dim)), dim, axis=1)
        spread = np.sqrt((np.maximum(1 - f * f, 0) / (f * f * max(dim - 1, 1))).sum(axis=1)) / ROTATIONS
        self.off = (SIGMAS * spread).astype(np.float32)
        self.rounding = scale * np.float32(math.sqrt(dim) / 2) * (1 / f).max() + np.float32(1e-4)

    def between(self, mine: slice, all_: slice) -> np.ndarray:
        return self.turned[mine] @ self.weighed[all_].T

    def most(self, mine: slice, all_: slice) -> np.ndarray:
        """The most that the inner products may be."""
        return self.between(mine, all_) + self.off[all_][None, :] + self.rounding[mine][:, None]


def bucket_pairs(est: Estimates, c: np.ndarray, chunk: np.ndarray, radius: np.ndarray, start: int, end: int, edge: float, leaders_only: bool):
    """(lower, higher) ids, as two arrays at a time, of a bucket's pairs that may be near; if leaders_only, of each member only the pair with its smallest near partner."""
    whole = slice(start, end)
    across = chunk[start] != chunk[start:end].max() or chunk[start] != chunk[start:end].min()
    for lo in range(start, end, BLOCK):
        mine = slice(lo, min(lo + BLOCK, end))
        if leaders_only:
            near = est.between(mine, whole) >= math.cos(edge / 2)
            near &= c[mine][:, None] > c[whole][None, :]
            i = np.flatnonzero(near.any(axis=1))
            j = np.argmax(near[i], axis=1)  # members are in order of c
        else:
            reach = radius[mine][:, None] + radius[whole][None, :]
            floor = math.cos(edge) if not reach.any() else np.cos(np.minimum(edge + reach, math.pi))
            fits = (est.most(mine, whole) >= floor) & (c[mine][:, None] != c[whole][None, :])
            if across:
                fits &= chunk[mine][:, None] != chunk[whole][None, :]
            i, j = np.nonzero(fits)
        if len(i):
            a, b = c[mine][i], c[whole][j]
            yield np.minimum(a, b), np.maximum(a, b)


def search_buckets(members: DataFrame, threshold: float, leaders_only: bool) -> DataFrame:
    """a, b: pairs of rows that may be near, from one bucket (key, part, chunk, c, radius and the codes)."""
    edge = math.acos(threshold)

    def each(batches):
        turns: dict[int, np.ndarray] = {}
        found: list[np.ndarray] = []
        for held, bounds in grouped(batches, ("key", "part")):
            last = bounds[-1][1]
            raw = {x: held.column(x).to_pylist()[:last] for x in ("x8", "code", "factors")}
            c, chunk, radius, scale = (held.column(x).to_numpy()[:last] for x in ("c", "chunk", "radius", "scale"))
            dim = np.array([len(x) for x in raw["x8"]])
            for d in np.unique(dim).tolist():
                if d not in turns:
                    turns[d] = rotations(d).astype(np.float32)
                at = np.flatnonzero(dim == d)
                est = Estimates([raw["x8"][i] for i in at], scale[at], [raw["code"][i] for i in at], [raw["factors"][i] for i in at], turns[d])
                for start, end in np.searchsorted(at, np.array(bounds)).tolist():
                    if end - start > 1:
                        for a, b in bucket_pairs(est, c[at], chunk[at], radius[at], start, end, edge, leaders_only):
                            found.append(np.stack([a, b], axis=1))
            if sum(map(len, found)) > 200_000:
                yield told(found)
                found = []
        yield told(found)

    def told(found):
        rows = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=0)
        return batch({"a": (pa.array(rows[:, 0]), pa.int64()), "b": (pa.array(rows[:, 1]), pa.int64())})

    return map_batches(members.repartition("key", "part").sortWithinPartitions("key", "part", "c"), each, "a long, b long").distinct()


def dealt(members: DataFrame, pairs: bool) -> tuple[DataFrame, bool]:
    """Members of buckets (key, c) with chunk and part, and whether any bucket is hot.

    A bucket of more than CHUNK members is dealt by hash into chunks, which are searched each for itself, or as pairs of chunks.
    """
    hot = settle(members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    zero = F.lit(0).cast("long")
    if hot.isEmpty():
        return members.withColumns({"chunk": zero, "part": zero}), False
    placed = members.join(small(hot), "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("c"), F.col("chunks")), zero))
    if not pairs:
        return placed.withColumn("part", F.col("chunk")).drop("chunks"), True
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("chunks") - F.lit(1).cast("long"))))
    placed = placed.withColumn("other", other).withColumn("part", F.least("chunk", "other") * (1 << 31) + F.greatest("chunk", "other"))
    return placed.drop("chunks", "other"), True


def cosines(pairs: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs' columns, cos, the exact cosine of rows a and b in double precision, and apart, their angle."""
    of = lambda x, to: rows.select(F.col("c").alias(x), F.col("x").alias(to))
    joined = pairs.join(of(b, "_xb"), b).join(of(a, "_xa"), a).select(*pairs.columns, "_xa", "_xb")
    names = list(pairs.columns)
    width = len(names)

    def each(batches):
        for t in batches:
            left, right = t.column(width).to_pylist(), t.column(width + 1).to_pylist()
            cos, apart = np.full(len(left), -2.0), np.full(len(left), math.pi)
            for size in {len(x) for x in left}:
                at = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if len(x) == size == len(y)]
                x = np.frombuffer(b"".join(left[i] for i in at), dtype=np.float64).reshape(len(at), -1)
                y = np.frombuffer(b"".join(right[i] for i in at), dtype=np.float64).reshape(len(at), -1)
                cos[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                apart[at] = 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=1) / 2, 1.0))
            yield pa.RecordBatch.from_arrays([*t.columns[:width], pa.array(cos), pa.array(apart)], names=[*names, "cos", "apart"])

    schema = ", ".join(f"{n} {k}" for n, k in pairs.dtypes) + ", cos double, apart double"
    return map_batches(joined, each, schema)


def table_keys(first: int | None = None) -> Column:
    """A row's bucket keys, of all tables or of the first ones, exploded."""
    keys = F.col("keys") if first is None else F.slice("keys", 1, first)
    return F.explode(F.transform(keys, lambda k, t: F.xxhash64(t, k)))


def with_caps(usable: DataFrame, threshold: float) -> DataFrame:
    """c, cap, angle: each row's leader, and a bound on its angle from it."""
    edge = math.acos(threshold)
    member = usable.select("c", F.col("c").alias("cap"), F.lit(0.0).alias("angle"))
    leaders = usable.withColumn("radius", F.lit(0.0))
    for _ in range(CAP_ROUNDS):
        entries, hot = dealt(leaders.select(table_keys(CAP_TABLES).alias("key"), "c", "radius", *CODED), False)
        pairs = cosines(search_buckets(entries, threshold, True), usable, "a", "b").join(leaders.select(F.col("c").alias("b"), "radius"), "b")
        near = settle(pairs.filter(F.col("apart") + F.col("radius") <= edge / 2 - SLACK).select("a", "b", "apart"))
        if near.isEmpty():
            break
        followers = near.select(F.col("b").alias("a")).distinct()
        led = near.join(followers, "a", "left_anti").groupBy(F.col("b").alias("cap")).agg(F.min(F.struct("a", "apart")).alias("m"))
        joined = member.join(led, "cap", "left")
        member = settle(joined.select("c", F.coalesce("m.a", "cap").alias("cap"), (F.col("angle") + F.coalesce("m.apart", F.lit(0.0))).alias("angle")))
        if not hot:
            break
        leaders = usable.join(member.groupBy(F.col("cap").alias("c")).agg(F.max("angle").alias("radius")), "c")
    return member


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Per row: id_col, n_links, component_id and kept."""
    bits, tables = plan(vectors.select(id_col).count(), threshold)
    rows = settle(encoded(vectors, id_col, vector_col, bits, tables)).withColumn("c", F.monotonically_increasing_id())
    usable = rows.filter("x is not null")
    edge = math.acos(threshold)
    member = with_caps(usable, threshold)
    caps = settle(member.groupBy("cap").agg(F.count("*").alias("n"), F.max("angle").alias("radius")))

    # Pairs of caps that share a bucket, by their leaders.
    large = small(settle(caps.filter("n > 1")))
    codes = rows.select(F.col("c").alias("cap"), *CODED)
    alone = usable.join(large.select("cap").join(member, "cap").select("c"), "c", "left_anti")
    alone = alone.select(table_keys().alias("key"), "c", F.lit(0.0).alias("radius"), *CODED)
    shared = usable.join(member, "c").join(large, "cap").select(table_keys().alias("key"), "cap").distinct()
    shared = shared.join(codes, "cap").join(large.select("cap", "radius"), "cap").select("key", F.col("cap").alias("c"), "radius", *CODED)
    entries, _ = dealt(alone.union(shared), True)
    between = search_buckets(entries, threshold, False)
    of = lambda x: caps.select(F.col("cap").alias(x), F.col("n").alias(f"n_{x}"), F.col("radius").alias(f"r_{x}"))
    told = cosines(between, usable, "a", "b").join(of("a"), "a").join(of("b"), "b")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    reach = F.col("r_a") + F.col("r_b")
    whole = F.when(single, F.col("cos") >= threshold).otherwise(F.col("apart") + reach <= edge - SLACK)
    none = F.when(single, F.col("cos") < threshold).otherwise(F.col("apart") - reach > edge + SLACK)
    told = settle(told.withColumns({"whole": whole, "none": none}).filter("not none").select("a", "b", "n_a", "n_b", "whole"))
    all_linked = told.filter("whole").select("a", "b", "n_a", "n_b")
    unclear = told.filter("not whole").select("a", "b")

    # A member against a cap, where two caps are neither all linked nor apart.
    one = unclear.join(member.select(F.col("cap").alias("a"), "c"), "a").select("c", F.col("a").alias("cap_a"), F.col("b").alias("to"))
    one = settle(cosines(one, usable, "c", "to").join(caps.select(F.col("cap").alias("to"), "n", "radius"), "to"))
    covers = F.col("apart") + F.col("radius") <= edge - SLACK
    misses = F.col("apart") - F.col("radius") > edge + SLACK
    covered = one.filter(covers).select("c", "cap_a", "to", "n")
    # Two members, where that is unclear too.
    two = one.filter(~covers & ~misses).select("c", "cap_a", "to").join(member.select(F.col("cap").alias("to"), F.col("c").alias("d")), "to")
    linked = settle(cosines(two.select("c", "d", "cap_a", "to"), usable, "c", "d").filter(F.col("cos") >= threshold).select("c", "d", "cap_a", "to"))

    by_cap = all_linked.select(F.col("a").alias("cap"), F.col("n_b").alias("k")).union(all_linked.select("b", "n_a")).union(covered.select("to", F.lit(1).cast("long"))).groupBy("cap").agg(F.sum("k").alias("by_cap"))
    by_row = covered.select("c", F.col("n").alias("k")).union(linked.select("c", F.lit(1).cast("long"))).union(linked.select("d", F.lit(1).cast("long"))).groupBy("c").agg(F.sum("k").alias("by_row"))
    edges = all_linked.select("a", "b").union(covered.select("cap_a", "to")).union(linked.select("cap_a", "to"))
    roots = connected(edges).withColumnRenamed("node", "cap")
    full = member.join(caps.select("cap", "n"), "cap").join(by_cap, "cap", "left").join(roots, "cap", "left").join(by_row, "c", "left")
    full = settle(full.select("c", F.coalesce("root", "cap").alias("root"), (F.col("n") - 1 + F.coalesce("by_cap", F.lit(0)) + F.coalesce("by_row", F.lit(0))).cast("long").alias("n_links")))
    out = settle(rows.select("id", "c").join(full, "c", "left"))
    names = out.filter("root is not null").groupBy("root").agg(F.min("id").alias("least_id"))
    out = out.join(names, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
