"""Exact self-join of documents on the Jaccard similarity of their word shingles, and its connected components.

A document's set holds the hashes of its distinct shingles. Documents with the same set form one class; the join is
between classes, so copies are never paired.

Blocks. In one global order of all shingles, two sets of at least the wanted similarity share one of their first
n - ceil(share * n) + 1 shingles. The order puts shingles of long words first, as they are rarer, and a bounded list of
frequent shingles last: that keeps common words, and passages that many documents share, out of the blocks. Any order
gives the same links. Blocks are counted and told apart by partial sums, so that no task sees a whole one; those of more
than CHUNK members are dealt by hash into chunks before anything else.

Count vectors. Each set is also a point: how many of its shingles fall in each of GROUPS hash groups. The overlap of two
sets is at most the sum of the coordinate-wise minima of their points, and so is that of a set with anything inside a
box at the box's upper corner. Blocks index their points in an R-tree and search it with this bound and the sizes.

Blocks with the same members count once.

Links. A first search gives each member its smallest and its most similar possible partner in its block, or chunk; those
pairs are verified on the whole sets and connected. Where there are large blocks, one member of each component is searched in
them likewise, so that chunks of one group of copies come together without being paired. The last search goes over the
blocks that still hold more than one component, large ones as pairs of chunks, and gives every pair across components
that the bound lets through; these are verified too. Pairs left unverified thus either fail the bound or lie
in one component already, so components are exact and large groups of near copies aren't expanded into pairs.

Null and empty texts have no shingles and link with nothing; long texts are shingled whole. Ids may be null or repeat:
repeated rows and rows with the same set are one class, and a component is named after its smallest id, or null if it
has none. An empty table has no rows. Other columns are ignored, and returned by ``drop_near_copies``, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.components import connected
from kinforge.llm.kneser import in_bulk
from kinforge.llm.runtime import batch, grouped, map_batches, settle, small, texts, unused, without

GROUPS, LEAF, CHUNK = 256, 32, 4096
#: Frequent shingles: entries of the list, of a partition's share of it, and the least count there.
FREQUENT, SUMMARY, LEAST = 100_000, 20_000, 4
WORDS_CACHE = 200_000
LOW_BYTES, LANE = np.uint64(0x00FF00FF00FF00FF), np.uint64(0xFFFF)
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; shingles of longer words, which are rarer, have lower hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > WORDS_CACHE:
                known.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(found, dtype=np.uint64)
        k = min(self.words, len(words))
        mixed = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : i + len(mixed)]) * MULTIPLY[0]
            mixed ^= mixed >> np.uint64(29)
        mixed = mixed * MULTIPLY[1]
        mixed ^= mixed >> np.uint64(32)
        along = np.cumsum([0, *map(len, words)])
        half = (along[k:] - along[:-k]) * 2 // k
        kind = (15 - np.clip(half - 6, 0, 15)).astype(np.uint64)
        return np.unique((mixed >> np.uint64(4)) | (kind << np.uint64(60)))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def frequent_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """At most FREQUENT of the most frequent shingles, by the documents that hold them; from bounded summaries of all partitions."""

    def summarise(batches):
        shingler = Shingler(words)
        kept, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for b in batches:
            for some in in_bulk((t,) for t in texts(b.column(0))):
                each, n = np.unique(np.concatenate([shingler.hashes(t) for (t,) in some]), return_counts=True)
                both, at = np.unique(np.concatenate([kept, each]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
                if len(both) > 40 * SUMMARY:
                    largest = np.argpartition(-total, 20 * SUMMARY)[: 20 * SUMMARY]
                    both, total = both[np.sort(largest)], total[np.sort(largest)]
                kept, counts = both, total
        top = np.flatnonzero(counts >= LEAST)
        top = top[np.argsort(-counts[top], kind="stable")][:SUMMARY]
        yield batch({"h": (pa.array(signed(kept[top])), pa.int64()), "n": (pa.array(counts[top]), pa.int64())})

    found = map_batches(docs.select(text_col), summarise, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def prefix_length(n, share: tuple[int, int]):
    """How many of a set's n shingles, from the front of the order, one of which any similar set shares."""
    num, den = share
    return n - (num * n + den - 1) // den + 1


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, share: tuple[int, int], last: np.ndarray) -> DataFrame:
    """Per row: id, hash (of the text), n, s1 and s2 (the set's signature), keys (its front) and point (its count vector)."""
    kind, told = dict(docs.dtypes)[id_col], F.xxhash64(text_col).alias("hash")
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def each(batches):
        shingler, last = Shingler(words), shared.value
        for b in batches:
            n, s1, s2, keys, points = [], [], [], [], []
            for text in texts(b.column(1)):
                h = shingler.hashes(text)
                n.append(len(h))
                data = h.tobytes()
                s1.append(xxhash.xxh3_64_intdigest(data, 1) - (1 << 63))
                s2.append(xxhash.xxh3_64_intdigest(data, 2) - (1 << 63))
                if len(h) and len(last):
                    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                    front = np.concatenate([h[~late], h[late]])[: prefix_length(len(h), share)]
                else:
                    front = h[: prefix_length(len(h), share)] if len(h) else h
                keys.append(signed(front))
                counts = np.bincount((h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                points.append(counts.astype("u1" if counts.max() < 256 else "<u4").tobytes())
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
            ends = np.cumsum([0, *map(len, keys)])
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield batch({"id": (b.column(0), b.column(0).type), "hash": (b.column(2), pa.int64()), "n": (n, pa.int64()), "s1": (s1, pa.int64()), "s2": (s2, pa.int64()), "keys": (arrays, pa.list_(pa.int64())), "point": (points, pa.binary())})

    return map_batches(docs.select(id_col, text_col, told), each, f"id {kind}, hash long, n long, s1 long, s2 long, keys array<long>, point binary")


def unpacked(points: list[bytes]) -> np.ndarray:
    """Count vectors, a row each; a vector takes one byte a group if all its counts do."""
    if all(len(x) == GROUPS for x in points):
        return np.frombuffer(b"".join(points), dtype="u1").reshape(-1, GROUPS)
    return np.stack([np.frombuffer(x, dtype="u1" if len(x) == GROUPS else "<u4").astype("<u4") for x in points])


def overlaps(tops: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Sums of the coordinate-wise minima of each row and the point: bounds on shared shingles.

    Rows of bytes are added eight at a time within 64-bit words: pairs of bytes first, so that no sum overflows its 16 bits.
    """
    least = np.minimum(tops, point)
    if least.dtype != np.uint8:
        return least.sum(axis=1, dtype=np.int64)
    words = least.view(np.uint64)
    lanes = ((words & LOW_BYTES) + ((words >> np.uint64(8)) & LOW_BYTES)).sum(axis=1)
    return ((lanes & LANE) + ((lanes >> np.uint64(16)) & LANE) + ((lanes >> np.uint64(32)) & LANE) + (lanes >> np.uint64(48))).astype(np.int64)


class CountTree:
    """R-tree over count vectors, packed by size; a search bounds overlaps by sums of coordinate minima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, share: tuple[int, int]):
        self.num, self.den = share
        self.points, self.sizes = points, sizes
        order = np.lexsort((points[:, 0], sizes))
        self.order = order
        level = (points[order], sizes[order], sizes[order])
        self.levels = [level]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            starts = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The members that may be similar enough, by place in the input, and the bounds on what they share."""
        num, den = self.num, self.den
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[(high[at] * den >= num * size) & (low[at] * num <= den * size)]
            smallest = np.maximum(low[at], -(-num * size // den))
            overlap = overlaps(top[at], point)
            fits = overlap * (num + den) >= num * (size + smallest)
            at, overlap = at[fits], overlap[fits]
            if depth:
                below = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = below[below < len(self.levels[depth - 1][0])]
        return self.order[at], overlap


def block_pairs(c, sizes, points, chunk, label, share, first_only):
    """(lower, higher) ids: a block's possible pairs across labels; if first_only, of each member only those with its smallest and its most similar partner."""
    m = len(c)
    tree = CountTree(points, sizes, share) if m > LEAF else None
    num, den = share
    for i in range(m):
        if tree is not None:
            found, shared = tree.search(points[i], sizes[i])
        else:
            shared = overlaps(points, points[i])
            found = np.flatnonzero(shared * (num + den) >= num * (sizes + sizes[i]))
            shared = shared[found]
        usable = (found != i) & (label[found] != label[i])
        if chunk is not None:
            usable &= chunk[found] != chunk[i]
        found, shared = found[usable], shared[usable]
        if not len(found):
            continue
        others, own = c[found], int(c[i])
        if first_only:
            likest = np.argmax(shared / (sizes[found] + sizes[i]))
            others = np.unique([others.min(), others[likest]])
        else:
            others = others[others > own]
        for other in others.tolist():
            yield (min(own, other), max(own, other))


def search_blocks(members: DataFrame, share: tuple[int, int], first_only: bool) -> DataFrame:
    """a, b: possible pairs within blocks (key, part, chunk, c, n, label, point); part is lower and higher chunk in one number."""

    def each(batches):
        pairs: set = set()
        for held, bounds in grouped(batches, ("key", "part")):
            c, n, label, chunk = (held.column(x).to_numpy() for x in ("c", "n", "label", "chunk"))
            points = unpacked(held.column("point").to_pylist())
            for start, end in bounds:
                s = slice(start, end)
                own = label[s]
                if end - start < 2 or (own == own[0]).all():
                    continue
                across = chunk[s] if chunk[s].min() != chunk[s].max() else None
                for pair in block_pairs(c[s], n[s], points[s], across, own, share, first_only):
                    pairs.add(pair)
                    if len(pairs) > 200_000:
                        yield told(pairs)
                        pairs = set()
        yield told(pairs)

    def told(pairs):
        rows = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        return batch({"a": (pa.array(rows[:, 0]), pa.int64()), "b": (pa.array(rows[:, 1]), pa.int64())})

    dealt = members.repartition("key", "part").sortWithinPartitions("key", "part", "c")
    return map_batches(dealt, each, "a long, b long").distinct()


def many_chunks(counts: DataFrame) -> DataFrame:
    """key, chunks: the blocks (key, many) that are too large for a task, which are few: each has more than CHUNK postings."""
    return settle(counts.filter(F.col("many") > CHUNK).select("key", F.ceil(F.col("many") / CHUNK).cast("long").alias("chunks")))


def chunked(members: DataFrame, hot: DataFrame) -> DataFrame:
    """Members of blocks (key, c) with chunk, chunks (null for a block that isn't hot)."""
    return members.join(small(hot), "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("c", F.lit(7)), F.col("chunks")), F.lit(0).cast("long")))


def in_blocks(members: DataFrame, blocks: DataFrame, hot: DataFrame) -> DataFrame:
    """Chunked members of some blocks (key); a hot block's members meet it in as many places as it has chunks."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    places = blocks.join(small(hot), "key", "left").select("key", F.explode(F.sequence(zero, F.coalesce("chunks", one) - one)).alias("chunk"))
    return members.join(places, ["key", "chunk"], "left_semi")


def each_chunk(members: DataFrame) -> DataFrame:
    """Chunked members, with every chunk for itself; within it no member is apart."""
    return members.withColumn("part", F.col("chunk")).withColumn("chunk", F.lit(0).cast("long"))


def chunk_pairs(members: DataFrame) -> DataFrame:
    """Chunked members, with a member going to each pair of chunks that its own is part of."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("chunks") - one)))
    return members.withColumn("other", other).withColumn("part", F.least("chunk", "other") * (1 << 31) + F.greatest("chunk", "other")).drop("other")


def verified(pairs: DataFrame, told: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs whose whole sets are similar enough, made anew from the texts (c, text)."""
    num, den = share
    of = lambda x: told.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")

    def each(batches):
        shingler, known = Shingler(words), (None, None)
        for t in batches:
            keep = []
            for i, a in enumerate(t.column(0).to_pylist()):
                if known[0] != a:
                    known = a, shingler.hashes(t.column(2)[i].as_py() or "")
                one, other = known[1], shingler.hashes(t.column(3)[i].as_py() or "")
                both = len(np.intersect1d(one, other, assume_unique=True))
                if both * den >= num * (len(one) + len(other) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield batch({"a": (t.column(0).take(at), pa.int64()), "b": (t.column(1).take(at), pa.int64())})

    return map_batches(joined, each, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """Per row: id_col, n_shingles, component_id and text_hash, linking sets whose Jaccard similarity is at least share[0] / share[1]."""
    return rooted_components(docs, id_col, text_col, words, share).drop("root")


def rooted_components(docs: DataFrame, id_col: str, text_col: str, words: int, share: tuple[int, int]) -> DataFrame:
    """jaccard_components and root, which tells components apart that have the same smallest id; null without words."""
    last = frequent_shingles(docs, text_col, words)
    rows = settle(sets(docs, id_col, text_col, words, share, last)).withColumn("row", F.monotonically_increasing_id())
    classes = settle(rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("c"), F.min("id").alias("least_id")))
    heads = rows.join(classes.select(F.col("c").alias("row")), "row", "left_semi")
    points = heads.select(F.col("row").alias("c"), "n", "point")
    postings = heads.select(F.explode("keys").alias("key"), F.col("row").alias("c"))
    members = [F.bit_xor(F.xxhash64("c", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    blocks = settle(postings.groupBy("key").agg(F.count("*").alias("many"), *members).filter("many > 1"))
    hot = many_chunks(blocks)
    # Blocks with the same members give the same pairs: one of them stays.
    blocks = blocks.groupBy("many", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    postings = settle(in_blocks(chunked(postings, hot), blocks, hot))
    with_points = lambda members: members.join(points, "c")
    first = settle(search_blocks(with_points(each_chunk(postings)).withColumn("label", F.col("c")), share, True))
    needed, told, links = known_pairs(docs, classes, first, None, id_col, text_col, words, share)
    labels = connected(links)
    root_of = lambda members, labels: members.join(labels.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("label", F.coalesce("root", "c")).drop("root")
    if not hot.isEmpty():
        placed = root_of(postings.filter("chunks is not null").select("key", "c"), labels)
        heads_ = settle(placed.groupBy("key", "label").agg(F.min("c").alias("c")))
        dealt = each_chunk(chunked(heads_, many_chunks(heads_.groupBy("key").agg(F.count("*").alias("many")))))
        second = settle(search_blocks(with_points(dealt), share, True).join(first, ["a", "b"], "left_anti"))
        needed, told, more = known_pairs(docs, classes, second, (needed, told), id_col, text_col, words, share)
        first, links = first.union(second), links.union(more)
        labels = connected(links)

    # Every pair with a link has two members that the first search gave a possible partner, or that a chunk kept apart.
    placed = root_of(postings.select("key", "c", "chunks"), labels)
    placed = placed.filter("chunks is not null").unionByName(placed.filter("chunks is null").join(needed, "c", "left_semi")).drop("chunks")
    left = settle(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")))
    hot = many_chunks(left)
    open_ = in_blocks(chunked(placed, hot), left.filter("lo <> hi").select("key"), hot)
    rest = settle(search_blocks(with_points(chunk_pairs(open_)), share, False).join(first, ["a", "b"], "left_anti"))
    _, _, more = known_pairs(docs, classes, rest, (needed, told), id_col, text_col, words, share)
    if not more.isEmpty():
        labels = connected(links.union(more))

    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = settle(named.join(names, "root").select("s1", "s2", "n", "root", "component_id"))
    out = rows.select("id", "hash", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("hash").alias("text_hash"), "root")


def known_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, known: tuple[DataFrame, DataFrame] | None, id_col: str, text_col: str, words: int, share: tuple[int, int]):
    """(needed, told, links): the classes of all pairs so far, a text of each, and the settled pairs that are similar enough; known are the first two of earlier pairs."""
    if known and pairs.isEmpty():
        return *known, pairs
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    fresh = settle(ends.join(known[0], "c", "left_anti") if known else ends)
    wanted = settle(classes.join(fresh, "c").select("c", "s1", F.col("least_id").alias("wanted_id")))
    texts_ = texts_of(docs, wanted, id_col, text_col, words)
    needed, told = (known[0].union(fresh), known[1].union(settle(texts_))) if known else (fresh, settle(texts_))
    return needed, told, settle(verified(pairs, told, words, share))


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """c, text: a text of each wanted class, from a row that has its smallest id and its signature.

    Classes without an id are told by their signature alone, which the rows without an id are asked for.
    """
    texts_ = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    asked = texts_.join(small(wanted.filter("wanted_id is not null")), F.col("_id") == F.col("wanted_id")).select("c", "s1", "_text")

    def signature(shingler, text):
        return xxhash.xxh3_64_intdigest(shingler.hashes(text).tobytes(), 1) - (1 << 63)

    def each(batches):
        shingler = Shingler(words)
        for b in batches:
            keep = [i for i, (s1, text) in enumerate(zip(b.column(1).to_pylist(), texts(b.column(2)), strict=True)) if signature(shingler, text) == s1]
            at = pa.array(keep, pa.int64())
            yield batch({"c": (b.column(0).take(at), pa.int64()), "text": (b.column(2).take(at), pa.string())})

    def sign(batches):
        shingler = Shingler(words)
        for b in batches:
            yield batch({"s1": ([signature(shingler, t) for t in texts(b.column(0))], pa.int64()), "_text": (b.column(0), pa.string())})

    found = map_batches(asked, each, "c long, text string")
    nameless = wanted.filter("wanted_id is null").select("c", "s1")
    if not nameless.isEmpty():
        signed_ = map_batches(texts_.filter("_id is null").select("_text"), sign, "s1 long, _text string")
        found = found.union(signed_.join(small(nameless), "s1").select("c", "_text"))
    return found.dropDuplicates(["c"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one row with the smallest id. Rows without an id or without words stay."""
    keys = unused(docs, "kinforge_id", "kinforge_hash")
    found = settle(rooted_components(docs, id_col, text_col, words, share).filter((F.col("n_shingles") > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias(keys[0]), F.col("text_hash").alias(keys[1]), "component_id", "root"))
    heads = found.filter(F.col(keys[0]) == F.col("component_id"))
    chosen = settle(heads.groupBy("root").agg(F.min(keys[1]).alias("first"), F.count("*").alias("rows")).filter("rows > 1"))
    others = heads.join(chosen, "root").filter(F.col(keys[1]) != F.col("first"))
    leave = settle(found.filter(F.col(keys[0]) != F.col("component_id")).select(*keys).union(others.select(*keys)).distinct())
    repeats = settle(heads.join(chosen, "root").filter(F.col(keys[1]) == F.col("first")).select(*keys).distinct())
    marked = docs.withColumns({keys[0]: F.col(id_col), keys[1]: F.xxhash64(text_col)})
    return without(marked, leave, repeats, keys).drop(*keys)
