"""Blocking: keys of six passes, postings, document-frequency pruning, and candidate pairs by equi-joins on keys.

Keys are counted first; those that are pruned or hot are few, and reach the postings by broadcast, so that postings are
shuffled once, to meet the queries.

All passes go through one exploded postings table and one join; the passes that found a pair are bits of one mask, so
that every individual and cumulative stage is a filter on the pairs.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.functions.similarity import char_grams
from kinforge.operators import features, kernels
from kinforge.sources.entities import settled

ROOT = str(Path(__file__).resolve().parents[2])
# Pass names and the other names that configurations use for them.
PASSES = ("b1", "b2", "b3", "b4", "b5a", "b5b")
ALIASES = {
    "b1": "b1", "exact_name_country": "b1", "b2": "b2", "distinctive_token_country": "b2", "b3": "b3", "name_prefix_country": "b3",
    "b4": "b4", "name_token_address": "b4", "b5a": "b5a", "b5_a": "b5a", "address_number_locality": "b5a", "b5a_num_locality_country": "b5a",
    "b5b": "b5b", "b5_b": "b5b", "address_distinctive_pair": "b5b", "b5b_distinctive_pair_country": "b5b",
}
#: Cumulative stages, as masks over PASSES.
STAGES = {"b1": 1, "b1_b2": 3, "b1_b3": 7, "b1_b4": 15, "b1_b5a": 31, "all": 63}

# Address words that tell nothing.
GENERIC_ADDRESS = tuple(
    "road rd street st drive dr avenue ave lane ln unit floor fl suite ste apt apartment null box po no near opp opposite behind phase plot sector "
    "flat block house hno kh door nd th east west north south city nagar colony bhavan complex building tower plaza market bazaar center centre "
    "delhi mumbai india state dist district post extn extension".split()
)


#: Postings of a key and source that one task meets, and rows of a table that is broadcast.
HOT, BROADCAST_ROWS = 10_000, 2_000_000
#: Pairs that one task makes of a key's postings.
MEETINGS = 5_000_000
#: Pairs of a key beyond which counted() takes sets of keys in place of entities.
COMMON = 10_000


@dataclass(frozen=True)
class Config:
    passes: tuple[str, ...] = PASSES
    b2_most: int = 5000
    b5_most: int = 500
    b2_length: int = 3
    b3_length: int = 4
    b4_name_length: int = 2
    b4_address_length: int = 4
    b4_names: int = 2
    b4_addresses: int = 3
    b5a_numbers: int = 2
    b5a_words: int = 3
    b5b_words: int = 4
    generic: tuple[str, ...] = field(default=GENERIC_ADDRESS)

    def enabled(self) -> set[str]:
        return {ALIASES[p] for p in self.passes}


def normalised(entities: DataFrame, normaliser: text.Normaliser | None = None) -> DataFrame:
    """Entities with norm_name, norm_address, country folded, name_tokens, addr_tokens, name_3grams and addr_3grams; computed once an entity."""
    n = normaliser or text.Normaliser()
    base = entities.select("entity_id", F.coalesce("business_name", F.lit("")).alias("raw_name"), F.coalesce("business_address", F.lit("")).alias("raw_address"), text.country(F.col("country")).alias("country"), n.name(F.col("business_name")).alias("norm_name"), n.address(F.col("business_address")).alias("norm_address"))
    return base.select("*", text.name_words(F.col("norm_name"), n.least, n.without_stopwords).alias("name_tokens"), text.words_of(F.col("norm_address"), n.least).alias("addr_tokens"), char_grams(F.col("norm_name")).alias("name_3grams"), char_grams(F.col("norm_address")).alias("addr_3grams"))


def _none() -> Column:
    return F.array().cast("array<string>")


def b1(name: Column, country: Column) -> Column:
    """Whole name and country."""
    return F.when(name != "", F.array(F.concat(name, F.lit("___"), country))).otherwise(_none())


def b2(name: Column, country: Column, length: int = 3) -> Column:
    """Each distinctive name word and country."""
    return F.transform(F.array_distinct(text.name_words(name, length, True)), lambda t: F.concat(F.lit("tok_"), t, F.lit("___"), country))


def b3(name: Column, country: Column, length: int = 4) -> Column:
    """First characters of the name and country."""
    return F.when(F.length(name) >= length, F.array(F.concat(F.lit("pref_"), F.substring(name, 1, length), F.lit("___"), country))).otherwise(_none())


def b4(name: Column, address: Column, config: Config = Config()) -> Column:
    """First name words times first address words, whatever the country."""
    names = F.slice(text.name_words(name, config.b4_name_length, True), 1, config.b4_names)
    addresses = F.slice(text.words_of(address, config.b4_address_length), 1, config.b4_addresses)
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.transform(addresses, lambda a: F.concat(F.lit("na_"), n, F.lit("___"), a)))))


def _numeric(w: Column) -> Column:
    """All digits, or digits and letters."""
    return w.rlike("^[0-9]+$") | (w.rlike("[0-9]") & w.rlike("[a-z]"))


def _b5a_numbers(words: Column, config: Config) -> Column:
    return F.slice(F.array_distinct(F.filter(words, _numeric)), 1, config.b5a_numbers)


def _b5a_places(words: Column, config: Config) -> Column:
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~_numeric(w) & (F.length(w) >= 3) & ~w.isin(*config.generic))), 1, config.b5a_words)


def _b5a_of(numbers: Column, places: Column, country: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.transform(places, lambda p: F.concat(F.lit("b5_num_"), n, F.lit("_"), p, F.lit("___"), country)))))


def b5a(address: Column, country: Column, config: Config = Config()) -> Column:
    """First house numbers times first distinctive address words, and country."""
    words = text.words_of(address, 2)
    return _b5a_of(_b5a_numbers(words, config), _b5a_places(words, config), country)


def _b5b_words(words: Column, config: Config) -> Column:
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*config.generic) & ~w.rlike("^[0-9]+$"))), 1, config.b5b_words)


def _b5b_of(words: Column, country: Column) -> Column:
    pairs = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y > x), lambda y: F.concat(F.lit("b5_pair_"), x, F.lit("_"), y, F.lit("___"), country))))
    return F.array_distinct(pairs)


def b5b(address: Column, country: Column, config: Config = Config()) -> Column:
    """Unordered pairs of the first distinctive address words, and country."""
    return _b5b_of(_b5b_words(text.words_of(address, 2), config), country)


def with_keys(normal: DataFrame, config: Config = Config()) -> DataFrame:
    """entity_id, source, keys: structs of pass (place in PASSES) and key, of all enabled passes; columns named _... stay. Words are split once, before the passes combine them."""
    kept = [c for c in normal.columns if c.startswith("_")]
    name, address, country = F.col("norm_name"), F.col("norm_address"), F.col("country")
    split = normal.select("entity_id", F.substring("entity_id", 1, 2).alias("source"), "norm_name", "norm_address", "country", *kept, text.words_of(address, 2).alias("_words"))
    parts = split.select("*", *[c.alias(f"_{n}") for n, c in (("numbers", _b5a_numbers(F.col("_words"), config)), ("places", _b5a_places(F.col("_words"), config)), ("pairable", _b5b_words(F.col("_words"), config)))])
    made = {
        "b1": b1(name, country), "b2": b2(name, country, config.b2_length), "b3": b3(name, country, config.b3_length), "b4": b4(name, address, config),
        "b5a": _b5a_of(F.col("_numbers"), F.col("_places"), country), "b5b": _b5b_of(F.col("_pairable"), country),
    }
    numbered = lambda i: lambda k: F.struct(F.lit(i).alias("pass"), k.alias("key"))
    of = [F.transform(made[p], numbered(i)) for i, p in enumerate(PASSES) if p in config.enabled()]
    return parts.select("entity_id", "source", *kept, F.concat(*of).alias("keys"))


def keys(normal: DataFrame, config: Config = Config()) -> DataFrame:
    """entity_id, source, pass (place in PASSES), key: the keys of all enabled passes."""
    return postings_of(with_keys(normal, config))


def postings_of(keyed: DataFrame) -> DataFrame:
    return keyed.select("entity_id", "source", F.explode("keys").alias("k")).select("entity_id", "source", "k.pass", "k.key")


def most_postings(config: Config, p: Column | None = None) -> Column:
    """The document frequency beyond which the keys of a pass (p, its place in PASSES) are pruned, or null."""
    p = F.col("pass") if p is None else p
    return F.when(p == PASSES.index("b2"), config.b2_most).when(p >= PASSES.index("b5a"), config.b5_most)


def key_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source", "pass", "key").agg(F.count("*").alias("n"))


def pruned_keys(postings: DataFrame, config: Config = Config()) -> DataFrame:
    """source, pass, key, n of the keys that pruning drops."""
    return key_counts(postings).filter(F.col("n") > most_postings(config))


def prune(postings: DataFrame, config: Config = Config()) -> DataFrame:
    """Postings without those of keys that are too frequent in their source."""
    return postings.join(pruned_keys(postings, config).select("source", "pass", "key"), ["source", "pass", "key"], "left_anti")


def top_keys(postings: DataFrame, name: str, n: int = 10) -> DataFrame:
    """source, key, n: the most frequent keys of a pass in each source, ties by key."""
    ranked = key_counts(postings.filter(F.col("pass") == PASSES.index(ALIASES[name]))).withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "key")))
    return ranked.filter(F.col("r") <= n).select("source", "key", "n")


def index_stats(normal: DataFrame, config: Config = Config()) -> DataFrame:
    """A row a source: keys of each pass after pruning, pruned keys, postings, and missing addresses."""
    marked = key_counts(keys(normal, config)).withColumn("gone", F.coalesce(F.col("n") > most_postings(config), F.lit(False)))
    of = lambda p: F.col("pass") == PASSES.index(p)
    counts = marked.groupBy("source").agg(
        *[F.count_if(of(p) & ~F.col("gone")).alias(f"{p}_unique_keys") for p in PASSES],
        *[F.count_if(of(p) & F.col("gone")).alias(f"{p}_pruned_keys") for p in ("b2", "b5a", "b5b")],
        *[F.coalesce(F.sum(F.when(of(p) & ~F.col("gone"), F.col("n"))), F.lit(0)).alias(f"{p}_total_postings") for p in ("b4", "b5a", "b5b")],
    )
    missing = F.count_if(F.col("norm_address") == "")
    sizes = normal.groupBy(F.substring("entity_id", 1, 2).alias("source")).agg(F.count("*").alias("total_indexed"), missing.alias("missing_addresses"), F.round(missing * 100.0 / F.count("*"), 2).alias("missing_address_pct"))
    zeros = [x for x in counts.columns if x != "source"]
    return sizes.join(counts, "source", "left").fillna(0, zeros)


def large_keys(postings: DataFrame, config: Config = Config(), hot: int | None = None) -> DataFrame:
    """source, pass, key, n, gone: the keys that pruning drops, and of the others those with more than hot postings; written once.

    There are at most as many as postings divided by the least of those limits.
    """
    gone = F.coalesce(F.col("n") > most_postings(config), F.lit(False))
    return settled(key_counts(postings).withColumn("gone", gone).filter(F.col("gone") | (F.col("n") > (hot or HOT))))


def few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few enough rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def coded(keyed: DataFrame, seed: int) -> DataFrame:
    """with_keys' rows, each key as a number (codes: a hash, and the pass in the low three bits) and as a second hash (checks)."""
    code = lambda k: F.shiftleft(F.xxhash64(F.lit(seed), k["key"], k["pass"]), 3).bitwiseOR(k["pass"].cast("long"))
    return keyed.withColumns({"codes": F.transform("keys", code), "checks": F.transform("keys", lambda k: F.hash(k["key"], k["pass"]))}).drop("keys")


def by_pass(codes: Column) -> Column:
    """Codes in the order of their passes, as with_keys makes them."""
    return F.transform(F.array_sort(F.transform(codes, lambda c: F.struct(c.bitwiseAND(7).alias("p"), c.alias("c")))), lambda x: x["c"])


def once(coded_rows: DataFrame) -> DataFrame:
    """Rows of one id that occurs several times all get the codes of all of them; without columns besides (_e), they become one row."""
    rows = coded_rows.drop("checks")
    repeated = settled(rows.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1").select("entity_id"))
    if repeated.isEmpty():
        return rows
    repeated = few(repeated)
    several = settled(rows.join(repeated, "entity_id").groupBy("entity_id").agg(F.first("source").alias("source"), by_pass(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("all")))
    if "_e" not in rows.columns:
        return rows.join(repeated, "entity_id", "left_anti").unionByName(several.withColumnRenamed("all", "codes"))
    return rows.join(few(several.drop("source")), "entity_id", "left").withColumn("codes", F.coalesce("all", "codes")).drop("all")


def postings_by_code(asked: DataFrame, known: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, int] | None:
    """Both sides' coded rows by code and salt, and over how many tasks to deal them out by these; None if two keys have one code.

    Codes are counted by source first. Pruned ones leave the targets. A code at which very many pairs meet has its targets dealt
    out over as many salts as that asks for, and its queries sent to each.
    """
    told = [k.select(F.lit(of).alias("asked"), "source", F.inline(F.arrays_zip("codes", "checks"))) for of, k in ((True, asked), (False, known))]
    counts = told[0].unionByName(told[1]).groupBy("codes", "asked", "source").agg(F.count("*").alias("n"), F.min("checks").alias("least"), F.max("checks").alias("most"))
    pruning = F.coalesce(F.col("n") > most_postings(config, F.col("codes").bitwiseAND(7)), F.lit(False)) & ~F.col("asked")
    counts = settled(counts.withColumn("gone", pruning).withColumnRenamed("codes", "code"))
    n, m = F.when(~F.col("gone") & ~F.col("asked"), F.col("n")), F.when(F.col("asked"), F.col("n"))
    by_code = counts.groupBy("code").agg(F.sum(n).alias("n"), F.sum(m).alias("m"), F.min("least").alias("least"), F.max("most").alias("most"))
    pairs, clash = F.col("n") * F.col("m"), F.col("least") != F.col("most")
    spread = F.least(F.greatest(F.ceil(F.col("pairs") / MEETINGS), F.ceil(F.col("n") / HOT)), F.col("n")).cast("int")
    by_code = settled(by_code.select("code", "n", pairs.alias("pairs"), clash.alias("clash")).filter("clash or pairs > 0").withColumn("salts", spread))
    total = by_code.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.max("clash").alias("clash")).first()
    if total.clash:
        return None
    gone, hot = settled(counts.filter("gone").select("source", "code")), few(settled(by_code.filter("salts > 1").select("code", "salts")))
    asked, known = once(asked), once(known)
    if not gone.isEmpty():
        lost = known.select("entity_id", "source", F.explode("codes").alias("code")).join(few(gone), ["source", "code"]).groupBy("entity_id").agg(F.collect_set("code").alias("lost"))
        known = known.join(lost, "entity_id", "left").withColumn("codes", F.when(F.col("lost").isNull(), F.col("codes")).otherwise(F.array_except("codes", "lost"))).drop("lost")
    salts = F.coalesce("salts", F.lit(1))
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total.pairs // MEETINGS))
    s, t = (k.select("*", F.explode("codes").alias("code")).join(hot, "code", "left") for k in (asked, known))
    s = s.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    t = t.withColumn("salt", F.pmod(F.xxhash64("entity_id"), salts).cast("int"))
    return s.drop("salts"), t.drop("salts"), parts


def told_apart(normal: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, int]:
    """postings_by_code of the rows that are _asked and the others, with hashes by which no two keys have one code."""
    seed, found = 0, None
    while found is None:
        keyed = settled(coded(with_keys(normal, config), seed))
        found = postings_by_code(*(keyed.filter(c).drop("_asked") for c in ("_asked", "not _asked")), config)
        seed += 1
    return found


def grown(e: Column, names: tuple[str, ...]) -> list[Column]:
    """Columns of normalised entities, and of features.side(), that are made of a struct's names and addresses, as normalised() makes them by default."""
    made = {"name_tokens": lambda: text.name_words(e["norm_name"], 2), "addr_tokens": lambda: text.words_of(e["norm_address"], 2), "name_3grams": lambda: char_grams(e["norm_name"]), "addr_3grams": lambda: char_grams(e["norm_address"])}
    made |= features.sides(lambda n: made[n]())
    return [(made[n]() if n in made else e[n]).alias(n) for n in names]


def matched(normal: DataFrame, asked: Column, config: Config = Config(), keep: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, cand_id, source, pass_mask of the candidate pairs, of normalised entities that are asked and others that are not.

    The columns in keep follow, of both sides, as structs e1 and e2. A pair is made where the first code that both sides share
    meets, and nowhere else: pairs are neither grouped nor shuffled, nor joined with their entities later. Names and addresses
    travel with the postings; words and n-grams are made of them where they arrive, before pairs are.
    """
    of = {n: c for c, made in (("norm_name", "name_tokens name_3grams first words name_codes"), ("norm_address", "addr_tokens addr_3grams places numbers addr_codes")) for n in made.split()}
    found = told_apart(normal.select("entity_id", "norm_name", "norm_address", "country", asked.alias("_asked"), *([F.struct(*dict.fromkeys(of.get(c, c) for c in keep)).alias("_e")] if keep else [])), config)
    found, parts = found[:2], found[2]
    passes = config.enabled()
    s, t = (k.repartition(parts, "code", "salt").select("code", "salt", F.col("entity_id").alias(i), *(["source"] if i == "cand_id" else []), F.col("codes").alias(f"{i}_codes"), *[F.struct(*grown(F.col("_e"), keep)).alias(e) for e in [e] if keep]) for k, i, e in zip(found, ("s1_id", "cand_id"), ("e1", "e2"), strict=True))
    bit = lambda c: F.call_function("shiftleft", F.lit(1), c.bitwiseAND(7).cast("int"))
    mask = bit(F.col("code"))
    if len(passes) > 1:
        shared = F.array_intersect("s1_id_codes", "cand_id_codes")
        met = s.join(t, ["code", "salt"]).withColumn("shared", shared).filter(F.get("shared", F.lit(0)) == F.col("code"))
        mask = F.aggregate("shared", F.lit(0), lambda m, c: m.bitwiseOR(bit(c)))
    else:  # only the codes before this one
        s = s.withColumn("s1_id_codes", F.slice("s1_id_codes", F.lit(1), F.array_position("s1_id_codes", F.col("code")).cast("int") - 1))
        met = s.join(t, ["code", "salt"]).filter((F.size("s1_id_codes") == 0) | ~F.arrays_overlap("s1_id_codes", "cand_id_codes"))
    return met.select("s1_id", "cand_id", "source", mask.alias("pass_mask"), *[e for e in ("e1", "e2") if keep])


def mapped(df: DataFrame, each, schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package, wherever the driver was started."""
    environment = df.sparkSession.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH", "")]))
    return df.mapInArrow(each, schema)


@dataclass(frozen=True)
class Postings:
    """Both sides' postings with what the features named ask for, to be paired by kernels: asked ones, others, and tasks."""

    asked: DataFrame
    known: DataFrame
    parts: int
    names: tuple[str, ...]

    def met(self) -> DataFrame:
        both = self.asked.unionByName(self.known, allowMissingColumns=True)
        return both.repartition(self.parts, "code", "salt").sortWithinPartitions("code", "salt", "asked")

    def listed(self) -> DataFrame:
        """s1_id, cand_id, source, label if asked postings have links, and the features of matched()'s pairs."""
        told = "label int, " * ("links" in self.asked.columns)
        return mapped(self.met(), kernels.listed(self.names, bool(told)), f"s1_id string, cand_id string, source string, {told}{', '.join(f'{f} double' for f in self.names)}")

    def counted(self) -> DataFrame:
        """label, the features, and n: how many of the pairs have these. Asked postings have links. As many rows as there are distinct ones."""
        rows = mapped(self.met(), kernels.counted(self.names), f"label int, {', '.join(f'{f} double' for f in self.names)}, n bigint")
        return rows.groupBy("label", *self.names).agg(F.sum("n").alias("n"))


def postings(normal: DataFrame, asked: Column, names: tuple[str, ...], config: Config = Config(), kept: tuple[str, ...] = ()) -> Postings:
    """Words and grams are to be made as normalised() makes them by default. The columns in kept stay on asked ones: links is an array of ids, or null."""
    texts = {"norm_name": any("name" in f for f in names), "norm_address": any("addr" in f for f in names), "country": "country_match" in names}
    e = F.struct(*[(F.col(c) if wanted else F.lit("")).alias(c) for c, wanted in texts.items()], *kept)
    s, t, parts = told_apart(normal.select("entity_id", "norm_name", "norm_address", "country", asked.alias("_asked"), e.alias("_e")), config)
    # A pair is left to a code before this one if both have that: asked ones come with the codes up to this, others with those of no later pass.
    early = F.slice("codes", F.lit(1), F.array_position("codes", F.col("code")).cast("int")), F.filter("codes", lambda c: c.bitwiseAND(7) <= F.col("code").bitwiseAND(7))
    s, t = (k.select("code", "salt", F.lit(who).alias("asked"), "entity_id", "source", codes.alias("codes"), "_e.*") for k, who, codes in ((s, True, early[0]), (t, False, early[1])))
    return Postings(s, t.drop(*kept), parts, names)


def candidates(queries: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """s1_id, cand_id, source, pass_mask: pairs that share a key which survives pruning; both sides are normalised."""
    columns = ("entity_id", "norm_name", "norm_address", "country")
    both = queries.select(*columns, F.lit(True).alias("_is_query")).unionByName(targets.select(*columns, F.lit(False).alias("_is_query")))
    return matched(both, F.col("_is_query"), config)


def frequent_keys(postings: DataFrame, config: Config = Config()) -> DataFrame:
    """source, pass, key of the keys that pruning drops, as pruned_keys has them; only keys whose hashes are frequent are counted whole. Written once."""
    code = F.xxhash64("key")
    hashes = postings.filter(most_postings(config).isNotNull()).groupBy("source", "pass", code.alias("code")).agg(F.count("*").alias("n"))
    often = settled(hashes.filter(F.col("n") > most_postings(config)).select("source", "pass", "code"))
    left = postings.withColumn("code", code).join(few(often), ["source", "pass", "code"], "left_semi")
    return settled(pruned_keys(left, config).select("source", "pass", "key"))


def among(pairs: DataFrame, queries: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Those of the candidates that are among the distinct pairs given (s1_id, cand_id), with source and pass_mask.

    Both sides' keys are compared pair by pair, so the work grows with these pairs, not with all candidates.
    """
    known, asked = settled(with_keys(targets, config)), with_keys(queries, config)
    gone = few(frequent_keys(postings_of(known), config))

    def sets(keyed: DataFrame, name: str) -> DataFrame:
        return keyed.select(F.col("entity_id").alias(name), F.col("source").alias(f"{name}_source"), F.transform("keys", lambda k: F.concat(k["pass"].cast("string"), k["key"])).alias(f"{name}_keys"))

    both = pairs.select("s1_id", "cand_id").join(sets(asked, "s1_id"), "s1_id").join(sets(known, "cand_id"), "cand_id")
    shared = both.select("s1_id", "cand_id", F.col("cand_id_source").alias("source"), F.explode(F.array_intersect("s1_id_keys", "cand_id_keys")).alias("k"))
    shared = shared.select("s1_id", "cand_id", "source", F.substring("k", 1, 1).cast("int").alias("pass"), F.expr("substring(k, 2)").alias("key"))
    return shared.join(gone, ["source", "pass", "key"], "left_anti").groupBy("s1_id", "cand_id", "source").agg(F.bit_or(F.expr("shiftleft(1, pass)")).alias("pass_mask"))


def counted(queries: DataFrame, targets: DataFrame, config: Config = Config(), common: int = COMMON) -> DataFrame:
    """s1_id, source, pass_mask, n: how many candidates with that mask each entity has, without listing all pairs.

    Rows may repeat a mask, and n may be negative: sums over them count. Keys that more than common pairs share are few, and
    so are the sets of them that entities have: such sets are paired in place of entities. The pairs that share other keys are
    listed; each moves from the mask of its common keys, if it has any, to that of all.
    """
    known, asked = settled(with_keys(targets, config)), settled(with_keys(queries, config))
    gone = few(frequent_keys(postings_of(known), config))
    postings = postings_of(known).join(gone, ["source", "pass", "key"], "left_anti").distinct()
    mine = postings_of(asked).select(F.col("entity_id").alias("s1_id"), "pass", "key").distinct()
    sizes = postings.groupBy("pass", "key").agg(F.count("*").alias("n")).join(mine.groupBy("pass", "key").agg(F.count("*").alias("m")), ["pass", "key"])
    sizes = settled(sizes.withColumn("often", F.col("n") * F.col("m") > common))
    often = settled(sizes.filter("often").select("pass", "key").withColumn("code", F.monotonically_increasing_id() * 8 + F.col("pass")))
    sets = lambda rows, *by: settled(rows.join(few(often), ["pass", "key"]).groupBy(*by).agg(F.array_sort(F.collect_set("code")).alias("codes")))
    s, t = sets(mine, "s1_id"), sets(postings, "entity_id", "source")
    kinds_s, kinds_t = s.select(F.col("codes").alias("s")).distinct(), t.groupBy("source", F.col("codes").alias("t")).agg(F.count("*").alias("n"))
    bit = F.expr("shiftleft(1, cast(code & 7 as int))")
    met = kinds_s.select("s", F.explode("s").alias("code")).join(kinds_t.select("*", F.explode("t").alias("code")), "code").groupBy("s", "source", "t", "n").agg(F.bit_or(bit).alias("pass_mask"))
    met = met.groupBy("s", "source", "pass_mask").agg(F.sum("n").alias("n"))
    whole = s.join(met, s["codes"] == met["s"]).select("s1_id", "source", "pass_mask", "n")
    rest = sizes.filter("not often").select("pass", "key")
    listed = mine.join(rest, ["pass", "key"]).join(postings.withColumnRenamed("entity_id", "cand_id"), ["pass", "key"]).groupBy("s1_id", "cand_id", "source").agg(F.bit_or(F.expr("shiftleft(1, pass)")).alias("more"))
    both = listed.join(s.withColumnRenamed("codes", "s"), "s1_id", "left").join(t.select(F.col("entity_id").alias("cand_id"), F.col("codes").alias("t")), "cand_id", "left")
    shared = F.array_intersect(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in ("s", "t")])
    both = both.select("s1_id", "source", "more", F.aggregate(shared, F.lit(0), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), c.bitwiseAND(7).cast("int")))).alias("had"))
    one = lambda mask, n: F.struct(mask.alias("pass_mask"), F.lit(n).cast("long").alias("n"))
    moved = both.select("s1_id", "source", F.inline(F.array(one(F.col("more").bitwiseOR(F.col("had")), 1), one(F.col("had"), -1)))).filter("pass_mask > 0")
    return whole.unionByName(moved)


def in_stage(pairs: DataFrame, stage: str) -> DataFrame:
    """The pairs that a pass or a cumulative stage finds."""
    mask = STAGES.get(stage) if stage in STAGES else 1 << PASSES.index(ALIASES[stage])
    return pairs.filter(F.col("pass_mask").bitwiseAND(mask) != 0)


def lookup(pairs: DataFrame, entities: DataFrame, id_col: str) -> DataFrame:
    """Pairs with the raw entity of one side."""
    return pairs.join(entities.withColumnRenamed("entity_id", id_col), id_col)


def labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with label 1 if ground truth links them, else 0."""
    true = links.select("s1_id", "cand_id", F.lit(1).alias("label"))
    return pairs.join(true, ["s1_id", "cand_id"], "left").fillna(0, ["label"])


def missed(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links that no pair covers."""
    return links.join(pairs, ["s1_id", "cand_id"], "left_anti")
