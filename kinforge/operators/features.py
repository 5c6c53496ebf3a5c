"""The 25 features of a pair, in fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import similarity as sim

FEATURES = (
    "name_exact", "name_token_jaccard", "name_token_dice", "name_token_overlap", "name_3gram_jaccard", "name_jaro_winkler", "name_levenshtein", "name_first_token",
    "name_length_ratio", "name_length_diff", "s1_name_missing", "cand_name_missing", "addr_exact", "addr_token_jaccard", "addr_token_overlap", "addr_3gram_jaccard",
    "addr_number_overlap", "addr_length_diff", "s1_addr_missing", "cand_addr_missing", "both_addr_missing", "name_addr_exact", "country_match", "is_s2", "is_s3",
)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


#: What the features ask of either side; words and the sets after them only for the features named.
PLAIN = ("entity_id", "norm_name", "norm_address", "country")
SETS = {
    "words": ("name_token_jaccard", "name_token_dice", "name_token_overlap"), "places": ("addr_token_jaccard", "addr_token_overlap"), "numbers": ("addr_number_overlap",),
    "name_codes": ("name_3gram_jaccard",), "addr_codes": ("addr_3gram_jaccard",),
}


def side(names: tuple[str, ...] = FEATURES) -> tuple[str, ...]:
    """The columns of either side that the features named ask for."""
    return (*PLAIN, *["first"] * ("name_first_token" in names), *[s for s, of in SETS.items() if set(of) & set(names)])


def sides(e: Callable[[str], Column]) -> dict[str, Callable[[], Column]]:
    """The columns of side() that are made of a normalised entity's: once an entity, not once a pair."""
    return {
        "first": lambda: F.coalesce(F.get(e("name_tokens"), F.lit(0)), F.lit("")), "words": lambda: F.array_distinct(e("name_tokens")), "places": lambda: F.array_distinct(e("addr_tokens")),
        "numbers": lambda: sim.numbers(e("addr_tokens")), "name_codes": lambda: sim.gram_codes(e("name_3grams")), "addr_codes": lambda: sim.gram_codes(e("addr_3grams")),
    }


def meetings(pairs: DataFrame, names: tuple[str, ...] = FEATURES, a: str = "e1", b: str = "e2") -> DataFrame:
    """Pairs with _n_, _m_ and _both_ columns: the sizes of both sides' texts and sets and of what sets share, each taken once a pair."""
    sets = [s for s in SETS if s in side(names)]
    sizes = {f"_{k}_{s}": c for s in sets for k, c in (("n", F.size(f"{a}.{s}")), ("m", F.size(f"{b}.{s}")), ("both", F.size(F.array_intersect(f"{a}.{s}", f"{b}.{s}"))))}
    lengths = {f"_{k}_{s}": F.length(f"{e}.{s}") for s in ("norm_name", "norm_address") for k, e in (("n", a), ("m", b))}
    return pairs.select("*", *[c.alias(n) for n, c in (sizes | lengths).items()])


def expressions(a: str = "e1", b: str = "e2") -> dict[str, Column]:
    """Each feature over two structs of side()'s columns and their meetings."""
    x = lambda f: F.col(f"{a}.{f}")
    y = lambda f: F.col(f"{b}.{f}")
    name, addr, first = ((x(f), y(f)) for f in ("norm_name", "norm_address", "first"))
    n, m, k, l = (F.col(c) for c in ("_n_norm_name", "_m_norm_name", "_n_norm_address", "_m_norm_address"))  # noqa: E741
    met = lambda f, s: f(*[F.col(f"_{c}_{s}") for c in ("n", "m", "both")])
    exact = lambda p: _flag((p[0] != "") & (p[0] == p[1]))
    values = (
        exact(name), met(sim.jaccard_of, "words"), met(sim.dice_of, "words"), met(sim.overlap_of, "words"), met(sim.jaccard_of, "name_codes"), sim.jaro_winkler(*name), sim.levenshtein_similarity(*name), exact(first),
        F.when(F.greatest(n, m) > 0, F.least(n, m) / F.greatest(n, m)).otherwise(1.0), F.abs(n - m).cast("double"), _flag(n == 0), _flag(m == 0), exact(addr), met(sim.jaccard_of, "places"), met(sim.overlap_of, "places"), met(sim.jaccard_of, "addr_codes"),
        met(sim.overlap_of, "numbers"), F.abs(k - l).cast("double"), _flag(k == 0), _flag(l == 0), _flag((k == 0) & (l == 0)), exact(name) * exact(addr), exact((x("country"), y("country"))), _flag(y("entity_id").startswith("S2-")), _flag(y("entity_id").startswith("S3-")),
    )
    return dict(zip(FEATURES, values, strict=True))


def paired(pairs: DataFrame, normal: DataFrame) -> DataFrame:
    """Pairs with both normalised entities as structs e1 and e2; pairs with an unknown id go."""
    whole = F.struct(*normal.columns)
    return pairs.join(normal.select(F.col("entity_id").alias("s1_id"), whole.alias("e1")), "s1_id").join(normal.select(F.col("entity_id").alias("cand_id"), whole.alias("e2")), "cand_id")


def of_met(pairs: DataFrame, names: tuple[str, ...] = FEATURES, kept: tuple[str, ...] = ("s1_id", "cand_id")) -> DataFrame:
    """The columns kept and the features named, of pairs with side()'s columns as structs e1 and e2."""
    made = expressions()
    return meetings(pairs, names).select(*kept, *[made[f].alias(f) for f in names])


def pair_features(pairs: DataFrame, normal: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """The pairs' columns and the features asked for; the others are never computed."""
    made = sides(F.col)
    return of_met(paired(pairs, normal.select(*[(made[s]() if s in made else F.col(s)).alias(s) for s in side(names)])), names, tuple(pairs.columns))
