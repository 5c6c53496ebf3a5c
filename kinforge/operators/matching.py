"""Matchers: the rule baseline, and a standardised logistic regression with balanced classes."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.operators.blocking import with_keys
from kinforge.operators.features import FEATURES
from kinforge.operators.splits import lowest

#: Rows a task when fitting.
FIT_ROWS = 50_000


@dataclass(frozen=True)
class LinearModel:
    """A fitted logistic regression over standardised features, as a column expression."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        terms = [(F.col(f) - m) * (w / s) for f, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=True)]
        return 1.0 / (1.0 + F.exp(-sum(terms, F.lit(self.intercept))))

    def told(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def read(cls, told: str) -> LinearModel:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(told).items()})


def rule_score(name_exact: str = "name_exact", token_jaccard: str = "name_token_jaccard", country: str = "country_match") -> Column:
    """1.0 for the same name in the same country, 0.85 for names that share most words there, else 0.0."""
    same = F.col(country) == 1.0
    exact = F.col(name_exact) == 1.0
    return F.when(exact & same, 1.0).when(~exact & (F.col(token_jaccard) >= 0.80) & same, 0.85).otherwise(0.0)


def rule_pairs(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, cand_id: distinct pairs of normalised entities, among them all candidates whose rule_score is above 0.

    Such pairs are of one country and have the same words, or share four fifths of all their words. Up to three words are
    then the same ones, as a whole; of n more, one of the first n - ceil(4n / 5) + 1 in a fixed order is shared (long
    words first). Names without a word are alike too: those must share a blocking key.
    """

    def told(normal: DataFrame, name: str) -> DataFrame:
        words = F.array_sort(F.array_distinct("name_tokens"))
        n = F.size(words)
        long_first = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])
        first = F.slice(long_first, 1, n - F.ceil(n * 4 / F.lit(5)).cast("int") + 1)
        of = F.when(n <= 3, F.array(F.concat(F.lit("s"), F.array_join(words, " ")))).otherwise(F.transform(first, lambda w: F.concat(F.lit("w"), w)))
        some = normal.filter((F.col("country") != "") & (F.size("name_tokens") > 0)).select(F.col("entity_id").alias(name), "country", F.explode(of).alias("sign"))
        blank = normal.filter((F.col("country") != "") & (F.size("name_tokens") == 0))
        sign = F.concat(F.lit("k"), F.col("k.pass").cast("string"), F.col("k.key"))
        keyed = with_keys(blank).select("entity_id", F.explode("keys").alias("k")).join(blank.select("entity_id", "country"), "entity_id")
        return some.unionByName(keyed.select(F.col("entity_id").alias(name), "country", sign.alias("sign")))

    return told(queries, "s1_id").join(told(targets, "cand_id"), ["country", "sign"]).select("s1_id", "cand_id").distinct()


def packed(rows: DataFrame, means: np.ndarray, scales: np.ndarray) -> DataFrame:
    """Rows (features, label, weight) as blocks of doubles: a one, the standardised features, label and weight of each."""
    width = len(means)

    def each(batches):
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy() for c in b.columns])
                x[:, :width] = (x[:, :width] - means) / scales
                block = np.ascontiguousarray(np.column_stack([np.ones(len(x)), x]))
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    return rows.mapInArrow(each, "block binary")


def sums_at(blocks: DataFrame, w: np.ndarray) -> np.ndarray:
    """Weighted log-loss of packed rows at w, its gradient and its Hessian, flat: each task adds up its own rows."""
    width = len(w)

    def each(batches):
        total = np.zeros(1 + width + width * width)
        for b in batches:
            for block in b.column(0):
                rows = np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, width + 2)
                x, y, weight = rows[:, :width], rows[:, width], rows[:, width + 1]
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                total[0] += weight @ (np.logaddexp(0, z) - y * z)
                total[1 : 1 + width] += x.T @ (weight * (p - y))
                total[1 + width :] += (x.T @ (x * (weight * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    summed = blocks.mapInArrow(each, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(1 + width + width * width)
    total[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return total


def fit(labelled: DataFrame, features: tuple[str, ...] = FEATURES, c: float = 1.0, balanced: bool = True, iterations: int = 50, tolerance: float = 1e-8) -> LinearModel:
    """The regression with the least ``sum(w ** 2) / 2 + c * weighted log-loss``, the intercept unpenalised, by Newton's method.

    labelled has the features and label, and may have n, how many pairs a row stands for; an empty table raises ValueError. Features are standardised by their population
    deviation; one that never varies is only centred. Rows are packed into blocks once; every step is one pass over them that
    leaves a matrix as wide as the features; steps are halved while they don't lessen the loss.
    """
    n = F.col("n") if "n" in labelled.columns else F.lit(1)
    rows = labelled.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("label").cast("double").alias("label"), n.cast("double").alias("n"))
    told = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("positive"), *[F.sum(F.col(f) * F.col("n")).alias(f"sum_{i}") for i, f in enumerate(features)]).first()
    if not told.n:
        raise ValueError("there are no pairs to fit on")
    means = np.array([told[f"sum_{i}"] for i in range(len(features))]) / told.n
    spread = rows.agg(*[F.when(F.max(f) > F.min(f), F.sqrt(F.sum((F.col(f) - float(m)) ** 2 * F.col("n")) / told.n)).alias(f"std_{i}") for i, (f, m) in enumerate(zip(features, means, strict=True))]).first()
    scales = np.array([spread[f"std_{i}"] or 1.0 for i in range(len(features))])
    weight = F.lit(1.0)
    if balanced and 0 < told.positive < told.n:
        weight = F.when(F.col("label") == 1, told.n / (2.0 * told.positive)).otherwise(told.n / (2.0 * (told.n - told.positive)))
    blocks = packed(rows.withColumn("weight", weight * F.col("n")).drop("n").repartition(-(-told.rows // FIT_ROWS)), means, scales).persist()
    try:
        width = len(features) + 1
        penalty = np.array([0.0, *[1.0] * len(features)])
        w, step, best = np.zeros(width), np.zeros(width), math.inf
        for _ in range(iterations):
            total = sums_at(blocks, w)
            loss = c * total[0] + 0.5 * (penalty * w) @ w
            if loss > best + 1e-12 * abs(best):
                step = step / 2
                w = w - step
                continue
            best = loss
            gradient = c * total[1 : 1 + width] + penalty * w
            step = -np.linalg.solve(c * total[1 + width :].reshape(width, width) + np.diag(penalty + 1e-12), gradient)
            if -gradient @ step <= tolerance:
                break
            w = w + step
    finally:
        blocks.unpersist()
    return LinearModel(tuple(features), tuple(means.tolist()), tuple(scales.tolist()), tuple(w[1:].tolist()), float(w[0]))


def score(pairs: DataFrame, model: LinearModel | None) -> DataFrame:
    """The pairs with their probability; a model that wasn't fitted raises RuntimeError."""
    if model is None:
        raise RuntimeError("the model has not been fitted")
    return pairs.withColumn("probability", model.probability())


def predicted(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def sample_negatives(labelled: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """All positives, and at most so many negatives: those with the smallest MD5 of seed and ids."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), "s1_id", "cand_id"))
    return labelled.filter("label = 1").unionByName(lowest(labelled.filter("label = 0"), digest, most))
