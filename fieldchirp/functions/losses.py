"""Activations, losses and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def softmax(x: Column) -> Column:
    """Over an array, shifted by its maximum."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def softmax_and_logit(x: Column) -> Column:
    return F.transform(softmax(x), logit)


def bce_with_logits(x: Column, t: Column) -> Column:
    """Numerically stable binary cross-entropy."""
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def weak_negative_bce(x: str, t: str, weak: float = 0.01) -> Column:
    """Aggregate: unknown targets count as negatives of little weight."""
    w = F.when(F.col(t).isNull(), F.lit(weak)).otherwise(1.0)
    return F.sum(w * bce_with_logits(F.col(x), F.coalesce(F.col(t).cast("double"), F.lit(0.0)))) / F.greatest(F.sum(w), F.lit(1e-8))


def cross_entropy_hot(x: Column, t: Column) -> Column:
    """Cross-entropy of logits against a one-hot target, both arrays; an error where not exactly one target is 1."""
    hot = F.aggregate(t, F.lit(0.0), lambda a, v: a + v.cast("double"))
    top = F.array_max(x)
    total = F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top
    right = F.aggregate(F.zip_with(x, t, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda a, v: a + v)
    one = (hot == 1) & (F.array_max(t).cast("double") == 1)
    return F.when(one, total - right).otherwise(F.raise_error(F.lit("targets must be one-hot")).cast("double"))


# Parameters of the rebalanced loss.
MAP_ALPHA, MAP_BETA, MAP_GAMMA, NEGATIVE_SCALE, START_BIAS = 10.0, 0.2, 0.1, 0.2, 0.05


def resample_loss(df: DataFrame, key: str = "window_id", x: str = "x", t: str = "t", frequencies: DataFrame | None = None) -> DataFrame:
    """Rebalanced cross-entropy of a long table (key, class, x, t): (key, class, weight, loss).

    Every class weighs by how rare it is among the classes of its sample, put
    through a sigmoid; logits start from the class's prior; negatives are
    scaled down and weigh the more.  ``frequencies`` (class, f) are the counts
    of positives, by default those of the table.  The mean of ``loss`` is the
    usual reduction.  A class without positives has no weight (null).
    """
    f = frequencies if frequencies is not None else df.groupBy("class").agg(F.sum(F.col(t).cast("double")).alias("f"))
    total = f.agg(F.sum("f")).first()[0] or 0.0
    y = F.col(t).cast("double")
    rows = df.join(f.where("f > 0"), "class", "left")
    held = rows.groupBy(key).agg(F.sum(y / F.col("f")).alias("__held"))
    rows = rows.join(held, key)
    share = F.when(F.col("__held") > 0, 1.0 / F.col("f") / F.col("__held"))
    base = F.coalesce(sigmoid(F.lit(MAP_BETA) * (share - MAP_GAMMA)), F.when(F.col("f").isNotNull(), 1.0)) + MAP_ALPHA
    prior = -F.log(F.lit(total) / F.col("f") - 1.0) * (START_BIAS / NEGATIVE_SCALE)
    scale = F.when(y == 1, 1.0).otherwise(NEGATIVE_SCALE)
    return rows.select(key, "class", (base / scale).alias("weight"), (base / scale * bce_with_logits((F.col(x) + prior) * scale, y)).alias("loss"))


def learning_rate(step: Column, base: float, max_steps: int, warmup_fraction: float = 0.05, final_ratio: float = 0.0) -> Column:
    """Linear warm-up, then cosine down to ``final_ratio`` of the base rate."""
    w = int(max_steps * warmup_fraction)
    after = F.lit(base) * (final_ratio + (1 - final_ratio) * (1 + F.cos(F.lit(math.pi) * (step - w) / F.lit(max(max_steps - w, 1)))) / 2)
    return F.when(step < w, F.lit(base) * (step + 1) / F.lit(max(w, 1))).otherwise(after)
