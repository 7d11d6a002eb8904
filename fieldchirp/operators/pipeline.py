"""Preprocessing as an ordered list of named steps, each a function from DataFrame to DataFrame, and the steps themselves.

Random choices come from a keyed hash of the sample's id, so a run can be
repeated on any partitioning and no step needs state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.functions import signal
from fieldchirp.operators.rangescan import running
from fieldchirp.operators.selection import hash_order


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]
    augments: bool = False
    bypass: bool = False


@dataclass(frozen=True)
class Pipeline:
    """Named steps in order; every change gives a new pipeline."""

    steps: tuple[Step, ...] = field(default_factory=tuple)

    def _at(self, name: str) -> int:
        names = [s.name for s in self.steps]
        if name not in names:
            raise KeyError(f"no step {name} among {names}")
        return names.index(name)

    def insert(self, step: Step, after: str | None = None, before: str | None = None) -> Pipeline:
        """With ``step`` after or before a named one, or at the end."""
        if after is not None and before is not None:
            raise ValueError("give after or before, not both")
        if any(s.name == step.name for s in self.steps):
            raise ValueError(f"there is a step {step.name} already")
        i = self._at(after) + 1 if after is not None else self._at(before) if before is not None else len(self.steps)
        return Pipeline((*self.steps[:i], step, *self.steps[i:]))

    def remove(self, name: str) -> Pipeline:
        i = self._at(name)
        return Pipeline((*self.steps[:i], *self.steps[i + 1 :]))

    def switch(self, name: str, bypass: bool) -> Pipeline:
        i = self._at(name)
        return Pipeline((*self.steps[:i], replace(self.steps[i], bypass=bypass), *self.steps[i + 1 :]))

    def forward(self, df: DataFrame, augment: bool = True, stop_at: str | None = None, trace: dict[str, DataFrame] | None = None) -> DataFrame:
        """The samples after the steps, up to but not including ``stop_at``; ``trace`` collects the plan after each."""
        if stop_at is not None:
            self._at(stop_at)
        for s in self.steps:
            if s.name == stop_at:
                break
            if not s.bypass and (augment or not s.augments):
                df = df.transform(s.run)
                if trace is not None:
                    trace[s.name] = df
        return df


def uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) of the row's key."""
    return F.conv(F.substring(hash_order(seed, *cols), 1, 8), 16, 10).cast("double") / float(2**32)


def on_samples(f: Callable[[Column], Column], column: str = "samples") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(column, f(F.col(column)))


def fit_length(n: int, extend: bool = True, column: str = "samples", seed: int | None = None, key: str = "id") -> Callable[[DataFrame], DataFrame]:
    """Cut to ``n`` samples, from a random place if there is a seed; shorter ones are filled with silence, or become null where ``extend`` is false."""

    def run(df: DataFrame) -> DataFrame:
        x = F.col(column)
        long = signal.extend_to(x, n) if extend else F.when(F.size(x) >= n, x)
        start = F.lit(1) if seed is None else F.floor(uniform(seed, key) * (F.size(long) - n + 1)).cast("int") + 1
        return df.withColumn(column, F.slice(long, start, F.lit(n)))

    return run


def random_gain(low: float = -30.0, high: float = 0.0, seed: int = 0, key: str = "id", column: str = "samples") -> Callable[[DataFrame], DataFrame]:
    """Gain in decibels, uniform between both."""

    def run(df: DataFrame) -> DataFrame:
        g = F.pow(F.lit(10.0), (F.lit(low) + F.lit(high - low) * uniform(seed, key)) / 20.0)
        return df.withColumn("__g", g).withColumn(column, signal.clamp(F.transform(column, lambda v: v * F.col("__g")))).drop("__g")

    return run


def adaptive_gain(low: float = -30.0, high: float = 0.0, floor_db: float = -40.0, seed: int = 0, key: str = "id", column: str = "samples") -> Callable[[DataFrame], DataFrame]:
    """As ``random_gain``, but never so much quieter that the level falls below ``floor_db``; one below it already isn't made quieter."""

    def run(df: DataFrame) -> DataFrame:
        level = F.coalesce(signal.dbfs(F.col(column)), F.lit(float("-inf")))
        least = F.least(F.greatest(F.lit(low), F.lit(floor_db) - level), F.lit(high))
        g = F.pow(F.lit(10.0), (least + (F.lit(high) - least) * uniform(seed, key)) / 20.0)
        return df.withColumn("__g", g).withColumn(column, signal.clamp(F.transform(column, lambda v: v * F.col("__g")))).drop("__g")

    return run


def random_wrap(probability: float = 0.5, seed: int = 0, key: str = "id", column: str = "samples") -> Callable[[DataFrame], DataFrame]:
    """With a probability, the samples after a random place come before those ahead of it."""

    def run(df: DataFrame) -> DataFrame:
        x = F.col(column)
        at = F.floor(uniform(seed + 1, key) * F.size(x)).cast("int")
        turned = F.concat(F.slice(x, at + 1, F.size(x)), F.slice(x, F.lit(1), at))
        return df.withColumn(column, F.when((uniform(seed, key) < probability) & (F.size(x) > 0), turned).otherwise(x))

    return run


def time_mask(share: float = 0.2, seed: int = 0, key: str = "id", column: str = "samples", fill: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """Fill a run of ``share`` of the samples that begins at a random place."""

    def run(df: DataFrame) -> DataFrame:
        n = F.size(column)
        width = F.floor(n * F.lit(share))
        first = F.floor(uniform(seed, key) * (n - width + 1))
        return df.withColumns({"__a": first, "__b": first + width}).withColumn(column, F.transform(column, lambda v, i: F.when((i >= F.col("__a")) & (i < F.col("__b")), F.lit(fill)).otherwise(v))).drop("__a", "__b")

    return run


def jitter(width: float, seed: int = 0, key: str = "id", column: str = "samples") -> Callable[[DataFrame], DataFrame]:
    """Add uniform noise of +-``width``, another for every sample."""

    def run(df: DataFrame) -> DataFrame:
        noise = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32) * (2 * width) - width
        return df.withColumn(column, F.transform(column, lambda v, i: v + noise(i)))

    return run


def overlay(samples: DataFrame, pool: DataFrame, classes: list[str], weight: float = 0.5, probability: float = 1.0, seed: int = 0, key: str = "id", different: bool = False) -> DataFrame:
    """Blend samples with partners of ``pool`` (id, samples, classes): x * (1 - weight) + y * weight; a label holds where either has it.

    Both tables are put in seeded order by the ordered scan and matched by
    position, so every partner is used about as often and neither is
    collected.  ``different`` leaves a sample as it is where the partner
    shares a class with it.  An empty pool changes nothing.
    """
    n = pool.count()
    if not n:
        return samples
    one = F.lit(1).cast("long")
    place = lambda df, s, name: running(df.withColumns({"__o": hash_order(s, key), "__one": one}), [], ["__o"], {name: "__one"}, name="overlay").drop("__o", "__one")
    left = place(samples, seed, "__k").withColumn("__k", (F.col("__k") - 1) % F.lit(n))
    partner = place(pool.select(key, F.col("samples").alias("__y"), *[F.col(c).alias(f"__{c}") for c in classes]), seed + 1, "__k").withColumn("__k", F.col("__k") - 1).drop(key)
    met = left.join(partner, "__k")
    take = uniform(seed + 2, key) < probability
    if different:
        shared = F.lit(False)
        for c in classes:
            shared = shared | ((F.col(c) == 1) & (F.col(f"__{c}") == 1))
        take = take & ~shared
    blend = F.zip_with("samples", "__y", lambda a, b: a * (1.0 - weight) + b * weight)
    out = {"samples": F.when(take, blend).otherwise(F.col("samples"))} | {c: F.when(take, F.greatest(c, f"__{c}")).otherwise(F.col(c)) for c in classes}
    return met.withColumns(out).select(*samples.columns)
