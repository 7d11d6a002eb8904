"""Sampling, splitting and balancing of labelled clips.

Random choices are orders by a keyed hash (md5 of seed and key), so they are
reproducible on any partitioning and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.operators.rangescan import running


def hash_order(seed: int, *cols: str | Column) -> Column:
    """A random-looking string per row: the order of seeded samples."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def class_counts(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in classes])


def split_by_file(df: DataFrame, test_share: float = 0.2, seed: int = 0, file: str = "file") -> DataFrame:
    """Add ``split`` (train/test): a share of the distinct files, no file in both.

    A file is in the test split when its hash falls below the share, which
    needs no count of files, no sort and no shuffle; the share is met on
    average.
    """
    h = F.conv(F.substring(hash_order(seed, file), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(h < int(test_share * 2**32), "test").otherwise("train"))


def _ranked(df: DataFrame, group: list[str], order: Column, name: str) -> DataFrame:
    """1-based position within the group; groups may be of any size."""
    keyed = df.withColumns({"__o": order, "__one": F.lit(1).cast("long")})
    return running(keyed, group, ["__o"], {name: "__one"}, name="rank").drop("__o", "__one")


def replicate_to(df: DataFrame, n: int | Column, group: list[str], order: Column, upsample: bool = True, downsample: bool = True) -> DataFrame:
    """Bring every group to ``n`` rows: n div m copies of each, and the first n mod m by ``order`` once more.

    Ranks come from the ordered scan, as a class may hold most of the rows;
    counts from an aggregate with map-side combine.  Adds ``copy`` (0, 1, ...).
    """
    n = F.lit(n) if isinstance(n, int) else n
    counts = df.groupBy(*group).agg(F.count("*").alias("__m"))
    ranked = _ranked(df, group, order, "__k").join(counts, group).withColumn("__n", n)
    up = F.when(F.lit(upsample), F.floor(F.col("__n") / F.col("__m")) + (F.col("__k") <= F.col("__n") % F.col("__m")).cast("int")).otherwise(1)
    down = F.when(F.lit(downsample), (F.col("__k") <= F.col("__n")).cast("int")).otherwise(1)
    copies = F.when(F.col("__m") < F.col("__n"), up).otherwise(down).cast("int")
    out = ranked.withColumn("__c", copies).where("__c > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__c") - 1))).drop("__m", "__k", "__c", "__n")


def resample(df: DataFrame, keys: list[str], classes: list[str], n: int, n_negatives: int | None = None, upsample: bool = True, downsample: bool = True, seed: int = 0) -> DataFrame:
    """``n`` rows per class (rows of several classes appear once for each), negatives kept, resampled or dropped (0)."""
    kinds = F.array(*[F.when(F.col(c).cast("int") == 1, F.lit(c)) for c in classes])
    kinds = F.filter(kinds, lambda c: c.isNotNull())
    tagged = df.withColumn("resampled_class", F.explode_outer(kinds))
    positive = replicate_to(tagged.where("resampled_class is not null"), n, ["resampled_class"], hash_order(seed, "resampled_class", *keys), upsample, downsample)
    negative = tagged.where("resampled_class is null")
    if n_negatives is None:
        negative = negative.withColumn("copy", F.lit(0))
    elif n_negatives == 0:
        negative = negative.limit(0).withColumn("copy", F.lit(0))
    else:
        negative = replicate_to(negative.withColumn("__g", F.lit(0)), n_negatives, ["__g"], hash_order(seed, *keys)).drop("__g")
    return positive.unionByName(negative)


def upsample(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Every label as often as the most frequent one."""
    counts = df.groupBy(label).count()
    largest = counts.agg(F.max("count")).first()[0] or 0
    return replicate_to(df, int(largest), [label], hash_order(seed, *keys))


def class_aware_order(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Position of each row when classes take turns: round first, then class."""
    return _ranked(df, [label], hash_order(seed, *keys), "turn")


def weighted_order(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Weights 1 / class count and the exponential race key of a weighted draw without replacement."""
    n = df.groupBy(label).agg(F.count("*").alias("class_n"))
    u = (F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)
    return df.join(n, label).withColumn("weight", 1.0 / F.col("class_n")).withColumn("race", -F.log(u) / F.col("weight"))


def unlabelled(df: DataFrame, classes: list[str]) -> DataFrame:
    """Rows that say nothing of any of the classes."""
    none = F.lit(True)
    for c in classes:
        none = none & F.col(c).isNull()
    return df.where(none)


def split_exact(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``split``: of n rows exactly round(share * n) are test rows, the first in seeded order."""
    n = df.count()
    ranked = _ranked(df, [], hash_order(seed, *keys), "__k")
    return ranked.withColumn("split", F.when(F.col("__k") <= int(test_share * n + 0.5), "test").otherwise("train")).drop("__k")


def split_paired_files(files: DataFrame, ann: DataFrame, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Reviewed files (audio_file, annotation_file) and annotations with the split of their audio file; files without annotations keep theirs."""
    marked = split_by_file(files, test_share, seed, "audio_file")
    return marked, ann.join(marked.select("audio_file", "split").distinct(), "audio_file", "left")


def sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded order."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def batch_of(df: DataFrame, keys: list[str], batch_size: int) -> DataFrame:
    """Add the number of the batch that a row belongs to, in the order of the keys."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    placed = running(one, [], [F.col(k).asc() for k in keys], {"__k": "__one"}, name="batches")
    return placed.withColumn("batch", F.floor((F.col("__k") - 1) / batch_size)).drop("__k", "__one")


def weighted_draws(df: DataFrame, label: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement, every class as likely as any other and every row of a class as the next: (draw, label, keys).

    Draw i names a class and a place in it by hash; rows come by their place
    in seeded order.  Draws and rows meet by equality, nothing is collected
    but the list of classes.
    """
    ranked = class_aware_order(df, label, keys, seed)
    counts = sorted((r[0], r[1]) for r in df.groupBy(label).count().collect())
    spark = df.sparkSession
    part = lambda a, b: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(a), F.col("draw").cast("string"))), 1, b), 16, 10).cast("long")
    which = (part("class", 8) % len(counts)).cast("int")
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(m).alias("m")) for c, m in counts])
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("w", F.element_at(table, which + 1))
    draws = draws.select("draw", F.col("w.c").alias(label), (part("row", 12) % F.col("w.m") + 1).alias("turn"))
    return draws.join(ranked, [label, "turn"]).select("draw", label, *keys)


def class_turns(df: DataFrame, label: str, keys: list[str], per_turn: int = 1, seed: int = 0) -> DataFrame:
    """Order in which classes take turns, ``per_turn`` rows at a visit: adds ``visit``, whole-numbered from 0."""
    return class_aware_order(df, label, keys, seed).withColumn("visit", F.floor((F.col("turn") - 1) / per_turn)).drop("turn")
