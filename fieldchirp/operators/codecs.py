"""Label encodings: multi-hot columns, names and indices, all as column expressions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def categorical_to_multi_hot(labels: Column, classes: list[str]) -> Column:
    """Array of 0/1 per class; names outside ``classes`` are ignored, null gives all 0."""
    return F.array(*[F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int") for c in classes])


def integer_to_multi_hot(labels: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_contains(labels, i), F.lit(False)).cast("int"))


def multi_hot_to_integers(hot: Column) -> Column:
    return F.filter(F.transform(hot, lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())


def multi_hot_to_categorical(hot: Column, classes: list[str]) -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(multi_hot_to_integers(hot), lambda i: F.element_at(names, i + 1))


def categorical_to_integers(labels: Column, classes: list[str]) -> Column:
    """Indices of names; a name that isn't a class raises when the row is read."""
    index = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    return F.transform(labels, lambda c: F.coalesce(F.try_element_at(index, c), F.raise_error(F.concat(F.lit("unknown class "), c)).cast("int")))


def integers_to_categorical(labels: Column, classes: list[str]) -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(labels, lambda i: F.element_at(names, i + 1))


def melt(df: DataFrame, keys: list[str], classes: list[str], value: str = "value") -> DataFrame:
    """Wide class columns to long (keys, class, value): the sparse form when zeros are dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("double").alias(value)) for c in classes])
    return df.select(*keys, F.inline(pairs))


def spread(df: DataFrame, keys: list[str], classes: list[str], value: str = "value") -> DataFrame:
    """Long to wide with a stable schema."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("class") == c, F.col(value))).alias(c) for c in classes])


def class_table(df: DataFrame, label: str, order: str) -> DataFrame:
    """Classes in the order they are first seen: (class_index, class).  One row a class, so the rank's single task is as small as their list."""
    first = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.min(order).alias("__first"))
    rank = F.row_number().over(Window.orderBy("__first", "class")) - 1
    return first.select(rank.cast("int").alias("class_index"), "class")
