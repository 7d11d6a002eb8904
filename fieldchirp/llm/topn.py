"""Problem 1: the N best items of every group, with one choice among ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldchirp.functions.keys import clean_key, nan_to_null
from fieldchirp.operators.rangescan import running


def top_n(df: DataFrame, group: list[str], order: list, n: int, rank: str = "top_rank", partitions: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, with their position.

    The rows are range-partitioned and sorted on (group, order); counts per
    group and partition are prefix-summed into exact positions.  A group with
    millions of rows is spread over several partitions, each of which keeps no
    more than ``n`` of its rows before anything is written.  ``order`` must end
    in a unique column for one result among ties.  Null groups form one group;
    a group with fewer rows than ``n`` returns all it has; an empty table
    returns none.
    """
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    ranked = running(counted, group, order, {"__pos": "__one"}, keep_below=("__pos", n), partitions=partitions, name="topn")
    return ranked.withColumn(rank, F.col("__pos").cast("int")).drop("__one", "__pos")


def best_windows(preds: DataFrame, n: int = 5, partitions: int | None = None) -> DataFrame:
    """The ``n`` highest-scoring windows of every recording: file, pred_id, test_species, start_time, top_rank.

    Rows with the same file key and start_time are one window, represented by
    the smallest pred_id and its score.  Null and NaN scores don't rank; rows
    without file belong to no group and don't rank either; a null start_time
    is no position, so such rows are windows of their own and come last among
    equal scores.  Other columns of ``preds`` are ignored.
    """
    rows = preds.select(
        clean_key("file").alias("file"), F.col("start_time").cast("double").alias("start_time"), F.col("pred_id").cast("long").alias("pred_id"), nan_to_null("test_species").alias("score")
    ).where("file is not null")
    own = F.when(F.col("start_time").isNull(), F.col("pred_id"))
    # Partial aggregation before the shuffle; (file, start_time) spreads a hot file over all partitions.
    windows = rows.groupBy("file", "start_time", own.alias("own")).agg(F.min_by("score", "pred_id").alias("score"), F.min("pred_id").alias("pred_id"))
    ranked = windows.where("score is not null").select("file", "score", "start_time", "pred_id")
    order = [F.col("score").desc(), F.col("start_time").asc_nulls_last(), F.col("pred_id").asc()]
    return top_n(ranked, ["file"], order, n, partitions=partitions).withColumnRenamed("score", "test_species")
