"""Embedding store: recordings, deployments and windows as tables, with search and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldchirp.functions.keys import clean_key
from fieldchirp.session import shuffle_partitions

WINDOW_KEY = ["file", "start_time", "end_time"]


def normal_windows(df: DataFrame, digits: int = 6) -> DataFrame:
    """Windows by their join key: cleaned path, times rounded."""
    return df.withColumns({"file": clean_key("file"), "start_time": F.round("start_time", digits), "end_time": F.round("end_time", digits)})


def missing_windows(clips: DataFrame, existing: DataFrame, mode: str = "skip") -> DataFrame:
    """Clips to embed.  skip: those not in the store; error: raise if any is; add: all."""
    a, b = normal_windows(clips), normal_windows(existing).select(*WINDOW_KEY)
    if mode == "add":
        return a
    if mode == "skip":
        return a.join(b, WINDOW_KEY, "left_anti")
    if mode == "error":
        if not a.join(b, WINDOW_KEY, "left_semi").isEmpty():
            raise ValueError("some windows are already in the store")
        return a
    raise ValueError("mode must be skip, error or add")


def match_windows(clips: DataFrame, windows: DataFrame, first: bool = False) -> DataFrame:
    """Ids of the stored windows of each clip, ascending (an empty list if none), or the first id."""
    hit = normal_windows(windows).groupBy(*WINDOW_KEY).agg(F.array_sort(F.collect_list("window_id")).alias("window_ids"))
    out = normal_windows(clips).join(hit, WINDOW_KEY, "left").withColumn("window_ids", F.coalesce("window_ids", F.array().cast("array<bigint>")))
    return out.withColumn("window_id", F.try_element_at("window_ids", F.lit(1))).drop("window_ids") if first else out


def first_windows(windows: DataFrame) -> DataFrame:
    """Drop repeated windows, keeping the smallest id per key; aggregate, not window, so it combines map-side."""
    rest = [c for c in windows.columns if c not in WINDOW_KEY]
    return normal_windows(windows).groupBy(*WINDOW_KEY).agg(F.min_by(F.struct(*rest), "window_id").alias("r")).select(*WINDOW_KEY, "r.*")


def random_match(clips: DataFrame, windows: DataFrame, seed: int = 0) -> DataFrame:
    """One stored window of each clip, chosen by a keyed hash; null where the store has none."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("window_id").cast("string")))
    hit = normal_windows(windows).groupBy(*WINDOW_KEY).agg(F.min_by("window_id", order).alias("window_id"))
    return normal_windows(clips).join(hit, WINDOW_KEY, "left")


def stratified_selection(
    scores: DataFrame, k: int | None = 5, strategy: str = "top_k", strata: tuple[str, ...] = (), by_day: bool = False, date_ranges: list[tuple[str, str]] | None = None,
    min_score: float | None = None, max_score: float | None = None, seed: int = 0,
) -> DataFrame:
    """Select in every stratum at once: by columns, by day of ``recorded_at``, or by date ranges (both days in; ranges may overlap).

    Adds ``date_range``: the day, the range, or null.
    """
    if by_day and date_ranges:
        raise ValueError("give days or date ranges")
    day = F.to_date("recorded_at")
    if by_day:
        rows = scores.where(day.isNotNull()).withColumn("date_range", day.cast("string"))
    elif date_ranges:
        inside = [F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(f"{a}/{b}")) for a, b in date_ranges]
        rows = scores.withColumn("date_range", F.explode(F.array_compact(F.array(*inside))))
    else:
        rows = scores.withColumn("date_range", F.lit(None).cast("string"))
    return select_windows(rows, k, strategy, min_score, max_score, (*strata, "date_range"), seed)


def clip_values(v: Column, limit: float) -> Column:
    """Embedding values clamped to what the stored type holds."""
    return F.transform(v, lambda x: F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)))


def filter_windows(
    windows: DataFrame, date_range: tuple[str, str] | None = None, time_range: tuple[str, str] | None = None, deployments: list | None = None, projects: list | None = None, recordings: list | None = None,
    windows_filter: Column | str | None = None, annotated: DataFrame | None = None,
) -> DataFrame:
    """Windows joined with their recordings (recorded_at, deployment_id, project, file), filtered.

    Dates count whole days, both ends in; times of day both ends in, without
    wrapping midnight.  A null recorded_at passes no date or time filter.
    ``windows_filter`` is any condition on the columns; ``annotated`` keeps the
    windows that an annotation (audio_file, start_time, end_time) overlaps.
    """
    out = windows if windows_filter is None else windows.where(windows_filter)
    if annotated is not None:
        from fieldchirp.operators.annotations import clip_matches

        hit = clip_matches(out, annotated.withColumn("annotation", F.lit("any")), 0.0)
        out = out.join(hit.select(*WINDOW_KEY).distinct(), WINDOW_KEY, "left_semi")
    if date_range:
        day = F.to_date("recorded_at")
        out = out.where(day.between(F.lit(date_range[0]).cast("date"), F.lit(date_range[1]).cast("date")))
    if time_range:
        out = out.where(F.date_format("recorded_at", "HH:mm:ss").between(*time_range))
    for col, vals in (("deployment_id", deployments), ("project", projects), ("file", recordings)):
        if vals is not None:
            out = out.where(F.col(col).isin(list(vals)))
    return out


def dot(a: Column, b: Column) -> Column:
    """Dot product in array order, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity_search(windows: DataFrame, query: list[float], k: int = 5, target_score: float | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` windows with the largest dot product (or nearest to ``target_score``); ties by id."""
    scored = windows.withColumn("score", F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), digits))
    key = F.col("score").desc() if target_score is None else F.abs(F.col("score") - F.lit(target_score)).asc()
    return scored.orderBy(key, "window_id").limit(k).select("window_id", "score")


def similarity_many(windows: DataFrame, queries: list[tuple[int, list[float]]], k: int = 5, digits: int = 6, block: int = 64) -> DataFrame:
    """Top ``k`` per query: query vectors go along as literals, so windows are scanned once and never shuffled whole.

    The scan keeps the best ``k`` per query within each partition before the
    exchange (the rank filter is pushed below it).  Queries are a bounded
    list given by the caller and handled ``block`` at a time.
    """
    out = None
    for at in range(0, len(queries), block):
        part = queries[at : at + block]
        scores = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), digits).alias("score")) for i, q in part])
        long = windows.select("window_id", F.inline(scores))
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "window_id")
        best = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def _best_in_block(queries: pd.DataFrame, windows: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """The ``k`` best of these windows for each of these queries."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "window_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if queries.empty or windows.empty:
        return none
    stack = lambda v: np.stack([np.asarray(x, dtype=np.float64) for x in v])
    ids, scale, out = windows["window_id"].to_numpy(), 10.0**digits, []
    for query, s in zip(queries["query_id"], stack(queries["vector"]) @ stack(windows["vector"]).T, strict=True):
        s = np.trunc(s * scale + np.copysign(0.5, s)) / scale
        best = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
        best = best[np.lexsort((ids[best], -s[best]))][:k]
        out.append(pd.DataFrame({"query_id": query, "window_id": ids[best], "score": s[best]}))
    return pd.concat(out)


def similarity_join(windows: DataFrame, queries: DataFrame, k: int = 5, digits: int = 6, block: int = 256, rows: int = 20_000) -> DataFrame:
    """Top ``k`` windows of every row of ``queries`` (query_id, vector), however many: query_id, window_id, score, rank; ties by id.

    Every query meets every window: tasks hold some ``block`` queries and
    ``rows`` windows and keep the best ``k`` a query, which are merged
    afterwards.  Neither table comes to the driver; the work grows with the
    product of both.  Null vectors and those that hold null or NaN have no score.
    """
    sound = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    whole = lambda c: F.transform(c, lambda x: x.cast("double"))
    a = queries.select("query_id", whole("vector").alias("vector")).where(sound(F.col("vector")))
    b = windows.select("window_id", whole("embedding").alias("vector")).where(sound(F.col("vector")))
    p, q = 1 + a.count() // block, max(1 + b.count() // rows, shuffle_partitions(windows.sparkSession))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = a.select("query_id", "vector", part("query_id", p).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("q"))
    b = b.select("window_id", "vector", part("window_id", q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("p"))
    best = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(lambda x, y: _best_in_block(x, y, k, digits), "query_id long, window_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "window_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def class_scores(windows: DataFrame, weights: dict[str, list[float]], bias: dict[str, float] | None = None, digits: int = 6) -> DataFrame:
    """Linear classifier over embeddings, long: (window columns but the embedding, class, score)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in w])) + F.lit(float((bias or {}).get(c, 0.0))), digits).alias("score")) for c, w in weights.items()])
    return windows.select(*[c for c in windows.columns if c != "embedding"], F.inline(pairs))


def in_range(min_score: float | None, max_score: float | None) -> Column:
    ok = F.col("score").isNotNull()
    if min_score is not None:
        ok = ok & (F.col("score") >= min_score)
    if max_score is not None:
        ok = ok & (F.col("score") <= max_score)
    return ok


def select_windows(scores: DataFrame, k: int | None = 5, strategy: str = "top_k", min_score: float | None = None, max_score: float | None = None, strata: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """Per class (and stratum) the ``k`` highest, ``k`` random or all windows with min <= score <= max; ties by id."""
    ok = scores.where(in_range(min_score, max_score))
    if strategy == "all":
        return ok
    order = {"top_k": [F.col("score").desc(), F.col("window_id").asc()], "random_k": [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("class"), F.col("window_id").cast("string")))]}[strategy]
    w = Window.partitionBy("class", *strata).orderBy(*order)
    # the rank filter becomes a per-partition limit below the exchange, so no group travels whole
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def count_in_bins(scores: DataFrame, bins: list[tuple[float, float]]) -> DataFrame:
    """Windows per class and half-open bin [low, high); bins may overlap; empty ones count 0."""
    per = scores.groupBy("class").agg(*[F.count_if((F.col("score") >= lo) & (F.col("score") < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bins)])
    rows = F.array(*[F.struct(F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.col(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(bins)])
    return per.select("class", F.inline(rows))


def merge_labels(old: DataFrame, new: DataFrame, classes: list[str], mode: str = "skip") -> DataFrame:
    """Merge two label tables.  skip: old values win, new fill nulls and add keys; add: both; error: raise on common keys."""
    if mode == "add":
        return old.unionByName(new, allowMissingColumns=True)
    if mode == "error":
        if not old.join(new, WINDOW_KEY, "left_semi").isEmpty():
            raise ValueError("some clips are already in the dataset")
        return old.unionByName(new, allowMissingColumns=True)
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, WINDOW_KEY, "full").select(*WINDOW_KEY, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in classes])


def mlp_forward(layers: list[tuple[list[list[float]], list[float]]]):
    """Pandas UDF of a ReLU network over an embedding column: array<double> of logits."""
    @pandas_udf("array<double>")
    def forward(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        h = np.stack([np.asarray(v, dtype=np.float64) for v in x])
        for i, (w, b) in enumerate(layers):
            h = h @ np.asarray(w).T + np.asarray(b)
            if i + 1 < len(layers):
                h = np.maximum(h, 0)
        return pd.Series(list(h))

    return forward
