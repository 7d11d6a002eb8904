"""Thresholds and evaluation metrics on long tables (key..., class, score, target).

Long form keeps the plan the same for three classes or ten thousand.  Ranking
metrics first count rows per (class, score), which combines map-side, and sum
them up in order by a scan that spreads a class over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldchirp.operators.rangescan import running


def argmax_one_hot(scores: Column) -> Column:
    """One-hot of the first maximum of an array."""
    at = F.array_position(scores, F.array_max(scores))
    return F.transform(scores, lambda _, i: (i + 1 == at).cast("int"))


def at_threshold(score: str, threshold: float | dict[str, float]) -> Column:
    """1 where score >= threshold (one for all classes, or by class)."""
    if isinstance(threshold, dict):
        t = F.element_at(F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv]), F.col("class"))
    else:
        t = F.lit(threshold)
    return (F.col(score) >= t).cast("int")


def confusion(df: DataFrame) -> DataFrame:
    """Counts per class: tp, fp, fn, tn; rows whose prediction or target is null are left out."""
    c = lambda cond: F.count_if(cond).alias
    p, t = F.col("pred") == 1, F.col("target") == 1
    return df.where("pred is not null and target is not null").groupBy("class").agg(c(p & t)("tp"), c(p & ~t)("fp"), c(~p & t)("fn"), c(~p & ~t)("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """Per class precision, recall, f1 (0 where undefined; null for a class without support), jaccard and support."""
    c = confusion(df)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    some = lambda v: F.when(tp + fn > 0, v)
    return c.select("class", some(p).alias("precision"), some(r).alias("recall"), some(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), _ratio(tp, tp + fp + fn).alias("jaccard"), (tp + fn).alias("support"))


def macro(df: DataFrame) -> DataFrame:
    """One row: macro precision, recall and f1 (zeros included), macro jaccard and Hamming loss."""
    c = confusion(df)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.agg(
        F.avg(_ratio(tp, tp + fp)).alias("precision"), F.avg(_ratio(tp, tp + fn)).alias("recall"), F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        F.avg(_ratio(tp, tp + fp + fn)).alias("jaccard"), (F.sum(fp + fn) / F.sum(tp + fp + fn + F.col("tn"))).alias("hamming"),
    )


def ranking(df: DataFrame) -> DataFrame:
    """Per class exact AUROC (ties count half) and average precision; null where undefined.

    Null targets and null or NaN scores are left out.
    """
    known = df.where("target is not null and score is not null and not isnan(score)")
    by = known.groupBy("class", "score").agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") != 1).alias("n"))
    # the ordered scan: a class may hold most of the distinct scores
    cum = running(by, ["class"], [F.col("score").desc()], {"cp": "p", "cn": "n"}, name="ranking")
    # every negative is below the positives already passed, and level with those of its own score
    steps = cum.withColumns({"won": F.col("n") * (F.col("cp") - F.col("p") / 2.0), "gain": F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))})
    s = steps.groupBy("class").agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum("won").alias("won"), F.sum("gain").alias("gain"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return s.select("class", F.when(both, F.col("won") / (F.col("P") * F.col("N"))).alias("au_roc"), F.when(F.col("P") > 0, F.col("gain") / F.col("P")).alias("avg_precision"), F.col("P").alias("support"))


def binned_auroc(df: DataFrame, bins: int = 50) -> DataFrame:
    """AUROC from ``bins`` thresholds evenly spread over [0, 1], by trapezoids: one pass, bounded state."""
    known = df.where("target is not null and score is not null and not isnan(score)")
    step = 1.0 / (bins - 1)
    bucket = F.least(F.greatest(F.floor(F.round(F.col("score") / step, 9)), F.lit(-1)), F.lit(bins - 1)).cast("int")
    by = known.groupBy("class", bucket.alias("b")).agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") != 1).alias("n"))
    w = Window.partitionBy("class").orderBy(F.col("b").desc())
    cum = by.withColumn("cp", F.sum("p").over(w))
    s = cum.groupBy("class").agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2.0)).alias("won"))
    return s.select("class", F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("won") / (F.col("P") * F.col("N"))).alias("au_roc_binned"))


def single_target(df: DataFrame) -> DataFrame:
    """One row for tables of exactly one true and one predicted class index (target, pred): precision, recall, f1 of class 1, macro jaccard over the classes seen, Hamming loss."""
    pairs = df.where("target is not null and pred is not null").groupBy("target", "pred").agg(F.count("*").alias("n"))
    seen = pairs.select(F.col("target").alias("c"), "target", "pred", "n").unionByName(pairs.where("pred <> target").select(F.col("pred").alias("c"), "target", "pred", "n"))
    per = seen.groupBy("c").agg(F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("any"), F.sum(F.when(F.col("pred") == F.col("c"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("target") == F.col("c"), F.col("n")).otherwise(0)).alias("t"))
    one = lambda c: F.coalesce(F.sum(F.when(F.col("c") == 1, F.col(c))), F.lit(0))
    return per.agg(
        _ratio(one("tp"), one("p")).alias("precision"), _ratio(one("tp"), one("t")).alias("recall"), _ratio(2 * one("tp"), one("p") + one("t")).alias("f1"),
        F.avg(F.col("tp") / F.col("any")).alias("jaccard"), (1 - F.sum("tp") / F.sum("t")).alias("error_rate"),
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """(target, pred, n) over the classes observed."""
    return df.where("target is not null and pred is not null").groupBy("target", "pred").agg(F.count("*").alias("n"))


def binned_average_precision(df: DataFrame, bins: int = 50) -> DataFrame:
    """Average precision from ``bins`` thresholds evenly spread over [0, 1]: one pass, bounded state."""
    known = df.where("target is not null and score is not null and not isnan(score)")
    step = 1.0 / (bins - 1)
    bucket = F.least(F.greatest(F.floor(F.round(F.col("score") / step, 9)), F.lit(-1)), F.lit(bins - 1)).cast("int")
    by = known.groupBy("class", bucket.alias("b")).agg(F.count_if(F.col("target") == 1).alias("p"), F.count("*").alias("a"))
    w = Window.partitionBy("class").orderBy(F.col("b").desc())  # at most bins + 1 rows a class
    cum = by.withColumns({"cp": F.sum("p").over(w), "ca": F.sum("a").over(w)}).where("b >= 0")
    found = cum.groupBy("class").agg(F.sum(F.col("p") * F.col("cp") / F.col("ca")).alias("gain"))
    total = known.groupBy("class").agg(F.count_if(F.col("target") == 1).alias("P"))
    return total.join(found, "class", "left").select("class", F.when(F.col("P") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("P")).alias("ap_binned"))


def evaluate(scores: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Ranking metrics of scores (keys, class, score) against labels (keys, class, target); ``ValueError`` unless both hold the same keys and classes."""
    by = [*keys, "class"]
    if not scores.select(*by).exceptAll(labels.select(*by)).isEmpty() or not labels.select(*by).exceptAll(scores.select(*by)).isEmpty():
        raise ValueError("scores and labels don't have the same keys")
    return ranking(scores.join(labels, by))
