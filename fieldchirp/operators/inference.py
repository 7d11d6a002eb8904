"""Samples to scores: clips, preprocessing, a scorer, an activation, one table by clip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.functions import dsp, losses, signal
from fieldchirp.operators import metrics
from fieldchirp.operators.pipeline import Pipeline, Step, fit_length, on_samples, random_gain, random_wrap, time_mask

KEY = ("file", "start_time", "end_time")
ACTIVATIONS: dict[str | None, Callable[[Column], Column]] = {
    None: lambda x: x, "sigmoid": lambda x: F.transform(x, losses.sigmoid), "softmax": losses.softmax, "softmax_and_logit": losses.softmax_and_logit,
}


def audio_preset(n: int, low: float | None = None, high: float | None = None, rate: float = 1.0) -> Pipeline:
    """Cut to length, augment (wrap, gain, mask), filter if there is a band."""
    steps = [Step("fit_length", fit_length(n)), Step("wrap", random_wrap(), augments=True), Step("gain", random_gain(), augments=True), Step("time_mask", time_mask(), augments=True)]
    if low is not None or high is not None:
        design = dsp.Butterworth(5, low, high, rate)
        steps.append(Step("bandpass", on_samples(dsp.per_array(lambda x: dsp.zero_phase(x, design)))))
    return Pipeline(tuple(steps))


def spectrogram_preset(n: int, window: int, rows: tuple[int, int] | None = None, low_db: float = -80.0, high_db: float = 0.0, pcen: bool = False) -> Pipeline:
    """As ``audio_preset``, then a spectrogram in decibels (or energy-normalised), cut to rows, scaled from 0 to 1 and laid out row after row."""

    def image(x):
        p = dsp.power_spectrogram(x, window)
        p = p[rows[0] : rows[1]] if rows else p
        if pcen:
            return dsp.pcen(p).ravel()
        db = 10 * dsp.np.log10(p + 1e-10)
        return ((dsp.np.clip(db, low_db, high_db) - low_db) / (high_db - low_db)).ravel()

    return audio_preset(n).insert(Step("image", on_samples(dsp.per_array(image))))


def predict(clips: DataFrame, pipeline: Pipeline, scorer: Callable[[Column], Column], classes: list[str], activation: str | None = None, augment: bool = False) -> DataFrame:
    """(file, start_time, end_time, one column per class) of clips with samples; a clip that gave no samples or no scores has nulls.

    ``scorer`` takes the preprocessed samples to an array of logits, one per
    class: an expression or an Arrow UDF, such as ``store.mlp_forward``.
    """
    ready = pipeline.forward(clips, augment=augment)
    logits = F.when(F.col("samples").isNotNull() & (F.size("samples") > 0), scorer(F.col("samples")))
    scored = ready.select(*KEY, logits.alias("__x")).withColumn("__y", F.when(F.col("__x").isNotNull(), ACTIVATIONS[activation](F.col("__x"))))
    return scored.select(*KEY, *[F.get("__y", F.lit(i)).alias(c) for i, c in enumerate(classes)])


def embed(clips: DataFrame, pipeline: Pipeline, layer: Callable[[Column], Column]) -> DataFrame:
    """(file, start_time, end_time, embedding) of clips; null where preprocessing gave nothing."""
    ready = pipeline.forward(clips, augment=False)
    return ready.select(*KEY, F.when(F.col("samples").isNotNull() & (F.size("samples") > 0), layer(F.col("samples"))).alias("embedding"))


def invalid_samples(scores: DataFrame, classes: list[str]) -> DataFrame:
    """Clips that got no scores."""
    none = F.lit(True)
    for c in classes:
        none = none & F.col(c).isNull()
    return scores.where(none).select(*KEY)


def run_evaluation(scores: DataFrame, labels: DataFrame, classes: list[str], bins: int | None = None) -> DataFrame:
    """Ranking metrics per class of wide scores in [0, 1] against wide labels, exact or (``bins``) from evenly spread thresholds; clips without scores are left out."""
    long = lambda df, v: df.select(*KEY, F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("double").alias(v)) for c in classes])))
    both = long(scores, "score").where("score is not null").join(long(labels, "target"), [*KEY, "class"])
    if bins is None:
        return metrics.ranking(both)
    return metrics.binned_auroc(both, bins).join(metrics.binned_average_precision(both, bins), "class")


def level(x: Column) -> Column:
    """A one-number scorer for tests: the level of the samples."""
    return F.array(signal.rms(x))
