"""Clip grids: tables of fixed-length windows over recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = (None, "remainder", "full", "extend")


def clip_step_of(clip_duration: float, clip_overlap: float | None = None, overlap_fraction: float | None = None, clip_step: float | None = None) -> float:
    """Step between clip starts; at most one way of giving it may be used."""
    given = [v for v in (clip_overlap, overlap_fraction, clip_step) if v is not None]
    if len(given) > 1:
        raise ValueError("give at most one of clip_overlap, overlap_fraction and clip_step")
    if clip_overlap is not None:
        step = clip_duration - clip_overlap
    elif overlap_fraction is not None:
        step = clip_duration * (1 - overlap_fraction)
    else:
        step = clip_duration if clip_step is None else clip_step
    if step <= 0:
        raise ValueError("clips must advance")
    return step


def clip_grid(
    files: DataFrame, clip_duration: float, clip_overlap: float | None = None, overlap_fraction: float | None = None, clip_step: float | None = None, final_clip: str | None = "extend", digits: int = 10
) -> DataFrame:
    """Clips (file, start_time, end_time and the other columns) of every file with a duration.

    final_clip: None drops clips that reach past the end, ``remainder`` cuts
    them, ``full`` moves them back to end at the end (not before 0),
    ``extend`` keeps them.  Equal clips appear once.  A null, NaN or
    non-positive duration gives no clips; see ``invalid_files``.
    """
    if final_clip not in FINAL:
        raise ValueError(f"final_clip must be one of {FINAL}")
    step = clip_step_of(clip_duration, clip_overlap, overlap_fraction, clip_step)
    grid = step_counts(files, step)
    grid = grid.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    if final_clip != "full":
        return timed_clips(grid, clip_duration, step, final_clip, digits).drop("__i", "duration")
    grid = timed_clips(grid, clip_duration, step, "extend", digits)
    back = F.greatest(F.round(F.col("duration") - F.lit(clip_duration), digits), F.lit(0.0))
    moved = F.when(F.col("end_time") > F.col("duration"), back).otherwise(F.col("start_time"))
    grid = grid.withColumn("start_time", moved).withColumn("end_time", F.round(F.col("start_time") + F.lit(clip_duration), digits))
    # Only the clips moved back can equal another one.
    return grid.drop("__i", "duration").dropDuplicates(["file", "start_time", "end_time"])


def step_counts(files: DataFrame, step: float) -> DataFrame:
    """The files with a duration and ``__n``, the number of steps that begin in it."""
    known = files.where(F.col("duration").isNotNull() & ~F.isnan("duration") & (F.col("duration") > 0))
    return known.withColumn("__n", F.ceil(F.col("duration") / F.lit(step)))


def timed_clips(grid: DataFrame, clip_duration: float, step: float, final_clip: str | None, digits: int = 10) -> DataFrame:
    """Times of the clips numbered ``__i``, without those that ``final_clip`` (not ``full``) leaves out."""
    # Whole numbers are their own rounding, which is the dearest part of a grid.
    whole = digits >= 0 and float(step).is_integer() and float(clip_duration).is_integer()
    near = (lambda c: c) if whole else (lambda c: F.round(c, digits))
    start = near(F.col("__i") * F.lit(step))
    grid = grid.withColumns({"start_time": start, "end_time": near(start + F.lit(clip_duration))}).where("start_time < duration")
    if final_clip is None:
        return grid.where(~(F.col("end_time") > F.col("duration")))
    return grid.withColumn("end_time", F.least("end_time", "duration")) if final_clip == "remainder" else grid


def first_per_file(files: DataFrame, order: str) -> DataFrame:
    """One row per file, the first by ``order``."""
    rest = [c for c in files.columns if c != "file"]
    return files.groupBy("file").agg(F.min_by(F.struct(*rest), order).alias("r")).select("file", "r.*")


def invalid_files(files: DataFrame) -> DataFrame:
    """Files whose duration couldn't be read: one row each, null start and end."""
    bad = F.col("duration").isNull() | F.isnan("duration") | (F.col("duration") <= 0)
    null = F.lit(None).cast("double")
    return files.where(bad).select("file", null.alias("start_time"), null.alias("end_time")).distinct()


def sample_rows(clips: DataFrame, audio_root: str | None = None, digits: int = 10) -> DataFrame:
    """Clips as pipeline samples: source path, start, duration."""
    path = F.col("file") if audio_root is None else F.concat(F.lit(audio_root.rstrip("/") + "/"), F.col("file"))
    return clips.select(path.alias("source"), "start_time", F.round(F.col("end_time") - F.col("start_time"), digits).alias("duration"), *[c for c in clips.columns if c not in ("file", "start_time", "end_time")])


def split_samples(df: DataFrame, rate: int, clip_duration: float, pad: bool = False, samples: str = "samples", **grid) -> DataFrame:
    """Clips of sample arrays: the rows with start_time, end_time and the clip's samples, filled with silence at the end if ``pad``."""
    timed = df.where(F.col(samples).isNotNull()).withColumns({"file": F.monotonically_increasing_id(), "duration": F.size(samples) / F.lit(float(rate))})
    cut = clip_grid(timed, clip_duration, **grid)
    a, b = (F.floor(F.round(F.col(c) * rate, 6)).cast("int") for c in ("start_time", "end_time"))
    part = F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))
    if pad:
        part = F.concat(part, F.array_repeat(F.lit(0.0), F.greatest(b - a - F.size(part), F.lit(0))))
    return cut.withColumn(samples, part).drop("file")


def apply_to_clips(df: DataFrame, f, rate: int, clip_duration: float, name: str = "result", samples: str = "samples", **grid) -> DataFrame:
    """A column function of every clip's samples, with the clip's times."""
    return split_samples(df, rate, clip_duration, samples=samples, **grid).withColumn(name, f(F.col(samples))).drop(samples)


def ingest_samples(samples: DataFrame | list[str], spark=None, durations: DataFrame | None = None, clip_duration: float | None = None, **grid) -> DataFrame:
    """Samples however given as (file, start_time, end_time, labels...): a list of files, a table of files, or a table of clips.

    Files without times are cut into clips by the grid (``durations``: file,
    duration) or, without a clip duration, stand whole with null times.
    """
    df = spark.createDataFrame([(f,) for f in samples], "file string") if isinstance(samples, list) else samples
    if "file" not in df.columns:
        raise ValueError("samples need a column file")
    if {"start_time", "end_time"} <= set(df.columns):
        return df.select("file", "start_time", "end_time", *[c for c in df.columns if c not in ("file", "start_time", "end_time")])
    rest = [c for c in df.columns if c != "file"]
    if clip_duration is None:
        null = F.lit(None).cast("double")
        return df.select("file", null.alias("start_time"), null.alias("end_time"), *rest)
    if durations is None:
        raise ValueError("clips need the durations of the files")
    return clip_grid(df.join(durations, "file", "left"), clip_duration, **grid).select("file", "start_time", "end_time", *rest)


def check_labels(df: DataFrame, classes: list[str], keys: tuple[str, ...] = ("file", "start_time", "end_time")) -> DataFrame:
    """The table, if its label columns are the classes in order and all labels lie within 0 and 1 (null is unknown); else ``ValueError``."""
    have = [c for c in df.columns if c not in keys]
    if have != list(classes):
        raise ValueError(f"label columns {have} are not the classes {list(classes)}")
    off = [F.count_if((F.col(c).cast("double") < 0) | (F.col(c).cast("double") > 1)).alias(c) for c in classes]
    bad = {c: n for c, n in df.agg(*off).first().asDict().items() if n} if classes else {}
    if bad:
        raise ValueError(f"labels outside 0 to 1: {bad}")
    return df


def without_foreign_classes(df: DataFrame, classes: list[str], keys: tuple[str, ...] = ("file", "start_time", "end_time")) -> DataFrame:
    """The keys alone where the label columns differ from the classes, else the table as it is."""
    return df if [c for c in df.columns if c not in keys] == list(classes) else df.select(*keys)
