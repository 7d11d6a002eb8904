"""Annotation tables: boxes in time and frequency with a label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.functions.keys import clean_key, nan_to_null
from fieldchirp.operators.clips import FINAL, clip_grid, clip_step_of, step_counts, timed_clips
from fieldchirp.session import shuffle_partitions

STANDARD = ("audio_file", "annotation_file", "annotation", "start_time", "end_time", "low_f", "high_f")
MATCH = ("file", "start_time", "end_time", "annotation", "ann_start", "ann_end", "overlap")
BLOCK = 64  # clips of a grid that are shuffled as one row


def annotation_table(df: DataFrame) -> DataFrame:
    """The seven standard columns (null where missing, NaN as null) and whatever else there is."""
    missing = [c for c in ("annotation", "start_time", "end_time") if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    for c in STANDARD:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if "file" in c else "double"))
    num = {c: nan_to_null(F.col(c).cast("double")) for c in STANDARD[3:]}
    return df.withColumns(num | {"audio_file": clean_key("audio_file")})


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two ranges share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the length of the first range; null for a range without length."""
    return F.when(a1 > a0, overlap(a0, a1, b0, b1) / (a1 - a0))


def subset(df: DataFrame, classes: list[str | None]) -> DataFrame:
    """Rows whose label is one of ``classes``; None stands for unlabelled rows."""
    named = [c for c in classes if c is not None]
    keep = F.col("annotation").isin(named) if named else F.lit(False)
    return df.where(keep | F.col("annotation").isNull() if None in classes else keep)


def _edges(df: DataFrame, lo: str, hi: str, t0: float, t1: float, edge_mode: str) -> DataFrame:
    if edge_mode == "trim":
        return df.withColumns({lo: F.greatest(F.col(lo), F.lit(t0)), hi: F.least(F.col(hi), F.lit(t1))})
    if edge_mode == "remove":
        return df.where((F.col(lo) >= t0) & (F.col(hi) <= t1))
    if edge_mode == "keep":
        return df
    raise ValueError("edge_mode must be trim, remove or keep")


def trim(df: DataFrame, start: float, end: float, edge_mode: str = "trim") -> DataFrame:
    """Annotations within [start, end), re-based to ``start``; an end equal to ``start`` still counts."""
    inside = df.where((F.col("end_time") >= start) & (F.col("start_time") < end))
    cut = _edges(inside, "start_time", "end_time", float(start), float(end), edge_mode)
    return cut.withColumns({c: F.col(c) - F.lit(float(start)) for c in ("start_time", "end_time")})


def bandpass(df: DataFrame, low: float, high: float, edge_mode: str = "trim") -> DataFrame:
    """Annotations whose band overlaps (low, high); a band that touches only, or is null, is out."""
    inside = df.where(F.least(F.col("high_f"), F.lit(float(high))) - F.greatest(F.col("low_f"), F.lit(float(low))) > 0)
    inside = inside.where("low_f is not null and high_f is not null")
    return _edges(inside, "low_f", "high_f", float(low), float(high), edge_mode)


def unique_labels(df: DataFrame, order: str) -> DataFrame:
    """Distinct labels with the position (``order``) at which each is first seen."""
    return df.where("annotation is not null").groupBy("annotation").agg(F.min(order).alias("first_seen"))


def global_multi_hot(df: DataFrame, classes: list[str]) -> DataFrame:
    """One row: does the class occur anywhere?"""
    return df.agg(*[F.coalesce(F.max((F.col("annotation") == c).cast("int")), F.lit(0)).alias(c) for c in classes])


def convert_labels(df: DataFrame, conversion: dict[str, str]) -> DataFrame:
    """Rename labels; those not listed stay.  A name may not be both old and new."""
    both = set(conversion) & set(conversion.values())
    if both:
        raise ValueError(f"both converted and converted to: {sorted(both)}")
    if not conversion:
        return df
    names = F.create_map(*[F.lit(x) for kv in conversion.items() for x in kv])
    return df.withColumn("annotation", F.coalesce(F.try_element_at(names, F.col("annotation")), F.col("annotation")))


def concat(tables: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def clip_matches(clips: DataFrame, ann: DataFrame, min_overlap: float, min_fraction: float | None = None, bucket_s: float = 60.0) -> DataFrame:
    """Clips (file, start_time, end_time) with the labels that overlap them enough.

    The join is an equality on (file, bucket of time) with the range as
    residual, so a long recording is spread over its buckets and meets only
    what is near in time.  A match is reported in the first bucket that the
    two share.  Columns: file, start_time, end_time, annotation, ann_start,
    ann_end, overlap.  Null labels, files and times and annotations without
    length match nothing.  Neither side is broadcast: their sizes as Spark
    estimates them don't count what ``explode`` adds.
    """
    b = lambda c: F.floor(c / F.lit(bucket_s)).cast("long")
    left = clips.select("file", "start_time", "end_time").where("file is not null and end_time > start_time")
    left = left.withColumn("b0", b(F.col("start_time"))).withColumn("bucket", F.explode(F.sequence("b0", b(F.col("end_time")))))
    right = _spans(ann)
    right = right.withColumn("a0", b(F.col("ann_start"))).withColumn("bucket", F.explode(F.sequence("a0", b(F.col("ann_end")))))
    met = left.join(right.hint("merge"), ["file", "bucket"]).where(F.col("bucket") == F.greatest("b0", "a0"))
    return _enough(met, min_overlap, min_fraction).select(*MATCH)


def _spans(ann: DataFrame) -> DataFrame:
    """The annotations that can match a clip: file, annotation, ann_start, ann_end."""
    return ann.where("audio_file is not null and annotation is not null and end_time > start_time").select(
        F.col("audio_file").alias("file"), "annotation", F.col("start_time").alias("ann_start"), F.col("end_time").alias("ann_end")
    )


def _enough(met: DataFrame, min_overlap: float, min_fraction: float | None) -> DataFrame:
    """The pairs of clip and annotation that overlap enough, with ``overlap``."""
    share = overlap(F.col("start_time"), F.col("end_time"), F.col("ann_start"), F.col("ann_end"))
    enough = F.col("overlap") >= min_overlap
    if min_fraction is not None:
        enough = enough | (F.col("overlap") / (F.col("ann_end") - F.col("ann_start")) >= min_fraction)
    met = met.where((F.col("start_time") < F.col("ann_end")) & (F.col("end_time") > F.col("ann_start"))).withColumn("overlap", share)
    return met.where((F.col("overlap") > 0) & enough)


def _grid_hits(files: DataFrame, ann: DataFrame, clip_duration: float, min_overlap: float, min_fraction: float | None, step: float, final_clip: str | None, digits: int) -> DataFrame:
    """Matches of annotations with the clips of a grid: MATCH, the file's duration and the clip's number ``__i``."""
    met = step_counts(files.select("file", "duration"), step).where("file is not null").join(_spans(ann).hint("merge"), "file")
    slack = 0.01 + 10.0**-digits / step  # more than rounding moves a clip, in steps; what it lets in is compared exactly
    number = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(c, F.col("__n") - 1.0))).cast("long")
    first, last = number((F.col("ann_start") - clip_duration) / F.lit(step) - slack), number(F.col("ann_end") / F.lit(step) + slack)
    met = met.withColumn("__i", F.explode(F.sequence(first, last))).drop("__n")
    return _enough(timed_clips(met, clip_duration, step, final_clip, digits), min_overlap, min_fraction)


def grid_matches(files: DataFrame, ann: DataFrame, clip_duration: float, min_overlap: float, min_fraction: float | None = None, final_clip: str | None = "extend", digits: int = 10, **steps) -> DataFrame:
    """``clip_matches`` with the clips of ``clip_grid`` over the files (file, duration).

    An annotation meets its file and numbers the clips that it reaches, so the
    work follows the annotations and the grid is never laid out (but for
    ``final_clip`` ``full``, whose last clips have no number).
    """
    if final_clip not in FINAL:
        raise ValueError(f"final_clip must be one of {FINAL}")
    if final_clip == "full":
        return clip_matches(clip_grid(files.select("file", "duration"), clip_duration, final_clip=final_clip, digits=digits, **steps), ann, min_overlap, min_fraction)
    step = clip_step_of(clip_duration, **steps)
    return _grid_hits(files, ann, clip_duration, min_overlap, min_fraction, step, final_clip, digits).select(*MATCH)


def labels_on_clips(clips: DataFrame, ann: DataFrame, classes: list[str], min_overlap: float, min_fraction: float | None = None) -> DataFrame:
    """Multi-hot labels: every clip with one boolean column per class."""
    met = clip_matches(clips, subset(ann, list(classes)), min_overlap, min_fraction)
    key = ["file", "start_time", "end_time"]
    hot = met.groupBy(*key).agg(*[F.bool_or(F.col("annotation") == c).alias(c) for c in classes])
    return clips.join(hot.hint("merge"), key, "left").select(*key, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in classes])


def label_lists_on_clips(clips: DataFrame, ann: DataFrame, classes: list[str], min_overlap: float, min_fraction: float | None = None, integers: bool = False, keep_duplicates: bool = False) -> DataFrame:
    """Every clip with the list of its labels (names, or indices into ``classes``), in the order of the classes."""
    index = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    met = clip_matches(clips, subset(ann, list(classes)), min_overlap, min_fraction).withColumn("i", F.element_at(index, F.col("annotation")))
    key = ["file", "start_time", "end_time"]
    gather = F.collect_list if keep_duplicates else F.collect_set
    lists = met.groupBy(*key).agg(F.array_sort(gather("i")).alias("labels"))
    done = clips.select(*key).join(lists.hint("merge"), key, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))
    if integers:
        return done
    names = F.array(*[F.lit(c) for c in classes])
    return done.withColumn("labels", F.transform("labels", lambda i: F.element_at(names, i + 1)))


def _grid_labels(files: DataFrame, ann: DataFrame, classes: list[str], clip_duration: float, min_overlap: float, min_fraction: float | None, gather, as_labels, step: float, final_clip: str | None, digits: int) -> DataFrame:
    """Every clip of a grid with ``labels``: ``as_labels`` of the sorted class indices that ``gather`` collects, null where nothing matched.

    BLOCK clips in a row travel as one row that holds a map from clip number
    to labels, and become clips after the join, so the grid is never shuffled.
    """
    files = files.select("file", "duration")
    block = ["file", "__d", "__b"]
    exact = F.col("duration").cast("string").alias("__d")  # doubles are normalised before they are grouped or joined, which would shuffle again
    parts = shuffle_partitions(files.sparkSession)  # given, as a block's bytes don't show how many clips it becomes
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("annotation")).cast("int") - 1
    met = _grid_hits(files.distinct(), subset(ann, list(classes)), clip_duration, min_overlap, min_fraction, step, final_clip, digits)
    met = met.select("file", exact, "__i", index.alias("c"), F.floor(F.col("__i") / BLOCK).alias("__b")).repartition(parts, *block)
    hot = met.groupBy(*block, "__i").agg(as_labels(F.array_sort(gather("c"))).alias("labels"))
    hot = hot.groupBy(*block).agg(F.map_from_entries(F.collect_list(F.struct("__i", "labels"))).alias("__hot"))
    every = step_counts(files, step).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK))))
    every = every.select("*", exact).repartition(parts, *block).join(hot.hint("merge"), block, "left")
    first = F.col("__b") * BLOCK
    every = every.withColumn("__i", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("__n")) - 1)))
    return timed_clips(every, clip_duration, step, final_clip, digits).select("file", "start_time", "end_time", F.try_element_at("__hot", F.col("__i")).alias("labels"))


def clip_label_lists(
    files: DataFrame, ann: DataFrame, classes: list[str], clip_duration: float, min_overlap: float, min_fraction: float | None = None, integers: bool = False, keep_duplicates: bool = False, final_clip: str | None = "extend", digits: int = 10, **steps
) -> DataFrame:
    """``label_lists_on_clips`` for the clips of ``clip_grid`` over the files (file, duration)."""
    if final_clip not in FINAL:
        raise ValueError(f"final_clip must be one of {FINAL}")
    if final_clip == "full":
        return label_lists_on_clips(clip_grid(files.select("file", "duration"), clip_duration, final_clip=final_clip, digits=digits, **steps), ann, classes, min_overlap, min_fraction, integers, keep_duplicates)
    names = F.array(*[F.lit(c) for c in classes])
    as_labels = (lambda found: found) if integers else (lambda found: F.transform(found, lambda i: F.element_at(names, i + 1)))
    gather = F.collect_list if keep_duplicates else F.collect_set
    done = _grid_labels(files, ann, classes, clip_duration, min_overlap, min_fraction, gather, as_labels, clip_step_of(clip_duration, **steps), final_clip, digits)
    return done.withColumn("labels", F.coalesce("labels", F.array().cast("array<int>" if integers else "array<string>")))


def clip_labels(files: DataFrame, ann: DataFrame, classes: list[str], clip_duration: float, min_overlap: float, min_fraction: float | None = None, final_clip: str | None = "extend", digits: int = 10, **steps) -> DataFrame:
    """``labels_on_clips`` for the clips of ``clip_grid`` over the files (file, duration)."""
    if final_clip not in FINAL:
        raise ValueError(f"final_clip must be one of {FINAL}")
    if final_clip == "full":
        return labels_on_clips(clip_grid(files.select("file", "duration"), clip_duration, final_clip=final_clip, digits=digits, **steps), ann, classes, min_overlap, min_fraction)
    done = _grid_labels(files, ann, classes, clip_duration, min_overlap, min_fraction, F.collect_set, lambda found: found, clip_step_of(clip_duration, **steps), final_clip, digits)
    return done.select("file", "start_time", "end_time", *[F.coalesce(F.array_contains("labels", i), F.lit(False)).alias(c) for i, c in enumerate(classes)])


def files_without_annotations(files: DataFrame, ann: DataFrame) -> DataFrame:
    """Reviewed files in which nothing was annotated."""
    return files.select("file").distinct().join(ann.select(F.col("audio_file").alias("file")), "file", "left_anti")


def nested_boxes(df: DataFrame, by: tuple[str, ...] = ("audio_file", "annotation_file")) -> DataFrame:
    """Export form: one row per file pair with its boxes as an ordered array of structs."""
    box = F.struct("start_time", "end_time", "low_f", "high_f", F.col("annotation").alias("label"))
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def unnest_boxes(df: DataFrame) -> DataFrame:
    """Import form: the rows of ``nested_boxes`` as an annotation table."""
    rows = df.select(*[c for c in df.columns if c != "boxes"], F.explode("boxes").alias("b"))
    return rows.select(*[c for c in df.columns if c != "boxes"], "b.start_time", "b.end_time", "b.low_f", "b.high_f", F.col("b.label").alias("annotation"))
