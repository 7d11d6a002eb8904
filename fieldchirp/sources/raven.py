"""Tab-separated selection tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the format.
FIXED = {"Begin Time (s)": "start_time", "End Time (s)": "end_time", "Low Freq (Hz)": "low_f", "High Freq (Hz)": "high_f"}


def _label_column(columns: list[str], label: str | int | list[str] | None) -> str | None:
    if label is None:
        return None
    if isinstance(label, int):
        return columns[label]
    found = [c for c in ([label] if isinstance(label, str) else label) if c in columns]
    if len(found) != 1:
        raise ValueError(f"exactly one of {label} must be a column of {columns}")
    return found[0]


def read_selections(spark: SparkSession, path: str, label: str | int | list[str] | None, audio_file: str | None = None, keep_extra: bool = True) -> DataFrame:
    """One table, or many with the same header (a folder or pattern), as an annotation table."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    name = _label_column(df.columns, label)
    num = lambda old: F.col(f"`{old}`").cast("double") if old in df.columns else F.lit(None).cast("double")
    standard = {
        "audio_file": F.lit(audio_file).cast("string"),
        "annotation_file": F.col("_metadata.file_path"),
        "annotation": F.col(f"`{name}`") if name else F.lit(None).cast("string"),
    } | {new: num(old) for old, new in FIXED.items()}
    # column names are matched regardless of case, so an extra one may not repeat a standard one
    extra = [c for c in df.columns if c not in FIXED and c != name and c.lower() not in standard] if keep_extra else []
    return df.select(*[c.alias(k) for k, c in standard.items()], *[F.col(f"`{c}`") for c in extra])


def read_selection_files(spark: SparkSession, files: list[tuple[str, str | None]], label: str | int | list[str] | None, column_map: dict[str, str] | None = None, keep_extra: bool = True) -> DataFrame:
    """Tables given one by one as (selection table, its audio file), whose headers may differ, joined by name.

    ``column_map`` renames further columns.  A table without rows adds none;
    which files were reviewed is the caller's list.
    """
    out = None
    for path, audio in files:
        one = read_selections(spark, path, label, audio, keep_extra)
        for old, new in (column_map or {}).items():
            if old in one.columns:
                one = one.withColumnRenamed(old, new)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no selection tables given")
    return out


def write_selection_files(annotations: DataFrame, folder: str, audio_files: list[str | None]) -> list[str]:
    """One tab-separated file for each listed audio file, even where it has no annotation; names must differ.

    The list is what a person reviewed; the rows of one file at a time go
    through the driver, which writes them under the file's name.
    """
    stem = lambda f: "unspecified_audio" if f is None else f.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    stems = [stem(f) for f in audio_files]
    if len(set(stems)) != len(stems):
        raise ValueError("two audio files have the same name")
    os.makedirs(folder, exist_ok=True)
    out = []
    for f, name in zip(audio_files, stems, strict=True):
        mine = annotations.where(F.col("audio_file").isNull() if f is None else F.col("audio_file") == f)
        path = f"{folder.rstrip('/')}/{name}.selections.txt"
        with open(path, "w", encoding="utf-8") as o:
            o.write("\t".join([*FIXED, "Annotation"]) + "\n")
            for r in mine.select(*FIXED.values(), "annotation").orderBy("start_time", "end_time").toLocalIterator():
                o.write("\t".join("" if v is None else str(v) for v in r) + "\n")
        out.append(path)
    return out


def write_selections(annotations: DataFrame, folder: str) -> None:
    """One folder of tab-separated parts per audio file (``audio_file=...``), written in parallel."""
    back = {v: k for k, v in FIXED.items()}
    out = annotations.select(F.coalesce("audio_file", F.lit("unspecified_audio")).alias("audio_file"), *[F.col(c).alias(back[c]) for c in back], F.col("annotation").alias("Annotation"))
    out.repartition("audio_file").write.partitionBy("audio_file").option("sep", "\t").option("header", True).csv(folder)


def read_annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "audio_file string, annotation_file string, annotation string, start_time double, end_time double, low_f double, high_f double"
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_annotations_csv(df: DataFrame, path: str) -> None:
    df.select("audio_file", "annotation_file", "annotation", "start_time", "end_time", "low_f", "high_f").write.option("header", True).csv(path)
