"""Pulses of a GPS receiver paired with its messages, and sample rates corrected by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRED = "file string, pps_number long, total_samples long, gps_us long"


def message_candidates(gps: DataFrame, size: int = 1000) -> DataFrame:
    """Rows whose message can belong to the pulse before: (file, pps_number, total_samples, gps_us), number and samples of that pulse.

    ``gps`` has file, pps_number, total_samples, timer_count, status,
    message_us (arrival by the recorder's clock) and gps_us.  The message of a
    row tells the time of the pulse of the row before.  Out are rows whose
    counter overflowed, without fix, whose message isn't of a whole second or
    arrived more than a second after the pulse it tells of, and rows whose
    pulse number repeats or doesn't follow the one before.
    """
    w = Window.partitionBy("file").orderBy("pps_number", "total_samples")
    before = gps.where("file is not null and pps_number is not null").withColumns({"__n": F.lag("pps_number").over(w), "__s": F.lag("total_samples").over(w), "__next": F.lead("pps_number").over(w)})
    sound = (F.col("status") == "A") & F.col("timer_count").between(0, size - 1) & (F.col("gps_us") % 1_000_000 == 0) & F.col("__s").isNotNull()
    follows = (F.col("pps_number") == F.col("__n") + 1) & (F.col("__next").isNull() | (F.col("__next") != F.col("pps_number")))
    prompt = F.col("message_us").isNull() | F.abs(F.col("message_us") - F.col("gps_us")).between(0, 1_000_000)
    return before.where(sound & follows & prompt).select("file", F.col("__n").alias("pps_number"), F.col("__s").alias("total_samples"), "gps_us")


def paired(gps: DataFrame, expected_rate: float = 48_000.0, tolerance: float = 50.0) -> DataFrame:
    """Samples and instants that belong together: (file, pps_number, total_samples, gps_us).

    Of the candidates a row is kept when the rate since the last row kept
    differs from the expected one by no more than the tolerance, which only a
    walk along the file can tell; a file is what one recorder wrote in one
    session.
    """

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["pps_number"].to_numpy(), kind="stable")
        s, g = t["total_samples"].to_numpy()[order], t["gps_us"].to_numpy()[order]
        kept: list[int] = []
        for i in range(len(order)):
            if kept:
                dt = (g[i] - g[kept[-1]]) / 1e6
                if dt <= 0 or abs((s[i] - s[kept[-1]]) / dt - expected_rate) > tolerance:
                    continue
            kept.append(i)
        return t.take(pa.array(order[kept])).select(["file", "pps_number", "total_samples", "gps_us"])

    return message_candidates(gps).groupBy("file").applyInArrow(walk, PAIRED)


def rates(pairs: DataFrame) -> DataFrame:
    """Sample rate between consecutive pairs: (file, pps_number, samples, seconds, rate)."""
    w = Window.partitionBy("file").orderBy("pps_number")
    n, us = F.col("total_samples") - F.lag("total_samples").over(w), F.col("gps_us") - F.lag("gps_us").over(w)
    return pairs.select("file", "pps_number", n.alias("samples"), (us / 1e6).alias("seconds")).where("samples is not null").withColumn("rate", F.col("samples") / F.col("seconds"))


def corrected(samples: np.ndarray, at: np.ndarray, seconds: np.ndarray, rate: float) -> np.ndarray:
    """Samples at an even rate between the first and the last pair: each taken from the nearest that was recorded."""
    n = round((seconds[-1] - seconds[0]) * rate)
    where = np.interp(seconds[0] + np.arange(n) / rate, seconds, at)
    return samples[np.clip(np.rint(where).astype(int), 0, len(samples) - 1)]
