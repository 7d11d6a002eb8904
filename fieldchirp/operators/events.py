"""From simultaneous detections to positions: candidate events, delays between receivers, location, residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldchirp.functions import dsp
from fieldchirp.operators.localize import METHODS, SPEED_OF_SOUND, candidate_events

_DELAYS = "event_id string, rank int, file string, x double, y double, z double, tdoa double, cc_max double"
_PLACES = "event_id string, px double, py double, pz double, residual_rms double, n_receivers int, files array<string>, tdoas array<double>, cc_maxs array<double>"


def event_receivers(detections: DataFrame, coords: DataFrame, max_receiver_dist: float, min_n_receivers: int = 3) -> DataFrame:
    """Receivers of candidate events, the reference first: (event_id, class, start_timestamp, rank, file, x, y, z).

    An event is named by its class, instant and reference file.  Every file
    with a detection is the reference of an event if enough others are near.
    """
    ev = candidate_events(detections, coords, max_receiver_dist, min_n_receivers)
    named = ev.withColumn("event_id", F.concat_ws("|", "class", F.unix_micros(F.col("start_timestamp").cast("timestamp")).cast("string"), "file"))
    rows = named.select("event_id", "class", "start_timestamp", F.posexplode("receivers").alias("rank", "file"))
    return rows.join(coords.select("file", "x", "y", "z"), "file").select("event_id", "class", "start_timestamp", "rank", "file", "x", "y", "z")


def delays(receivers: DataFrame, max_delay: float | None = None, how: str = "phat", band: tuple[float, float] | None = None, speed: float = SPEED_OF_SOUND) -> DataFrame:
    """Delay of every receiver against the reference, with the peak of the correlation.

    ``receivers`` has ``samples`` and ``sample_rate``, cut wide enough for the
    delay either way.  An event's receivers are as many as recorders stand
    within reach of one, which bounds what a task holds.  Receivers whose
    samples differ in length from the reference's, or are missing, are left
    out; so is an event whose reference has none.  ``max_delay`` is by default
    the time that sound takes from the reference to the receiver.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        ref = pdf.iloc[0]
        out = []
        if ref["rank"] == 0 and ref["samples"] is not None and len(ref["samples"]):
            base = np.asarray(ref["samples"], dtype=np.float64)
            for _, r in pdf.iterrows():
                if r["samples"] is None or len(r["samples"]) != len(base):
                    continue
                if r["rank"] == 0:
                    out.append((r["event_id"], 0, r["file"], r["x"], r["y"], r["z"], 0.0, 1.0))
                    continue
                gap = [r[c] - ref[c] for c in "xyz" if pd.notna(r[c]) and pd.notna(ref[c])]
                reach = max_delay if max_delay is not None else float(np.sqrt(np.square(gap).sum())) / speed + 1 / r["sample_rate"]
                try:
                    d, top = dsp.tdoa(np.asarray(r["samples"], dtype=np.float64), base, reach, float(r["sample_rate"]), how, band)
                except ValueError:
                    continue
                out.append((r["event_id"], int(r["rank"]), r["file"], r["x"], r["y"], r["z"], d, top))
        return pd.DataFrame(out, columns=["event_id", "rank", "file", "x", "y", "z", "tdoa", "cc_max"])

    return receivers.select("event_id", "rank", "file", "x", "y", "z", "samples", "sample_rate").groupBy("event_id").applyInPandas(run, _DELAYS)


def positions(found: DataFrame, cc_threshold: float = 0.0, min_n_receivers: int = 3, method: str = "least_squares", speed: float = SPEED_OF_SOUND) -> DataFrame:
    """Positions of events from the delays whose correlation exceeds the threshold: one row an event, null where it can't be located.

    In x, y, z where all receivers have a z, which takes one receiver more; else in x, y.
    """
    ok = found.where((F.col("rank") == 0) | (F.col("cc_max") > cc_threshold))
    by = ok.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file", "x", "y", "z", "tdoa", "cc_max"))).alias("r"))
    solve = METHODS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, r in zip(b["event_id"], b["r"], strict=True):
                files, ts, cc = [q["file"] for q in r], [q["tdoa"] for q in r], [q["cc_max"] for q in r]
                deep = all(q["z"] is not None and q["z"] == q["z"] for q in r)
                at = np.array([[q[c] for c in ("xyz" if deep else "xy")] for q in r], dtype=float)
                if len(r) < max(min_n_receivers, at.shape[1] + 1):
                    rows.append((e, None, None, None, None, len(r), files, ts, cc))
                    continue
                t = np.array(ts)
                p = solve(at, t, speed)
                d = np.linalg.norm(at - p, axis=1)
                res = (d - d[0]) - (t - t[0]) * speed
                rows.append((e, p[0], p[1], p[2] if deep else None, float(np.sqrt((res**2).mean())), len(r), files, ts, cc))
            yield pd.DataFrame(rows, columns=["event_id", "px", "py", "pz", "residual_rms", "n_receivers", "files", "tdoas", "cc_maxs"])

    return by.mapInPandas(run, _PLACES)


def localize_detections(
    detections: DataFrame, coords: DataFrame, audio: DataFrame, max_receiver_dist: float, min_n_receivers: int = 3, cc_threshold: float = 0.0, how: str = "phat",
    band: tuple[float, float] | None = None, max_delay: float | None = None, residual_threshold: float | None = None, method: str = "least_squares", return_unlocalized: bool = False, speed: float = SPEED_OF_SOUND,
) -> DataFrame:
    """Detections (file, class, start_timestamp) to positions.

    ``audio``: (file, start_timestamp, samples, sample_rate), the clip of a
    detection widened by the delay to be expected.  Kept are located events
    whose residual doesn't exceed the threshold, or with
    ``return_unlocalized`` all, with ``located`` telling which is which.
    """
    rec = event_receivers(detections, coords, max_receiver_dist, min_n_receivers)
    heard = rec.join(audio, ["file", "start_timestamp"], "left")
    placed = positions(delays(heard, max_delay, how, band, speed), cc_threshold, min_n_receivers, method, speed)
    good = F.col("px").isNotNull() & ~F.isnan("px")
    if residual_threshold is not None:
        good = good & (F.col("residual_rms") <= residual_threshold)
    named = rec.where("rank = 0").select("event_id", "class", "start_timestamp").join(placed, "event_id", "left").withColumn("located", F.coalesce(good, F.lit(False)))
    return named if return_unlocalized else named.where("located")


def aligned_segments(placed: DataFrame, audio: DataFrame, duration: float) -> DataFrame:
    """Each receiver's samples from the moment that the sound arrived there: (event_id, file, samples, sample_rate)."""
    rows = placed.select("event_id", "start_timestamp", F.inline(F.arrays_zip(F.col("files").alias("file"), F.col("tdoas").alias("tdoa"))))
    heard = rows.join(audio, ["file", "start_timestamp"])
    a = F.round(F.col("tdoa") * F.col("sample_rate")).cast("int")
    n = F.round(F.lit(duration) * F.col("sample_rate")).cast("int")
    return heard.select("event_id", "file", F.slice("samples", F.greatest(a, F.lit(0)) + 1, n).alias("samples"), "sample_rate")
