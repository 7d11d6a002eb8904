"""Sound-source location from synchronised recorders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.operators.nearby import near_pairs

SPEED_OF_SOUND = 343.0


def speed_of_sound(celsius: Column) -> Column:
    return 331.3 * F.sqrt(1.0 + celsius / 273.15)


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1])))


def travel_time(d: Column, speed: float = SPEED_OF_SOUND) -> Column:
    return d / F.lit(speed)


def lorentz(u: list[Column], v: list[Column] | None = None) -> Column:
    """Inner product with the last component counted negative."""
    v = v or u
    return sum((a * b for a, b in zip(u[1:-1], v[1:-1], strict=True)), u[0] * v[0]) - u[-1] * v[-1]


def start_timestamp(recorded_at: Column, start_s: Column) -> Column:
    """Instant of an offset within a recording, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(recorded_at.cast("timestamp")) + F.round(start_s * 1e6).cast("long"))


def missing_coordinates(detections: DataFrame, coords: DataFrame) -> DataFrame:
    return detections.select("file").distinct().join(coords.select("file"), "file", "left_anti")


def nearby_dict(coords: DataFrame, r_max: float) -> DataFrame:
    """Other recorders within ``r_max`` of each: (file, near), both ways."""
    p = near_pairs(coords, "file", "x", "y", "z", r_max)
    return p.select(F.col("key_a").alias("file"), F.col("key_b").alias("near"), "dist").unionByName(p.select(F.col("key_b").alias("file"), F.col("key_a").alias("near"), "dist"))


def candidate_events(detections: DataFrame, coords: DataFrame, r_max: float, min_receivers: int = 3) -> DataFrame:
    """Events (class, start_timestamp, file, receivers): a detection and the simultaneous ones near it.

    ``detections`` has (file, class, start_timestamp) of positive detections.
    One event per reference file that finds at least ``min_receivers`` - 1
    others.
    """
    d = detections.select("class", "start_timestamp", "file").distinct()
    near = nearby_dict(coords, r_max).select("file", F.col("near"))
    other = d.select("class", "start_timestamp", F.col("file").alias("near"))
    met = d.join(near, "file").join(other, ["class", "start_timestamp", "near"])
    ev = met.groupBy("class", "start_timestamp", "file").agg(F.array_sort(F.collect_set("near")).alias("others"))
    return ev.where(F.size("others") + 1 >= min_receivers).withColumn("receivers", F.concat(F.array("file"), F.col("others"))).drop("others")


def tdoa_residuals(rows: DataFrame, event: str = "event_id", speed: float = SPEED_OF_SOUND) -> DataFrame:
    """Per receiver of an event (rank, x, y, tdoa, px, py) the residual in metres, relative to the first receiver."""
    d = distance((F.col("x"), F.col("px")), (F.col("y"), F.col("py")))
    first = rows.where("rank = 0").select(event, d.alias("__d0"))
    return rows.join(first, event).withColumn("residual", ((d - F.col("__d0")) / speed - F.col("tdoa")) * speed).drop("__d0")


def residual_rms(rows: DataFrame, event: str = "event_id") -> DataFrame:
    return rows.groupBy(event).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("residual_rms"))


def least_squares(receivers: np.ndarray, times: np.ndarray, speed: float = SPEED_OF_SOUND, rounds: int = 100) -> np.ndarray:
    """Position whose delays fit best: Levenberg-Marquardt from the centroid, with the emission time as unknown."""
    p = np.append(receivers.mean(axis=0), 0.0)
    damp, last = 1e-3, np.inf
    for _ in range(rounds):
        diff = p[:-1] - receivers
        dist = np.maximum(np.linalg.norm(diff, axis=1), 1e-9)
        r = dist + p[-1] - times * speed
        J = np.hstack([diff / dist[:, None], np.ones((len(r), 1))])
        A, g = J.T @ J, J.T @ r
        step = np.linalg.solve(A + damp * np.diag(np.diag(A) + 1e-12), -g)
        q = p + step
        cost = ((np.linalg.norm(q[:-1] - receivers, axis=1) + q[-1] - times * speed) ** 2).sum()
        if cost < (r**2).sum():
            p, damp = q, damp / 3
            if abs(last - cost) < 1e-14:
                break
            last = cost
        else:
            damp *= 5
    return p[:-1]


def closed_form(receivers: np.ndarray, times: np.ndarray, speed: float = SPEED_OF_SOUND) -> np.ndarray:
    """Bancroft's solution; of two roots the one with the smaller time component."""
    centre = receivers.mean(axis=0)
    B = np.hstack([receivers - centre, -(times * speed)[:, None]])
    flip = np.append(np.ones(receivers.shape[1]), -1.0)
    a = 0.5 * (B * B * flip).sum(axis=1)
    try:
        P = np.linalg.pinv(B)
    except np.linalg.LinAlgError:
        return np.full(receivers.shape[1], np.nan)
    be, ba = P @ np.ones(len(a)), P @ a
    ip = lambda u, v: float((u * v * flip).sum())
    q2, q1, q0 = ip(be, be), 2 * (ip(be, ba) - 1), ip(ba, ba)
    root = np.sqrt(max(q1 * q1 - 4 * q2 * q0, 0.0))
    if q2 == 0:
        lams = [-q0 / q1]
    else:
        lams = [(-q1 + root) / (2 * q2), (-q1 - root) / (2 * q2)]
    sols = [ba + lam * be for lam in lams]
    return min(sols, key=lambda u: abs(u[-1]))[:-1] + centre


def linear_form(receivers: np.ndarray, times: np.ndarray, speed: float = SPEED_OF_SOUND) -> np.ndarray:
    """Linear least squares in position and range to the first receiver."""
    x0, d = receivers[0], (times - times[0]) * speed
    A = np.hstack([2 * (receivers[1:] - x0), 2 * d[1:, None]])
    b = (receivers[1:] ** 2).sum(axis=1) - (x0**2).sum() - d[1:] ** 2
    return np.linalg.lstsq(A, b, rcond=None)[0][:-1]


METHODS = {"least_squares": least_squares, "closed_form": closed_form, "linear": linear_form}


def locate(events: DataFrame, method: str = "least_squares", speed: float = SPEED_OF_SOUND) -> DataFrame:
    """Positions of events (event_id, xs, ys, tdoas as arrays): (event_id, px, py, residual_rms, n_receivers).

    Events with fewer receivers than dimensions + 1 get null positions.  An
    event is one row, so the work is spread by rows, not by groups.
    """
    solve = METHODS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, xs, ys, ts in zip(b["event_id"], b["xs"], b["ys"], b["tdoas"], strict=True):
                rec, t = np.column_stack([xs, ys]).astype(float), np.asarray(ts, dtype=float)
                if len(t) < 3:
                    rows.append((e, None, None, None, len(t)))
                    continue
                p = solve(rec, t, speed)
                d = np.linalg.norm(rec - p, axis=1)
                res = (d - d[0]) - (t - t[0]) * speed
                rows.append((e, p[0], p[1], float(np.sqrt((res**2).mean())), len(t)))
            yield pd.DataFrame(rows, columns=["event_id", "px", "py", "residual_rms", "n_receivers"])

    return events.select("event_id", "xs", "ys", "tdoas").mapInPandas(run, "event_id long, px double, py double, residual_rms double, n_receivers int")
