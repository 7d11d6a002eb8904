"""Problem 2: implausible spikes and stuck values in counters, per source.

A counter that runs on by a steady amount per pulse is described by its rate
and by the residual round the local course.  How far a residual may lie out is
set per source by peaks over a threshold: excesses over a high quantile follow
a generalised Pareto law, whose fit gives the value exceeded at a fixed risk.
Rules for values that stand still and for values the counter can't hold come
beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldchirp.functions.keys import clean_key
from fieldchirp.scratch import materialize


@dataclass(frozen=True)
class Counter:
    """A counter column: values from 0 to ``size`` - 1, then wrapping."""

    column: str
    size: int


TOTAL_SAMPLES = Counter("total_samples", 2**32 - 1)
TIMER_COUNT = Counter("timer_count", 1000)


def _wrap(d: np.ndarray, size: float) -> np.ndarray:
    return d - size * np.rint(d / size)


def course(pulse: np.ndarray, value: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Residual of each reading from the local course, and the rate per pulse.

    Rows are sorted by pulse.  The rate is the circular middle of the steps
    between adjacent pulses (the season of the counter is its wrap); a
    reading's course is the middle of what the readings up to ``reach`` pulses
    away, itself included, say at its pulse.  Fewer than three readings give
    no course (NaN).
    """
    n = len(pulse)
    if n < 3:
        return np.full(n, np.nan), np.full(n, np.nan)
    v = value.astype(np.float64)
    dp = np.diff(pulse)
    steps = (np.diff(v) % size)[dp == 1] if (dp == 1).any() else (np.diff(v) / np.maximum(dp, 1))[dp > 0] % size
    if not len(steps):
        return np.full(n, np.nan), np.full(n, np.nan)
    turn = 2 * np.pi / size
    centre = np.angle(np.median(np.cos(turn * steps)) + 1j * np.median(np.sin(turn * steps))) / turn
    rate = centre + np.median(_wrap(steps - centre, size))
    near = np.abs(_wrap(steps - rate, size))
    close = near <= max(6 * np.median(near), 1.0)
    rate += np.mean(_wrap(steps[close] - rate, size))
    phase = v - rate * (pulse - pulse[0])
    k = np.arange(-reach, reach + 1)
    at = np.arange(n)[:, None] + k[None, :]
    ok = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    ok &= np.abs(pulse[at] - pulse[:, None]) <= reach
    # The window's circular mean comes from one unit vector per reading; deviations from it are wrapped, and their middle taken.
    unit = np.exp(1j * turn * phase)
    mid = np.angle(np.where(ok, unit[at], 0).sum(axis=1)) / turn
    dev = _wrap(phase[at] - mid[:, None], size)
    dev[~ok] = np.inf
    dev.sort(axis=1)
    count = ok.sum(axis=1)
    rows = np.arange(n)
    few = count < 3
    local = mid + (dev[rows, (count - 1) // 2] + dev[rows, count // 2]) / 2
    res = _wrap(phase - local, size)
    res[few] = np.nan
    return res, np.full(n, rate)


def _stuck(pulse: np.ndarray, value: np.ndarray, rate: np.ndarray, size: int) -> np.ndarray:
    """How far the course would have moved a value since the run of equal readings began; 0 for the first."""
    n = len(pulse)
    if not n:
        return np.zeros(0)
    first = np.ones(n, dtype=bool)
    first[1:] = value[1:] != value[:-1]
    step = np.zeros(n)
    step[1:] = np.abs(_wrap(np.nan_to_num(rate[1:]) * np.diff(pulse), size))
    step[first] = 0
    # The largest step since the run began: each run is lifted above the one before it.
    lift = np.cumsum(first) * float(size)
    return np.maximum.accumulate(step + lift) - lift


def residuals(points: DataFrame, counters: tuple[Counter, ...], source: str = "source", pulse: str = "pulse", reach: int = 20, block: int = 1024) -> DataFrame:
    """Residual and stuck movement of every distinct reading.

    Sources are cut into blocks of ``block`` pulses with a margin of twice
    ``reach`` on either side, so a source of any length is spread over tasks
    and what is collected at once is bounded by the pulses of a block.
    """
    margin = 2 * reach
    lo, hi = F.floor((F.col(pulse) - margin) / block), F.floor((F.col(pulse) + margin) / block)
    blocked = points.withColumn("block", F.explode(F.sequence(lo, hi)))
    cols = [c.column for c in counters]

    kept = points.select(source, pulse, *cols).schema

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        p = t[pulse].to_numpy()
        values = [t[c].to_numpy().astype(np.float64) for c in cols]  # nulls become NaN
        order = np.lexsort((*reversed(values), p))
        p = p[order]
        own = p // block == key[1].as_py()
        out = t.select([source, pulse, *cols]).take(pa.array(order[own]))
        for c, v in zip(counters, values, strict=True):
            v = v[order]
            known = ~np.isnan(v)
            res, moved = np.full(len(p), np.nan), np.zeros(len(p))
            res[known], rates = course(p[known], v[known], c.size, reach)
            moved[known] = _stuck(p[known], v[known], rates, c.size)
            out = out.append_column(f"{c.column}_res", pa.array(res[own])).append_column(f"{c.column}_moved", pa.array(moved[own]))
        return out

    added = [T.StructField(f"{c}_{n}", T.DoubleType()) for c in cols for n in ("res", "moved")]
    return blocked.groupBy(source, "block").applyInArrow(fold, T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.fields), *added]))


def tail_cutoffs(res: DataFrame, column: str, source: str = "source", tail: float = 0.1, risk: float = 1e-6, gross: float = 8.0, pool: float = 200.0, enough: float = 400.0, grain: float = 1.0) -> DataFrame:
    """Per source the residual that is exceeded at ``risk``: (source, scale, cutoff).

    The scale is the robust spread of the residuals, but no less than
    ``grain``'s rounding.  Excesses of |residual|/scale over a threshold are
    fitted by the generalised Pareto law (moments).  The threshold is the
    source's own (1 - ``tail``) quantile where it has ``enough`` excesses, the
    one of a normal law where it has fewer.  Gross values (beyond ``gross``
    scales) are left out of the fit, or the spikes themselves would set the
    cutoff.  A source of fewer than ``enough`` excesses borrows ``pool`` of
    all sources; one that has them is fitted on its own.  All moments are
    sums: any source size, any number of sources.
    """
    a = F.abs(F.col(f"{column}_res"))
    spread = res.where(f"{column}_res is not null and not isnan({column}_res)").groupBy(source).agg(F.percentile_approx(a, 0.5, 10000).alias("mad"))
    spread = spread.select(source, F.greatest(F.col("mad") * 1.4826, F.lit(grain * 0.6)).alias("scale"))
    normal = 1.6449  # the 0.9 quantile of |N(0,1)|
    z = F.abs(F.col(f"{column}_res")) / F.col("scale")
    scaled = res.select(source, f"{column}_res").join(spread, source).select(source, "scale", z.alias("z")).where("not isnan(z)")
    scaled = scaled.where(F.col("z") <= gross)
    own = scaled.groupBy(source).agg(F.percentile_approx("z", 1 - tail, 1000).alias("q"), F.count("*").alias("m"))
    alone = F.col("m") * tail >= enough
    scaled = scaled.join(own.select(source, F.when(alone, F.col("q")).otherwise(normal).alias("u"), F.when(alone, 0.0).otherwise(pool).alias("pool")), source)
    e = F.when(F.col("z") > F.col("u"), F.col("z") - F.col("u"))
    moments = scaled.groupBy(source).agg(F.first("scale").alias("scale"), F.first("u").alias("u"), F.first("pool").alias("pool"), F.count("*").alias("n"), F.count(e).alias("k"), F.coalesce(F.sum(e), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("s2"))
    moments = materialize(moments, "moments")
    total = moments.agg(F.sum("n"), F.sum("k"), F.sum("s1"), F.sum("s2")).first()
    n0, k0, m1, m2 = (total[0] or 1, total[1] or 1, total[2] or 0.5, total[3] or 0.5)
    k = F.col("k") + F.col("pool")
    mean = (F.col("s1") + F.col("pool") * F.lit(m1 / k0)) / k
    var = F.greatest((F.col("s2") + F.col("pool") * F.lit(m2 / k0)) / k - mean * mean, F.lit(1e-6))
    ratio = mean * mean / var
    shape = F.least(F.greatest(0.5 * (1 - ratio), F.lit(-0.2)), F.lit(0.2))
    sigma = mean * (1 - shape)
    rate = (F.col("k") + F.col("pool") * F.lit(k0 / n0)) / (F.col("n") + F.col("pool"))
    x = F.log(rate / F.lit(risk))
    beyond = F.when(F.abs(shape) < 1e-4, sigma * x).otherwise(sigma / shape * (F.exp(shape * x) - 1))
    # rounding of the reading and of the course each move a residual by up to half a unit
    return moments.select(source, "scale", ((F.col("u") + beyond) * F.col("scale") + grain).alias("cutoff"))


def implausible_readings(gps: DataFrame, risk: float = 1e-6, reach: int = 20) -> DataFrame:
    """Rows of a GPS pulse table that can't be true: (gps_row_id, reasons).

    ``reasons`` is an array of ``<column>_spike``, ``<column>_stuck``,
    ``<column>_range``, ``status``.  Rows sent twice are judged alike, being
    one reading.  Null counters, pulses and files have no course: such rows
    can fail by status (or by a range) only.  Lost pulses and ordinary
    unsteadiness are no cases.  Empty tables give no rows.
    """
    counters = (TOTAL_SAMPLES, TIMER_COUNT)
    rows = gps.select(
        "gps_row_id", clean_key("audio_file").alias("source"), F.col("pps_number").cast("long").alias("pulse"), F.col("total_samples").cast("long").alias("total_samples"), F.col("timer_count").cast("long").alias("timer_count"),
        F.coalesce(~F.col("status").isin("A", "V"), F.lit(False)).alias("odd"), ((F.col("status") == "A") & F.col("last_rmc_audiomoth_time").isNull() & F.col("last_rmc_gps_time").isNull()).alias("silent"),
    )
    cols = [c.column for c in counters]
    points = rows.where("source is not null and pulse is not null").select("source", "pulse", *cols).distinct()
    res = materialize(residuals(points, counters, reach=reach), "residuals")
    flagged = res
    for c in counters:
        cut = tail_cutoffs(res, c.column, risk=risk).select("source", F.col("cutoff").alias(f"{c.column}_cut"))
        flagged = flagged.join(cut, "source", "left")
    flags = [
        F.when(F.abs(F.nanvl(F.col(f"{c}_res"), F.lit(0.0))) > F.col(f"{c}_cut"), F.lit(f"{c}_spike")) for c in cols
    ] + [F.when(F.col(f"{c}_moved") > F.col(f"{c}_cut"), F.lit(f"{c}_stuck")) for c in cols]
    bad = flagged.select("source", "pulse", *cols, F.array_compact(F.array(*flags)).alias("found")).where(F.size("found") > 0)
    out = [F.when((F.col(c.column) < 0) | (F.col(c.column) > c.size - 1), F.lit(f"{c.column}_range")) for c in counters]
    status = F.when(F.col("odd") | F.coalesce("silent", F.lit(False)), F.lit("status"))
    same = (F.col("source") == F.col("b_source")) & (F.col("pulse") == F.col("b_pulse"))
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    marked = rows.join(bad.select(*[F.col(c).alias(f"b_{c}") for c in ("source", "pulse", *cols)], "found"), same, "left")
    reasons = F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array_compact(F.array(*out, status)))
    return marked.select("gps_row_id", reasons.alias("reasons")).where(F.size("reasons") > 0)
