import numpy as np
import pandas as pd

from fieldchirp.operators.spikes import course, implausible_readings

COLS = "gps_row_id long, audio_file string, pps_number int, total_samples long, timer_count int, status string, last_rmc_audiomoth_time string, last_rmc_gps_time string"


def _recorder(name, n, rate, timer, noise, rng, lost=()):
    p = np.array([i for i in range(n) if i not in lost])
    total = np.maximum(np.round(rate * p + rng.normal(0, noise, len(p))), 0)
    total[0] = 0
    return pd.DataFrame({"audio_file": name, "pps_number": p, "total_samples": total.astype(int), "timer_count": (np.round(37 + timer * p + rng.normal(0, noise / 4, len(p))) % 1000).astype(int), "status": "A", "last_rmc_audiomoth_time": "t", "last_rmc_gps_time": "t"})


def test_planted_cases_and_nothing_else(spark):
    rng = np.random.default_rng(5)
    a = _recorder("a", 1500, 48000.3, 163.4, 2, rng, lost=(40, 41, 42))
    b = _recorder("b", 300, 24000, 999.9, 30, rng)
    c = _recorder("c", 2, 24000, 10, 1, rng)
    bad = set()

    def plant(df, i, col, value):
        df.loc[i, col] = value
        bad.add((df.audio_file[i], int(df.pps_number[i])))

    plant(a, 100, "total_samples", int(a.total_samples[100]) + 60)
    for i in (1021, 1022, 1023):  # stands still across the border of two blocks
        plant(a, i, "total_samples", int(a.total_samples[1020]))
    for i in (300, 301, 302, 303, 304, 305, 306):
        plant(a, i, "timer_count", int(a.timer_count[299]))
    plant(a, 600, "timer_count", 1003)
    plant(b, 50, "total_samples", -5)
    plant(b, 60, "total_samples", int(b.total_samples[60]) + 500)
    plant(b, 70, "status", "?")
    a.loc[20, "status"] = None
    a.loc[21, "status"] = "V"
    b.loc[80, ["last_rmc_audiomoth_time", "last_rmc_gps_time"]] = None
    bad.add(("b", 80))
    rows = pd.concat([a, b, c], ignore_index=True)
    rows.loc[0, "audio_file"] = " a"
    rows = pd.concat([rows, rows[(rows.audio_file == "a") & (rows.pps_number == a.pps_number[100])]], ignore_index=True)
    rows.insert(0, "gps_row_id", np.arange(len(rows)))
    extra = pd.DataFrame([[9001, None, 1, 5, 5, "A", "t", "t"], [9002, "a", None, 5, 5, "Z", "t", "t"], [9003, "a", 9, None, None, "A", "t", "t"]], columns=rows.columns)
    whole = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) else v
    table = [tuple(map(whole, r)) for r in pd.concat([rows, extra]).astype(object).itertuples(index=False)]
    df = spark.createDataFrame(table, COLS)
    got = {r.gps_row_id: r.reasons for r in implausible_readings(df).collect()}
    named = {i: (f, p) for i, f, p in zip(rows.gps_row_id, rows.audio_file, rows.pps_number)}
    assert {named[i] for i in got if i < 9000} == bad
    assert len(rows) - 1 in got  # sent twice, judged alike
    assert [i for i in got if i >= 9000] == [9002]
    assert implausible_readings(df.limit(0)).count() == 0


def test_course_of_a_wrapping_counter():
    p = np.arange(60)
    v = (163.25 * p + 7) % 1000 // 1
    res, rate = course(p, v, 1000, 20)
    assert np.abs(res).max() < 1.6 and abs(rate[0] - 163.25) < 0.05
