import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldchirp.functions import dsp, losses, signal
from fieldchirp.operators import localize


def test_spectrum_and_rms_of_a_tone():
    t = np.arange(64) / 64
    s = dsp.spectrum(0.5 * np.sin(2 * np.pi * 8 * t))
    assert s.argmax() == 8 and s[8] == pytest.approx(0.5)
    p = dsp.power_spectrogram(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000), 512)
    assert dsp.frame_rms(p).mean() == pytest.approx(math.sqrt(0.75), rel=0.05)
    assert dsp.mel_filterbank(512, 8000).shape == (64, 257)
    assert dsp.pcen(p).shape == p.shape


def test_filters_pass_and_stop():
    t = np.arange(4000) / 1000
    low, high = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 200 * t)
    y = dsp.zero_phase(low + high, dsp.Butterworth(5, None, 50, 1000))
    assert np.abs(y - low)[200:-200].max() < 0.02
    y = dsp.zero_phase(low + high, dsp.Butterworth(5, 100, 300, 1000))
    assert np.abs(y - high)[200:-200].max() < 0.02
    with pytest.raises(ValueError):
        dsp.Butterworth(5, 0, None, 1000)
    r = dsp.resample(low, 1000, 500)
    assert len(r) == 2000 and np.abs(r - low[::2])[50:-50].max() < 0.05


@pytest.mark.parametrize("how", ["phat", "cc", "cc_norm", "roth", "scot", "ht"])
def test_delays_are_found(how):
    x = np.random.default_rng(0).standard_normal(400)
    d, _ = dsp.tdoa(np.roll(x, 13), x, 0.5, 100.0, how)
    assert d == pytest.approx(0.13)


def test_pulses_peaks_and_sequences():
    t = np.arange(3000) / 100
    a = 1 + np.sin(2 * np.pi * 20 * t)
    assert dsp.pulse_score(a, 100, (15, 30)) > 100 * dsp.pulse_score(a, 100, (30, 45))
    assert dsp.pulse_score(a, 100, (20.001, 20.002)) == 0
    x = np.zeros(4000)
    for k in (800, 2000, 3100):
        x[k : k + 40] = np.sin(2 * np.pi * 50 * np.arange(40) / 400)
    at, h = dsp.cwt_peaks(x, 400, 50, 0.3, 0.2)
    assert np.allclose(at, [2.05, 5.05, 7.8], atol=0.05)
    beats = np.cumsum(np.linspace(0.7, 0.1, 30))
    assert [len(s) for s in dsp.accel_sequences(beats)] == [28]  # the first sets the reference, the last has no gap
    drum = [1.02754281, 1.83007625, 1.96758198, 2.17759073, 3.19263303, 3.93266386, 4.52518855, 5.00270845, 5.43522647, 5.80024168, 5.84524355, 6.15275636, 6.44776866, 6.72278012, 6.98279095, 7.20280012, 7.41030876, 7.61781741, 7.79782491, 7.95533147, 8.11033793, 8.26784449, 8.3928497, 8.51785491, 8.64786033, 8.74786449, 8.86036918, 8.95287304, 9.02787616, 9.1128797, 9.25538564, 9.31788825, 9.37789075, 9.66540273, 9.82290929, 9.91041293, 10.0104171, 10.11792158, 10.37293221, 13.94058086]
    assert [len(s) for s in dsp.accel_sequences(np.array(drum))] == [19]
    assert dsp.accel_sequences(np.arange(30) * 5.0) == []
    assert len(dsp.ribbit_scores(np.sin(2 * np.pi * 400 * np.arange(8000) / 2000), 2000, (300, 500), (5, 20), 1.0)) == 4
    assert abs(20 * math.log10(math.sqrt(2) * np.sqrt(np.mean(dsp.noise(4096, "pink", -20) ** 2))) + 20) < 0.5


def test_locations_are_recovered(spark):
    rec = np.array([[0, 0], [0, 20], [20, 20], [20, 0], [10, 31]], dtype=float)
    for true in ((10.0, 10.0), (3.0, 17.0), (25.0, -4.0)):
        t = np.linalg.norm(rec - true, axis=1) / 343.0
        for f in localize.METHODS.values():
            assert np.allclose(f(rec, t - t.min()), true, atol=0.01)
    ev = spark.createDataFrame([(1, rec[:, 0].tolist(), rec[:, 1].tolist(), (t - t[0]).tolist()), (2, [0.0, 1.0], [0.0, 1.0], [0.0, 0.0])], "event_id long, xs array<double>, ys array<double>, tdoas array<double>")
    got = {r.event_id: r for r in localize.locate(ev).collect()}
    assert abs(got[1].px - 25) < 0.01 and got[1].residual_rms < 1e-3 and got[2].px is None


def test_columns_on_empty_and_null_arrays(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [0.0, 0.0]), (4, [0.5, float("nan"), 0.7, 0.8])], "id int, x array<double>")
    x = F.col("x")
    rows = {r.id: r for r in df.select("id", signal.rms(x).alias("rms"), F.size(signal.loop_to(x, 3)).alias("n"), signal.normalize(x).alias("norm"), signal.event_runs(x, 0.5).alias("runs"), signal.to_mono(F.array(x, x)).alias("mono")).collect()}
    assert rows[1].rms is None and rows[2].rms is None and rows[3].norm == [0.0, 0.0] and rows[3].mono == [0.0, 0.0]
    assert [(r.start, r.length) for r in rows[4].runs] == [(0, 1), (2, 2)]
    assert df.where("id = 3").select(losses.softmax(x)).first()[0] == [0.5, 0.5]
