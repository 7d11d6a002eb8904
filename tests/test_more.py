"""GPS pairing, detections to positions, the store's catalogue, files of selections and of sound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldchirp.functions import signal
from fieldchirp.operators import clips, events, gps, pipeline, registry
from fieldchirp.sources import raven, wav

S = 1_000_000


def test_gps_messages_belong_to_the_pulse_before(spark):
    t0 = 36_000 * S
    rows = [("g", i, (48_000 * i - 1) if i else 0, 500, "A", None, t0 + (i - 1) * S) for i in range(4)]
    rows += [("g", 4, 192_000, 5000, "A", None, t0 + 3 * S), ("g", 5, 239_999, 500, "V", None, t0 + 4 * S), ("g", 6, 287_999, 500, "A", None, t0 + 5 * S + 7), ("g", 7, 999_999, 500, "A", None, t0 + 6 * S), ("g", 8, 383_999, 500, "A", None, t0 + 7 * S), ("g", 9, 431_999, 500, "A", None, t0 + 8 * S)]
    df = spark.createDataFrame(rows, "file string, pps_number long, total_samples long, timer_count long, status string, message_us long, gps_us long")
    got = sorted((r.pps_number, r.total_samples, (r.gps_us - t0) // S) for r in gps.paired(df).collect())
    # 3's message is in an overflown row, 4's has no fix, 5's isn't whole, 7's count jumps
    assert got == [(0, 0, 0), (1, 47_999, 1), (2, 95_999, 2), (6, 287_999, 6), (8, 383_999, 8)]
    assert gps.paired(df.limit(0)).count() == 0
    x = gps.corrected(np.arange(96_500), np.array([0.0, 47_999.0, 95_999.0]), np.array([0.0, 1.0, 2.0]), 48_000.0)
    assert len(x) == 96_000 and x[48_000] == 47_999
    assert [r.samples for r in gps.rates(gps.paired(df).where("pps_number < 3")).orderBy("pps_number").collect()] == [47_999, 48_000]


def test_detections_become_positions(spark):
    rate, at = 8000, {"a": (0.0, 0.0), "b": (20.0, 0.0), "c": (20.0, 20.0), "d": (0.0, 20.0), "far": (900.0, 0.0)}
    source = (7.0, 12.0)
    noise = np.random.default_rng(1).standard_normal(4000)
    audio, det = [], []
    for f, (x, y) in at.items():
        lag = round(np.hypot(x - source[0], y - source[1]) / 343.0 * rate) if f != "far" else 0
        audio.append((f, 1, np.roll(noise, lag)[500:3500].tolist(), rate))
        det.append((f, "wren", 1))
    det.append(("a", "owl", 1))
    ts = F.timestamp_seconds(F.col("t"))
    a = spark.createDataFrame(audio, "file string, t int, samples array<double>, sample_rate int").select("file", ts.alias("start_timestamp"), "samples", "sample_rate")
    d = spark.createDataFrame(det, "file string, class string, t int").select("file", "class", ts.alias("start_timestamp"))
    c = spark.createDataFrame([(f, x, y, None) for f, (x, y) in at.items()], "file string, x double, y double, z double")
    got = events.localize_detections(d, c, a, 60.0, 4, cc_threshold=0.01, residual_threshold=2.0).collect()
    assert len(got) == 4 and all(abs(r.px - 7) < 0.5 and abs(r.py - 12) < 0.5 and r.n_receivers == 4 for r in got)
    every = events.localize_detections(d, c, a, 60.0, 4, cc_threshold=2.0, return_unlocalized=True).collect()
    assert len(every) == 4 and not any(r.located for r in every)


def test_registry(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path))
    r.check_model("m1")
    r.check_clip_duration(5.0)
    w = spark.createDataFrame([(i, "a//b.wav", 5.0 * i, 5.0 * i + 5, [float(i), 1.0 - i]) for i in range(4)] + [(9, "a/b.wav", 0.0, 5.0, [7.0, 7.0]), (10, "x.wav", 0.0, 5.0, None)], "window_id long, file string, start_time double, end_time double, embedding array<double>")
    refused = r.insert(w, limit=2.0)
    assert sorted(x.reason for x in refused.collect()) == ["duplicate window", "no embedding"]
    again = registry.Registry(spark, str(tmp_path))
    with pytest.raises(ValueError):
        again.check_model("m2")
    with pytest.raises(ValueError):
        again.insert(w.where("window_id = 1"), mode="error")
    assert again.insert(w.where("window_id = 2")).count() == 1 and again.windows().count() == 4
    lab = spark.createDataFrame([("a/b.wav", 0.0, 5.0, 1.0), ("a/b.wav", 5.0, 10.0, 0.0), ("a/b.wav", 15.0, 20.0, None)], "file string, start_time double, end_time double, wren double")
    again.add_dataset("one", lab)
    with pytest.raises(ValueError):
        again.add_dataset("one", lab)
    again.add_dataset("one", lab.withColumn("wren", F.lit(1.0)).limit(3), mode="skip")
    assert again.dataset("one").where("wren = 1").count() == 2 and again.datasets() == ["one"]
    rows = again.training_set(["wren"], ["one"])
    weights, bias = registry.fit_linear(rows, ["wren"], steps=3)
    again.add_classifier("c", weights, bias)
    assert again.predict("c", lab.select("file", "start_time", "end_time")).count() == 3 and again.classifiers() == ["c"]


def test_selection_files_and_sound_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Selection\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tSpecies\n1\t0.5\t1.5\t100\t900\twren\n")
    (tmp_path / "in/b.txt").write_text("Selection\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tSpecies\tdistance\n")
    (tmp_path / "in/c.txt").write_text("Selection\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tSpecies\tdistance\n7\t2\t3\t1\t2\towl\t12\n")
    t = raven.read_selection_files(spark, [(f"{tmp_path}/in/{n}.txt", f"/s/{n}.wav") for n in "abc"], "Species", {"distance": "metres"})
    assert sorted((r.audio_file, r.annotation, r.metres) for r in t.collect()) == [("/s/a.wav", "wren", None), ("/s/c.wav", "owl", "12")]
    paths = raven.write_selection_files(t, f"{tmp_path}/out", ["/s/a.wav", "/s/b.wav"])
    back = raven.read_selection_files(spark, [(paths[0], "/s/a.wav"), (paths[1], "/s/b.wav")], "Annotation")
    assert [(r.start_time, r.end_time, r.annotation) for r in back.collect()] == [(0.5, 1.5, "wren")]
    with pytest.raises(ValueError):
        raven.write_selection_files(t, f"{tmp_path}/out", ["/s/a.wav", "/q/a.wav"])
    data = wav.with_tags(wav.with_tags(wav.encode(np.zeros((2, 800)), 8000), {"comment": "x"}), {"comment": "hé", "artist": ""})
    assert {k: v for k, v in wav.parse_tags(data).items() if k != "filesize"} == {"comment": "hé", "artist": " ", "samplerate": "8000", "channels": "2", "duration": "0.1"}
    df = spark.createDataFrame([("rec", [0.25] * 20_000)], "prefix string, samples array<double>")
    assert wav.split_and_save(df, f"{tmp_path}/w", 1.0, 8000, dry_run=True).count() == 3
    assert sorted(r.n_bytes for r in wav.split_and_save(df, f"{tmp_path}/w", 1.0, 8000).collect()) == [16_044] * 3
    assert wav.read_wav(spark, f"{tmp_path}/w").where("error is null and duration = 1.0").count() == 3


def test_pipeline_and_ingest(spark):
    p = pipeline.Pipeline((pipeline.Step("a", pipeline.on_samples(F.reverse)), pipeline.Step("b", pipeline.random_gain(), augments=True)))
    with pytest.raises(KeyError):
        p.remove("z")
    with pytest.raises(ValueError):
        p.insert(pipeline.Step("a", lambda d: d))
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, []), (3, None)], "id int, samples array<double>")
    trace = {}
    rows = {r.id: r.samples for r in p.forward(df, augment=False, trace=trace).collect()}
    assert rows == {1: [0.3, 0.2, 0.1], 2: [], 3: None} and list(trace) == ["a"]
    assert p.forward(df, stop_at="a").collect() == df.collect()
    again = {r.id: r.samples for r in p.forward(df.repartition(3)).collect()}
    assert again == {r.id: r.samples for r in p.forward(df).collect()} and again[1] != [0.3, 0.2, 0.1]
    for f in (pipeline.random_wrap(1.0), pipeline.time_mask(), pipeline.jitter(0.1), pipeline.adaptive_gain(), pipeline.fit_length(4)):
        assert f(df).count() == 3 and len(f(df).where("id = 1").first().samples) in (3, 4)
    assert [r.samples for r in pipeline.fit_length(4, extend=False)(df).collect()] == [None] * 3
    g = clips.ingest_samples(["x", "y"], spark, spark.createDataFrame([("x", 10.0), ("y", None)], "file string, duration double"), 5.0)
    assert [(r.file, r.start_time) for r in g.orderBy("start_time").collect()] == [("x", 0.0), ("x", 5.0)]
    lab = spark.createDataFrame([("x", 0.0, 5.0, 1.0, None)], "file string, start_time double, end_time double, a double, b double")
    assert clips.check_labels(lab, ["a", "b"]) is lab and clips.without_foreign_classes(lab, ["b"]).columns == ["file", "start_time", "end_time"]
    for bad, classes in ((lab, ["b", "a"]), (lab.withColumn("a", F.lit(1.5)), ["a", "b"])):
        with pytest.raises(ValueError):
            clips.check_labels(bad, classes)
    track = signal.Track(F.col("samples"), 2)
    row = df.where("id = 1").select((track**2).samples.alias("p"), (track * 2).samples.alias("m"), track[0.5:1].samples.alias("c"), track[-0.5:None].samples.alias("e"), (track + 0.0).samples.alias("g")).first()
    assert row.p == [0.1, 0.2, 0.3] * 2 and row.m == [0.2, 0.4, 0.6] and row.c == [0.2] and row.e == [0.3] and row.g == [0.1, 0.2, 0.3]
