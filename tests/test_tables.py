import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldchirp.functions.keys import clean_key
from fieldchirp.operators import annotations as ann
from fieldchirp.operators import clips, codecs, metrics, selection, store
from fieldchirp.sources import raven, wav
from fieldchirp.operators.orphans import orphans_on_arrival
from fieldchirp.streaming.ingest import OrphanTracker, detection_counts, ingest_windows

BOX = "audio_file string, annotation string, start_time double, end_time double, low_f double, high_f double"


def boxes(spark):
    rows = [("a.wav", "a", 0.0, 1.0, 0.0, 100.0), ("a.wav", "b", 3.0, 5.0, 500.0, 1200.0), ("a.wav", None, 4.0, 5.0, 1000.0, 1500.0), (None, "a", 0.0, 1.0, None, float("nan"))]
    return ann.annotation_table(spark.createDataFrame(rows, BOX))


def test_keys(spark):
    df = spark.createDataFrame([(" a//b///c.wav\t",), ("",), ("  ",), (None,), ("A/b.wav",)], "k string")
    assert [r[0] for r in df.select(clean_key("k")).collect()] == ["a/b/c.wav", None, None, None, "A/b.wav"]


def test_grid_edges(spark):
    f = spark.createDataFrame([("a", 10.0), ("b", 2.0), ("c", 0.0), ("d", None), ("e", float("nan"))], "file string, duration double")
    grid = lambda **k: sorted((r.file, r.start_time, r.end_time) for r in clips.clip_grid(f, 4.0, **k).collect())
    assert grid() == [("a", 0, 4), ("a", 4, 8), ("a", 8, 12), ("b", 0, 4)]
    assert grid(final_clip=None) == [("a", 0, 4), ("a", 4, 8)]
    assert grid(final_clip="remainder") == [("a", 0, 4), ("a", 4, 8), ("a", 8, 10), ("b", 0, 2)]
    assert grid(final_clip="full") == [("a", 0, 4), ("a", 4, 8), ("a", 6, 10), ("b", 0, 4)]
    assert clips.invalid_files(f).count() == 3
    with pytest.raises(ValueError):
        clips.clip_grid(f, 4.0, clip_overlap=1.0, clip_step=2.0)
    with pytest.raises(ValueError):
        clips.clip_grid(f, 4.0, clip_overlap=4.0)


def test_boxes_filters(spark):
    b = boxes(spark)
    assert ann.subset(b, ["a"]).count() == 2 and ann.subset(b, [None]).count() == 1 and ann.subset(b, []).count() == 0
    assert ann.trim(b, 1, 4).count() == 3 and ann.trim(b, 1, 4, "remove").count() == 0
    assert [r.low_f for r in ann.bandpass(b, 100, 1000).collect()] == [500.0]
    with pytest.raises(ValueError):
        ann.convert_labels(b, {"a": "b", "b": "c"})
    grid = spark.createDataFrame([("a.wav", float(i), i + 2.0) for i in range(0, 6, 2)], "file string, start_time double, end_time double")
    hot = {r.start_time: (r.a, r.b) for r in ann.labels_on_clips(grid, b, ["a", "b"], 0.0).collect()}
    assert hot == {0.0: (True, False), 2.0: (False, True), 4.0: (False, True)}
    assert ann.labels_on_clips(grid, b.limit(0), ["a"], 0.0).where("a").count() == 0
    lists = ann.label_lists_on_clips(grid, b, ["b", "a"], 0.5, integers=True).orderBy("start_time").collect()
    assert [r.labels for r in lists] == [[1], [0], [0]]


def test_codecs(spark):
    df = spark.createDataFrame([(["b", "zz"],), ([],), (None,)], "l array<string>")
    hot = codecs.categorical_to_multi_hot(F.col("l"), ["a", "b"])
    assert [r[0] for r in df.select(hot).collect()] == [[0, 1], [0, 0], [0, 0]]
    assert [r[0] for r in df.limit(1).select(codecs.multi_hot_to_categorical(hot, ["a", "b"])).collect()] == [["b"]]
    with pytest.raises(Exception, match="unknown class"):
        df.select(codecs.categorical_to_integers(F.col("l"), ["a", "b"])).collect()


def test_metrics_of_a_known_case(spark):
    scores, targets = [[0, 1], [0.4, 1], [0.6, 1], [1, 0]], [[0, 1], [1, 0], [0, 1], [1, 0]]
    rows = [(str(c), float(s[c]), t[c]) for s, t in zip(scores, targets) for c in (0, 1)]
    df = spark.createDataFrame(rows, "class string, score double, target int").withColumn("pred", metrics.at_threshold("score", 0.5))
    m = metrics.macro(df).first()
    assert m.precision == pytest.approx(0.583333, abs=1e-6) and m.recall == 0.75
    r = {x["class"]: x for x in metrics.ranking(df).collect()}
    assert r["0"].au_roc == 0.75 and r["0"].avg_precision == pytest.approx(5 / 6)
    assert sum(x.au_roc for x in r.values()) / 2 == 0.75
    none = metrics.ranking(df.withColumn("target", F.lit(None).cast("int")))
    assert none.count() == 0


def test_store_matches(spark):
    w = spark.createDataFrame([(20, "f", 1.0, 2.0), (10, "f", 0.0, 1.0), (11, "f", 0.0, 1.0)], "window_id long, file string, start_time double, end_time double")
    c = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.0, 1.9999999), ("f", 9.0, 10.0)], "file string, start_time double, end_time double")
    got = {r.start_time: r.window_ids for r in store.match_windows(c, w).collect()}
    assert got == {0.0: [10, 11], 1.0: [20], 9.0: []}
    assert store.missing_windows(c, w).count() == 1 and store.missing_windows(c, w, "add").count() == 3
    with pytest.raises(ValueError):
        store.missing_windows(c, w, "error")
    e = spark.createDataFrame([([1.0, -2.0],)], "embedding array<double>")
    out = e.select(store.mlp_forward([([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]), ([[2.0, 5.0]], [1.0])])("embedding")).first()[0]
    assert out == [3.0]


def test_selection_counts(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 1), ("d", 0, 0)], "file string, x int, y int")
    out = selection.resample(df, ["file"], ["x", "y"], 5)
    assert {r[0]: r[1] for r in out.groupBy("resampled_class").count().collect()} == {"x": 5, "y": 5, None: 1}
    assert selection.upsample(df.select("file", F.col("x").alias("l")), "l", ["file"]).count() == 6


def test_raven_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Selection\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tSpecies\n1\t0.5\t1.5\t100\t200\tWOTH\n2\t2\t3\t100\t200\t\n")
    (tmp_path / "empty.txt").write_text("Selection\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tSpecies\n")
    df = raven.read_selections(spark, str(tmp_path / "t.txt"), ["Annotation", "Species"], "x.wav")
    assert [(r.annotation, r.start_time, r.Selection) for r in df.collect()] == [("WOTH", 0.5, "1"), (None, 2.0, "2")]
    assert raven.read_selections(spark, str(tmp_path / "empty.txt"), 5).count() == 0
    with pytest.raises(ValueError):
        raven.read_selections(spark, str(tmp_path / "t.txt"), "nope")
    raven.write_selections(df, str(tmp_path / "out"))
    back = raven.read_selections(spark, str(tmp_path / "out"), "Annotation")
    assert back.count() == 2
    raven.write_annotations_csv(df, str(tmp_path / "csv"))
    assert raven.read_annotations_csv(spark, str(tmp_path / "csv")).count() == 2


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(800) / 10) * 0.5
    (tmp_path / "a.wav").write_bytes(wav.encode(np.stack([x, -x]), 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF" + struct.pack("<I", 3))
    rows = wav.read_wav(spark, str(tmp_path), mono=False).orderBy("channel").collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) == 3 and len(good) == 2 and good[0].sample_rate == 8000
    assert np.abs(np.array(good[0].samples) - x).max() < 1e-4
    clip = wav.read_wav(spark, str(tmp_path / "a.wav"), offset=0.05, duration=0.02).first()
    assert len(clip.samples) == 160
    out = wav.write_wav(spark.createDataFrame([("b.wav", [0.0, 0.5], 8000)], "name string, samples array<double>, sample_rate int"), str(tmp_path / "o"))
    assert out.count() == 1 and wav.decode((tmp_path / "o/b.wav").read_bytes())[0].shape == (1, 2)
    meta = spark.createDataFrame([("meta" + json.dumps({"a": "1"}),), ("Recorded at 10:00:00 05/03/2021 (UTC-5) by X",)], "c string")
    got = meta.select(wav.comment_metadata(F.col("c"), "meta"), F.date_format(wav.audiomoth_start(F.col("c")), "yyyy-MM-dd HH:mm")).collect()
    assert got[0][0] == {"a": "1"} and got[1][1] == "2021-03-05 15:00"


def test_streams(spark, tmp_path):
    src, store_dir = str(tmp_path / "in"), str(tmp_path / "store")
    w = spark.createDataFrame([(1, "f", 0.0, 1.0), (2, "f", 0.0, 1.0), (3, "f", 1.0, 2.0)], "window_id long, file string, start_time double, end_time double")
    w.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(w.schema).parquet(src)
        ingest_windows(stream, store_dir, str(tmp_path / "cp")).awaitTermination()
        w.limit(1).write.mode("append").parquet(src)
    assert spark.read.parquet(store_dir).count() == 2
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 05:00:00", "x")], "t string, class string").select(F.to_timestamp("t").alias("start_timestamp"), "class")
    ev.write.parquet(str(tmp_path / "ev"))
    q = detection_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select * from counts").collect()) == [1, 2]


def test_orphan_tracker(spark):
    t = OrphanTracker("t", ("id", "f", "at"), (None, "f", "at", None))
    kinds = lambda: {r.ref_id: r.orphan_kind for r in orphans_on_arrival(spark, t.state).collect()}
    refs = spark.createDataFrame([(1, "k", "2024-01-01"), (2, "z", "2024-01-01")], "id long, f string, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r.ref_id, r.kind, r.open, r.was_open) for r in t.on_batch(refs, None).collect()} == {(1, "missing", True, None), (2, "missing", True, None)}
    assert kinds() == {1: "missing", 2: "missing"}
    parents = spark.createDataFrame([("k", "2024-02-01")], "f string, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r.ref_id, r.kind, r.open, r.was_open) for r in t.on_batch(None, parents).collect()} == {(1, "late", False, True)}
    assert kinds() == {1: "late", 2: "missing"}
    assert [(r.month, r.orphan_kind, r.n_orphans) for r in t.snapshot(spark).collect()] == [("2024-01", "missing", 1)]


def test_entry_lists_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert all(f"p{n}_found" in q for n in (2, 3, 4, 5, 7))


def test_kernel_queries_run(spark):
    q = entry.queries()
    for name in ("gcc_tdoa", "pulse_score", "bandpass_filter", "accel_sequences", "mel_and_pcen", "ribbit_scores", "mlp_scores"):
        assert q[name](spark, "/root/testdata/sf0.001").count() == 500
    r = q["localize_least_squares"](spark, "/root/testdata/sf0.001").where("px is not null").agg(F.avg(F.col("residual_rms"))).first()[0]
    assert not math.isnan(r) and r < 0.5


def test_similarity_of_many_rows(spark):
    import numpy as np

    from fieldchirp.operators import store

    rng = np.random.default_rng(12)
    v = rng.integers(-3, 4, (900, 6)).astype(float)  # many equal scores
    w = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 6)], "window_id long, embedding array<float>")
    q = w.where("window_id % 3 = 0 or window_id > 890").selectExpr("window_id query_id", "embedding vector")
    want = {(i, j, r) for i in range(900) if i % 3 == 0 or i > 890 for r, j in enumerate(np.lexsort((np.arange(900), -(v @ v[i])))[:7].tolist(), 1)}
    for block, rows in ((64, 100), (256, 20_000)):
        assert {(r.query_id, r.window_id, r["rank"]) for r in store.similarity_join(w, q, 7, block=block, rows=rows).collect()} == want
    assert len(store.similarity_join(w.limit(3), q.limit(5), 7).collect()) == 15
    assert store.similarity_join(w, q.limit(0), 7).count() == 0 and store.similarity_join(w.limit(0), q, 7).count() == 0


def test_rows_are_searched_as_queries(spark):
    from fieldchirp.plans.catalog import QUERIES

    d = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert QUERIES["similarity_row_queries"](spark, d).count() == 7 * n
