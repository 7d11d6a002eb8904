"""Queries of clips of samples, spectrograms, augmentation, labels, splits and metrics, each with the SQL it is compared with."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldchirp.functions import dsp, signal, spectro
from fieldchirp.operators import clips, codecs, gps, metrics, pipeline, registry, selection, store
from fieldchirp.plans import catalog
from fieldchirp.plans.catalog import _SCORES, _WIN, CLASSES, FILES, WEIGHTS, _dot_sql, _samples, _scores, _sum, _win, _windows, annotations, files
from fieldchirp.plans.tables import sql_key, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_X = catalog._X


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- clips of samples (64 samples at 64 Hz)

_CUT = f"{_X}, c as (select id, round(i * 0.2, 10) s, x from x, range(0, 5) t(i)), p as (select id, s, x[cast(floor(round(s * 64, 6)) as bigint) + 1 : cast(floor(round((s + 0.25) * 64, 6)) as bigint)] p from c)"


@query(f"with {_CUT} select id, s start_time, round(s + 0.25, 10) end_time, cast(len(p) as integer) n, round(list_sum(p), 6) total from p")
def audio_split(s, d):
    c = clips.split_samples(_samples(s, d), 64, 0.25, samples="x", clip_step=0.2)
    return c.select("id", "start_time", "end_time", F.size("x").alias("n"), _sum(F.col("x")).alias("total"))


@query(f"with {_CUT} select id, s start_time, round(sqrt(list_sum(list_transform(p, lambda v: v * v)) / len(p)), 6) rms from p")
def audio_apply(s, d):
    c = clips.apply_to_clips(_samples(s, d), signal.rms, 64, 0.25, "rms", samples="x", clip_step=0.2)
    return c.select("id", "start_time", F.round("rms", 6).alias("rms"))


@query(f"with {_X} select id, cast(128 as integer) n, round(2 * list_sum(x), 6) total, round(x[64] - x[1], 6) ends, 2.0 duration from x")
def samples_concat(s, d):
    t = signal.Track(F.col("x"), 64)
    c = (t + signal.Track(signal.change_speed(F.col("x"), -1.0), 64)).samples
    return _samples(s, d).select("id", F.size(c).alias("n"), _sum(c).alias("total"), F.round(F.element_at(c, 64) - F.element_at(c, 128), 6).alias("ends"), signal.duration(c, 64).alias("duration"))


@query(f"with {_X}, m as (select id, list_transform(range(0, 80), lambda i: least(greatest(coalesce(x[i + 1], 0.0) * pow(10, -0.15) + case when i >= 10 then coalesce(x[i - 9], 0.0) else 0.0 end * pow(10, -0.3) + case when i >= 30 then coalesce(x[65 - (i - 29)], 0.0) * cast(i - 29 <= 64 as integer) else 0.0 end * 1.0, -1.0), 1.0)) m from x) select id, cast(len(m) as integer) n, round(list_sum(m), 5) total from m")
def samples_mix_offsets(s, d):
    m = signal.mix_tracks([F.col("x"), F.col("x"), F.reverse("x")], 80, [-3.0, -6.0, 0.0], [0, 10, 30])
    return _samples(s, d).select("id", F.size(m).alias("n"), F.round(signal.total(m), 5).alias("total"))


@query(f"with {_X} select id, cast(24 as integer) n, round(list_sum(x[17:40]), 6) total from x")
def samples_trim_timestamps(s, d):
    at = lambda us: F.timestamp_micros(F.lit(1_700_000_000_000_000 + us))
    t = signal.trim_with_timestamps(F.col("x"), 64, at(0), at(250_000), seconds=0.375)
    return _samples(s, d).select("id", F.size(t).alias("n"), _sum(t).alias("total"))


@query("select gps_row_id, timer_count between 100 and 200 as held, cast(timer_count > 500 as integer) above from audiomoth_gps")
def inrange_binarize(s, d):
    t = F.col("timer_count")
    return table(s, d, "audiomoth_gps").select("gps_row_id", signal.inrange(t, 100, 200).alias("held"), signal.binarize(t, 500).alias("above"))


_DIR = [[(1 + 2 * sum(math.cos(2 * math.pi * f * (2 * m - n) / 64) for f in range(1, 16)) + math.cos(math.pi * m) * math.cos(math.pi * n / 2)) / 64 for n in range(64)] for m in range(4)]


@query(f"with {_X} select id, " + ", ".join(f"round(list_dot_product(x, cast({row} as double[])), 6) r{i}" for i, row in enumerate(_DIR)) + " from x")
def resample_half(s, d):
    r = dsp.per_array(lambda x: dsp.resample(x, 64.0, 32.0))(F.col("x"))
    return _samples(s, d).select("id", r.alias("r")).select("id", *[F.round(F.col("r")[i], 6).alias(f"r{i}") for i in range(4)])


_HANN = [0.5 - 0.5 * math.cos(2 * math.pi * i / 16) for i in range(16)]


def _bin(k: int) -> str:
    part = lambda f: "list_dot_product(p, cast([" + ", ".join(repr(_HANN[i] * f(2 * math.pi * k * i / 16)) for i in range(16)) + "] as double[]))"
    return f"{0.5 if k in (0, 8) else 1.0} * (pow({part(math.cos)}, 2) + pow({part(math.sin)}, 2))"


@query(f"with {_X}, p as (select id, t, x[t * 8 + 1 : t * 8 + 16] p from x, range(0, 7) u(t)) select id, t frame, round(sqrt(({' + '.join(_bin(k) for k in range(9))}) * 2.0 / {sum(_HANN) ** 2!r}), 6) rms from p")
def spectrogram_rms(s, d):
    r = dsp.per_array(lambda x: dsp.frame_rms(dsp.power_spectrogram(x, 16)))(F.col("x"))
    return _samples(s, d).select("id", F.posexplode(r).alias("frame", "rms")).select("id", F.col("frame").cast("long").alias("frame"), F.round("rms", 6).alias("rms"))


# ---- spectrograms: the squares of the samples as 8 rows of 8 frames, 10 Hz and 0.5 s apart

_FREQ, _TIMES = [10.0 * i for i in range(8)], [0.5 * i for i in range(8)]
_V = f"{_X}, v as (select id, f, t, x[f * 8 + t + 1] * x[f * 8 + t + 1] p from x, range(0, 8) a(f), range(0, 8) b(t))"


def _spec(s, d):
    row = lambda f: F.transform(F.slice("x", f * 8 + 1, 8), lambda v: v * v)
    return _samples(s, d).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), row).alias("p"))


@query(f"with {_V} select id, cast(4 as integer) n_rows, cast(5 as integer) n_frames, round(sum(p), 6) total from v where f between 2 and 5 and t between 1 and 5 group by 1")
def spectrogram_slices(s, d):
    p, f = spectro.bandpass(F.col("p"), _FREQ, 18.0, 52.0)
    p, _ = spectro.trim(p, _TIMES, 0.6, 2.4)
    n = spectro.shape_of(p)
    return _spec(s, d).select("id", n[0].alias("n_rows"), n[1].alias("n_frames"), _sum(F.flatten(p)).alias("total"))


@query(f"with {_V}, l as (select id, least(greatest(10 * log10(p + 1e-10), -60.0), -15.0) l from v), m as (select id, min(l) a, max(l) b from l group by 1) select id, round(sum(l), 5) limited, round(sum((l - a) / (b - a)), 5) scaled, round(sum((l + 60) / 45 * 255), 4) linear from l join m using (id) group by 1")
def spectrogram_scales(s, d):
    p = spectro.limit_range(spectro.decibels(F.col("p")), -60.0, -15.0)
    return _spec(s, d).select("id", p.alias("p")).select(
        "id", F.round(signal.total(F.flatten("p")), 5).alias("limited"), F.round(signal.total(F.flatten(spectro.min_max_scale(F.col("p")))), 5).alias("scaled"),
        F.round(signal.total(F.flatten(spectro.linear_scale(F.col("p"), (-60.0, -15.0), (0.0, 255.0)))), 4).alias("linear"),
    )


def _level(a: int, b: int) -> str:
    return f"sqrt(sum(case when f between {a} and {b} then case when f in ({a}, {b}) then 0.5 else 1.0 end * p else 0.0 end) * 2.0 / 16)"


@query(f"with {_V} select id, t frame, round(greatest({_level(2, 5)} / 30 - ({_level(0, 1)} + {_level(6, 7)}) / 20, 0.0), 6) amplitude from v group by 1, 2")
def net_amplitude(s, d):
    a = spectro.net_amplitude(F.col("p"), _FREQ, (20.0, 50.0), [(0.0, 10.0), (60.0, 70.0)], 16)
    return _spec(s, d).select("id", F.posexplode(a).alias("frame", "amplitude")).select("id", F.col("frame").cast("long").alias("frame"), F.round("amplitude", 6).alias("amplitude"))


@query(f"with {_V}, i as (select id, 7 - f r, t, 1.0 - (least(greatest(10 * log10(p + 1e-10), -80.0), 0.0) + 80) / 80 v from v) select id, round(sum(v), 5) total, round(sum(case when r = 0 then v else 0.0 end), 5) top from i group by 1")
def spectrogram_image(s, d):
    i = spectro.to_image(F.col("p"), invert=True)
    return _spec(s, d).select("id", F.round(signal.total(F.flatten(i)), 5).alias("total"), F.round(signal.total(F.element_at(i, 1)), 5).alias("top"))


@query(f"with {_V} select id, round(sum(case when f between 2 and 3 or t between 4 and 6 then 0.0 else p end), 6) total from v group by 1")
def spectrogram_masks(s, d):
    p = spectro.mask_frames(spectro.mask_rows(F.col("p"), F.lit(2), F.lit(2)), F.lit(4), F.lit(3))
    return _spec(s, d).select("id", _sum(F.flatten(p)).alias("total"))


# ---- augmentation by keyed hashes

_U = "cast('0x' || substr(md5(concat_ws('|', '{}', cast(id as varchar))), 1, 8) as bigint) / 4294967296.0"


@query(f"with {_X}, g as (select id, list_transform(x, lambda v: least(greatest(v * pow(10.0, (-30 + 30 * {_U.format(3)}) / 20), -1.0), 1.0)) g from x) select id, round(list_sum(g), 6) total, round(list_max(g), 6) top from g")
def random_gain(s, d):
    g = pipeline.random_gain(seed=3, column="x")(_samples(s, d))
    return g.select("id", _sum(F.col("x")).alias("total"), F.round(F.array_max("x"), 6).alias("top"))


@query(f"with {_X}, w as (select id, case when {_U.format(5)} < 0.5 then list_concat(x[cast(floor({_U.format(6)} * 64) as bigint) + 1 : 64], x[1 : cast(floor({_U.format(6)} * 64) as bigint)]) else x end w from x) select id, round(w[1], 6) first, round(w[64], 6) last, cast(len(w) as integer) n from w")
def random_wrap(s, d):
    w = pipeline.random_wrap(seed=5, column="x")(_samples(s, d))
    return w.select("id", F.round(F.element_at("x", 1), 6).alias("first"), F.round(F.element_at("x", 64), 6).alias("last"), F.size("x").alias("n"))


@query(f"with {_X}, a as (select id, x, cast(floor({_U.format(8)} * 53) as bigint) a from x) select id, round(list_sum(x) - list_sum(x[a + 1 : a + 12]), 6) total from a")
def audio_time_mask(s, d):
    return pipeline.time_mask(0.2, seed=8, column="x")(_samples(s, d)).select("id", _sum(F.col("x")).alias("total"))


_ORDER = "row_number() over (order by md5(concat_ws('|', '{}', cast(id as varchar)))) - 1"


@query(
    f"with {_X}, a as (select x.id, x, label, {_ORDER.format(1)} k from x join embeddings e on e.vec_id = x.id), b as (select id, x y, label pair, {_ORDER.format(2).replace('id as', 'id as')} k from a)"
    " select a.id, round(list_sum(list_transform(range(1, 65), lambda i: a.x[i] * 0.7 + b.y[i] * 0.3)), 5) total, cast(a.label = 3 or b.pair = 3 as integer) c3 from a join b using (k)"
)
def overlay_blend(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"), (F.col("label") == 3).cast("int").alias("c3"))
    o = pipeline.overlay(e, e, ["c3"], 0.3, seed=1)
    return o.select("id", F.round(signal.total(F.col("samples")), 5).alias("total"), "c3")


@query(f"with {_X}, t as (select id, x[1:48] t from x), g as (select id, list_transform(t, lambda v: v / greatest(list_max(t), -list_min(t))) g from t) select id, round(list_sum(g), 6) total from g")
def pipeline_forward(s, d):
    p = pipeline.Pipeline().insert(pipeline.Step("scale", pipeline.on_samples(signal.normalize, "x"))).insert(pipeline.Step("fit", pipeline.fit_length(48, column="x")), before="scale")
    p = p.insert(pipeline.Step("gain", pipeline.random_gain(column="x"), augments=True)).insert(pipeline.Step("off", pipeline.on_samples(F.reverse, "x"), bypass=True))
    return p.forward(_samples(s, d), augment=False).select("id", _sum(F.col("x")).alias("total"))


@query("with m as (select " + ", ".join(f"max(cast(embedding[{i}] as double)) m{i}" for i in range(1, 5)) + " from embeddings) select vec_id id, " + ", ".join(f"round(cast(embedding[{i}] as double) / m{i}, 6) f{i}" for i in range(1, 5)) + " from embeddings, m")
def rescale_features(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i - 1].cast("double").alias(f"f{i}") for i in range(1, 5)])
    top = e.agg(*[F.max(f"f{i}") for i in range(1, 5)]).first()
    return e.select("id", *[F.round(F.col(f"f{i}") / F.lit(top[i - 1]), 6).alias(f"f{i}") for i in range(1, 5)])


# ---- labels and splits


@query("with f as (select annotation as class, min(ann_id) k from boxed_annotations where annotation is not null group by 1) select cast(row_number() over (order by k, class) - 1 as integer) class_index, class from f")
def class_table(s, d):
    return codecs.class_table(table(s, d, "boxed_annotations"), "annotation", "ann_id")


_IN = ", ".join(f"'{c}'" for c in CLASSES)


@query(f"with a as (select {sql_key('audio_file')} audio_file, list(distinct annotation order by annotation) l from boxed_annotations where annotation in ({_IN}) and {sql_key('audio_file')} is not null group by 1) select audio_file, array_to_string(list_transform(l, lambda c: list_position([{_IN}], c) - 1), ',') ids, array_to_string(l, ',') names from a")
def codec_names_integers(s, d):
    a = annotations(s, d).where(F.col("annotation").isin(CLASSES) & F.col("audio_file").isNotNull()).groupBy("audio_file").agg(F.array_sort(F.collect_set("annotation")).alias("l"))
    ids = codecs.categorical_to_integers(F.col("l"), CLASSES)
    return a.select("audio_file", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.array_join(codecs.integers_to_categorical(ids, CLASSES), ",").alias("names"))


_R = "md5(concat_ws('|', '{}', cast({} as varchar)))"


@query(f"with r as (select ann_id, row_number() over (order by {_R.format(2, 'ann_id')}) k, count(*) over () n from boxed_annotations) select ann_id, case when k <= cast(floor(0.25 * n + 0.5) as bigint) then 'test' else 'train' end split from r")
def split_rows_exact(s, d):
    return selection.split_exact(table(s, d, "boxed_annotations").select("ann_id"), ["ann_id"], 0.25, 2)


@query(f"select ann_id from boxed_annotations order by {_R.format(6, 'ann_id')}, ann_id limit 40")
def sample_rows_seeded(s, d):
    return selection.sample(table(s, d, "boxed_annotations").select("ann_id"), ["ann_id"], 40, 6)


@query("select ann_id, cast((row_number() over (order by ann_id) - 1) // 128 as bigint) batch from boxed_annotations")
def batch_numbers(s, d):
    return selection.batch_of(table(s, d, "boxed_annotations").select("ann_id"), ["ann_id"], 128).select("ann_id", F.col("batch").cast("long").alias("batch"))


# ---- metrics

_ARG = "p as (select label target, cast(list_position(v, list_max(v)) - 1 as integer) pred from (select label, [" + ", ".join(_dot_sql(w) for w in WEIGHTS.values()) + "] v from embeddings))"


def _arg(s, d):
    v = F.array(*[F.round(store.dot(F.col("embedding"), F.array(*[F.lit(x) for x in w])), 6) for w in WEIGHTS.values()])
    return _windows(s, d).select(F.col("label").alias("target"), (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("pred"))


@query(
    f"with {_ARG}, c as (select c, count(*) filter (target = c and pred = c) tp, count(*) filter (target = c or pred = c) a, count(*) filter (pred = c) p, count(*) filter (target = c) t from p, (select distinct target c from p union select distinct pred from p) group by 1)"
    " select round(coalesce(sum(tp) filter (c = 1) / nullif(sum(p) filter (c = 1), 0), 0.0), 6) as precision, round(coalesce(sum(tp) filter (c = 1) / nullif(sum(t) filter (c = 1), 0), 0.0), 6) recall, round(coalesce(2 * sum(tp) filter (c = 1) / nullif(sum(p + t) filter (c = 1), 0), 0.0), 6) f1, round(avg(tp / a), 6) jaccard, round(1 - sum(tp) / sum(t), 6) error_rate from c"
)
def single_target_metrics(s, d):
    m = metrics.single_target(_arg(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"with {_ARG} select target, pred, count(*) n from p group by 1, 2")
def confusion_matrix(s, d):
    return metrics.confusion_matrix(_arg(s, d))


@query(
    f"with {_SCORES}, b as (select class, target, least(49, floor(round((1 / (1 + exp(-score))) / (1.0 / 49), 9))) b from scores), g as (select class, b, sum(target) p, count(*) a from b group by 1, 2),"
    " w as (select *, sum(p) over (partition by class order by b desc) cp, sum(a) over (partition by class order by b desc) ca from g) select class, case when sum(p) > 0 then round(sum(p * cp / ca) / sum(p), 6) end ap_binned from w group by 1"
)
def average_precision_50_thresholds(s, d):
    from fieldchirp.functions import losses

    m = metrics.binned_average_precision(_scores(s, d).withColumn("score", losses.sigmoid(F.col("score"))))
    return m.select("class", F.round("ap_binned", 6).alias("ap_binned"))


# ---- store


@query(f"with {_WIN}, {FILES} select w.window_id, w.file, w.start_time, w.end_time, f.recorded_at datetime, p.dep_name deployment, p.project from win w left join files f using (file) left join deployments p on f.deployment_id = p.deployment_id")
def windows_to_frame(s, d):
    w = registry.windows_frame(store.normal_windows(_win(s, d)), files(s, d), table(s, d, "deployments"))
    return w.select("window_id", "file", "start_time", "end_time", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "deployment", "project")


@query(f"with {_WIN}, r as (select vec_id window_id, {_dot_sql(WEIGHTS['c2'])} score from embeddings order by score desc, window_id limit 20) select w.file, w.start_time, w.end_time, w.window_id, r.score sort_score from r join win w using (window_id)")
def search_results_collated(s, d):
    return registry.collate(store.similarity_search(_windows(s, d), WEIGHTS["c2"], 20), store.normal_windows(_win(s, d)))


# ---- without SQL: fixtures and brute force in the tests


@query()
def gps_pairs(s, d):
    g = table(s, d, "audiomoth_gps").select(
        F.col("audio_file").alias("file"), F.col("pps_number").cast("long").alias("pps_number"), F.col("total_samples").cast("long").alias("total_samples"), F.col("timer_count").cast("long").alias("timer_count"), "status",
        F.lit(None).cast("long").alias("message_us"), F.unix_micros(F.try_to_timestamp(F.concat("last_rmc_gps_time", F.lit("+00:00")))).alias("gps_us"),
    )
    return gps.paired(g, 48_000.0, 50.0)


@query()
def mel_and_pcen(s, d):
    def run(x):
        m = dsp.mel_filterbank(16, 64.0, 6) @ dsp.power_spectrogram(x, 16)
        return [float(m.sum()), float(dsp.pcen(m).sum())]

    return _samples(s, d).select("id", dsp.per_array(run)(F.col("x")).alias("mel_pcen"))


@query()
def ribbit_scores(s, d):
    return _samples(s, d).select("id", dsp.per_array(lambda x: [r[2] for r in dsp.ribbit_scores(x, 64.0, (8.0, 24.0), (1.0, 3.0), 0.5, 16)])(F.col("x")).alias("scores"))


@query()
def mlp_scores(s, d):
    layers = [([w[:64] for w in WEIGHTS.values()], [0.0] * 10), ([[1.0] * 10, [0.5] * 10], [0.1, 0.2])]
    return _windows(s, d).select("window_id", store.mlp_forward(layers)(F.col("embedding")).alias("logits"))


# ---- losses, draws, strata, inference




@query(f"with x as (select vec_id id, [" + ", ".join(_dot_sql(w) for w in WEIGHTS.values()) + "] v, label from embeddings) select id, round(ln(list_sum(list_transform(v, lambda a: exp(a - list_max(v))))) + list_max(v) - v[label + 1], 6) loss from x")
def cross_entropy_hot(s, d):
    from fieldchirp.functions import losses

    v = F.array(*[F.round(store.dot(F.col("embedding"), F.array(*[F.lit(x) for x in w])), 6) for w in WEIGHTS.values()])
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return _windows(s, d).select(F.col("window_id").alias("id"), F.round(losses.cross_entropy_hot(v, hot), 6).alias("loss"))


@query(
    f"with {_SCORES}, f as (select class, cast(sum(target) as double) f from scores group by 1), r as (select *, sum(target / f) over (partition by window_id) held, (select sum(f) from f) n from scores join f using (class)),"
    " w as (select *, (case when held > 0 then 1 / (1 + exp(-0.2 * (1 / f / held - 0.1))) else 1.0 end + 10) / case when target = 1 then 1.0 else 0.2 end weight, (score - ln(n / f - 1) * 0.25) * case when target = 1 then 1.0 else 0.2 end z from r)"
    " select window_id, class, round(weight, 5) weight, round(weight * (greatest(z, 0) - z * target + ln(1 + exp(-abs(z)))), 5) loss from w"
)
def resample_loss(s, d):
    from fieldchirp.functions import losses

    r = losses.resample_loss(_scores(s, d).select("window_id", "class", F.col("score").alias("x"), F.col("target").alias("t")))
    return r.select("window_id", "class", F.round("weight", 5).alias("weight"), F.round("loss", 5).alias("loss"))


_HEX = "cast('0x' || substr(md5(concat_ws('|', '4', '{}', cast(draw as varchar))), 1, {}) as bigint)"


@query(
    "with a as (select ann_id, annotation, row_number() over (partition by annotation order by md5(concat_ws('|', '4', cast(ann_id as varchar)))) turn from boxed_annotations where annotation is not null),"
    " c as (select annotation, count(*) m, row_number() over (order by annotation) - 1 i, count(*) over () n from a group by 1), d as (select range draw from range(0, 500))"
    f" select draw, annotation, ann_id from d join c on {_HEX.format('class', 8)} % c.n = c.i join a using (annotation) where a.turn = {_HEX.format('row', 12)} % c.m + 1"
)
def weighted_draws(s, d):
    return selection.weighted_draws(table(s, d, "boxed_annotations").where("annotation is not null").select("ann_id", "annotation"), "annotation", ["ann_id"], 500, 4)


@query("select ann_id, annotation, cast((row_number() over (partition by annotation order by md5(concat_ws('|', '9', cast(ann_id as varchar)))) - 1) // 3 as bigint) visit from boxed_annotations where annotation is not null")
def class_turns(s, d):
    a = table(s, d, "boxed_annotations").where("annotation is not null").select("ann_id", "annotation")
    return selection.class_turns(a, "annotation", ["ann_id"], 3, 9).select("ann_id", "annotation", F.col("visit").cast("long").alias("visit"))


_PS = f"ps as (select w.window_id, w.deployment_id, cast(cast(f.recorded_at as date) as varchar) date_range, p.test_species score from win w join localizer_preds p on p.pred_id = w.window_id join files f on f.file = w.file where f.recorded_at is not null and p.test_species >= 0.2 and not isnan(p.test_species))"


@query(f"with {_WIN}, {FILES}, {_PS}, r as (select *, row_number() over (partition by deployment_id, date_range order by score desc, window_id) k from ps) select deployment_id, date_range, window_id, cast(k as integer) as \"rank\" from r where k <= 2")
def stratified_by_day(s, d):
    p = table(s, d, "localizer_preds").where(~F.isnan("test_species")).select(F.col("pred_id").alias("window_id"), "file", "start_time", "end_time", F.col("deployment_id"), F.col("test_species").alias("score"))
    w = store.normal_windows(p).join(files(s, d).select("file", "recorded_at"), "file").withColumn("class", F.lit("species"))
    return store.stratified_selection(w, 2, strata=("deployment_id",), by_day=True, min_score=0.2).select("deployment_id", "date_range", "window_id", "rank")


@query(f"with {_WIN}, {catalog.ANN} select window_id from win w where deployment_id < 20 and end_time > start_time and exists (select 1 from ann a where a.audio_file = w.file and a.end_time > a.start_time and a.start_time < w.end_time and a.end_time > w.start_time)")
def find_windows_annotated(s, d):
    w = store.normal_windows(_win(s, d))
    return store.filter_windows(w, windows_filter="deployment_id < 20", annotated=annotations(s, d)).select("window_id")


@query(f"with {_WIN} select file, start_time, end_time, arg_min(window_id, md5(concat_ws('|', '3', cast(window_id as varchar)))) window_id from win where file is not null and start_time is not null and end_time is not null group by 1, 2, 3")
def match_windows_random(s, d):
    w = store.normal_windows(_win(s, d)).where("file is not null and start_time is not null and end_time is not null")
    return store.random_match(w.select("file", "start_time", "end_time").distinct(), w, 3)


@query(f"with {_X} select 'f' || cast(id as varchar) file, 0.0 start_time, 1.0 end_time, round(1 / (1 + exp(-list_dot_product(x[1:48], cast({WEIGHTS['c0'][:48]} as double[])))), 6) a, round(1 / (1 + exp(-list_dot_product(x[1:48], cast({WEIGHTS['c1'][:48]} as double[])))), 6) b from x")
def predict_scores(s, d):
    from fieldchirp.operators import inference

    c = _samples(s, d).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"), F.col("id"), F.col("x").alias("samples"))
    score = store.mlp_forward([([WEIGHTS["c0"][:48], WEIGHTS["c1"][:48]], [0.0, 0.0])])
    p = inference.predict(c, inference.audio_preset(48), score, ["a", "b"], "sigmoid")
    return p.select("file", "start_time", "end_time", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
