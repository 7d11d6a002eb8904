"""Queries of the library's own operators, each with the SQL it is compared with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldchirp.functions import dsp, losses, signal
from fieldchirp.functions.keys import clean_key, filename_first_part, nan_to_null, parent_folder, two_parents
from fieldchirp.operators import annotations as ann
from fieldchirp.operators import clips, codecs, localize, metrics, selection, store
from fieldchirp.operators.nearby import region_of
from fieldchirp.operators.small import if_small
from fieldchirp.plans.tables import sql_key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLASSES = ["reedling", "mire thrush", "dusk warbler", "tin whistler", "fen rail", "marsh ticker", "grey croaker", "hill piper"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- tables as the operators want them, in both languages

_KEY = sql_key("audio_file")
ANN = f"""ann as (select ann_id, {_KEY} audio_file, annotation, case when not isnan(start_time) then start_time end start_time,
 case when not isnan(end_time) then end_time end end_time, case when not isnan(low_f) then low_f end low_f, case when not isnan(high_f) then high_f end high_f from boxed_annotations)"""
FILES = f"""files as (select {sql_key("filename")} file, (array_agg(case when not isnan(duration) then duration end order by recording_id))[1] duration, (array_agg(deployment_id order by recording_id))[1] deployment_id,
 (array_agg(recorded_at order by recording_id))[1] recorded_at from recordings where {sql_key("filename")} is not null group by 1)"""


def annotations(s: SparkSession, d: str) -> DataFrame:
    return ann.annotation_table(table(s, d, "boxed_annotations")).select("ann_id", "audio_file", "annotation", "start_time", "end_time", "low_f", "high_f")


def files(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "recordings").select(clean_key("filename").alias("file"), nan_to_null("duration").alias("duration"), "deployment_id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), "recording_id")
    return clips.first_per_file(r.where("file is not null"), "recording_id").drop("recording_id")


def _grid_sql(clip: float, step: float, final: str | None) -> str:
    base = f"g as (select file, duration, round(i * {step}, 10) s from files, lateral unnest(range(0, cast(ceil(duration / {step}) as bigint))) t(i) where duration > 0)"
    e = f"round(s + {clip}, 10)"
    body = {
        None: f"select file, s start_time, {e} end_time from g where s < duration and {e} <= duration",
        "remainder": f"select file, s start_time, least({e}, duration) end_time from g where s < duration",
        "extend": f"select file, s start_time, {e} end_time from g where s < duration",
        "full": f"select distinct file, s start_time, round(s + {clip}, 10) end_time from (select file, case when {e} > duration then greatest(round(duration - {clip}, 10), 0.0) else s end s from g where s < duration)",
    }[final]
    return f"{base}, clips as ({body})"


def _grid_query(name: str, clip: float, final: str | None, **kw) -> None:
    step = clips.clip_step_of(clip, **kw)

    def f(s: SparkSession, d: str) -> DataFrame:
        return clips.clip_grid(files(s, d).select("file", "duration"), clip, final_clip=final, **kw)

    f.__name__ = name
    query(f"with {FILES}, {_grid_sql(clip, step, final)} select * from clips")(f)


for _name, _clip, _final, _kw in (
    ("clip_grid_extend", 7.0, "extend", {}),
    ("clip_grid_remainder", 7.0, "remainder", {}),
    ("clip_grid_full", 7.0, "full", {}),
    ("clip_grid_none", 7.0, None, {}),
    ("clip_grid_overlap", 7.0, "extend", {"clip_overlap": 2.5}),
    ("clip_grid_fraction", 8.0, "full", {"overlap_fraction": 0.25}),
    ("clip_grid_step", 5.0, "remainder", {"clip_step": 9.0}),
):
    _grid_query(_name, _clip, _final, **_kw)


@query(f"with {FILES} select distinct file, cast(null as double) start_time, cast(null as double) end_time from files where duration is null or duration <= 0")
def invalid_files(s, d):
    return clips.invalid_files(files(s, d))


@query(f"with {FILES}, {_grid_sql(60.0, 60.0, 'extend')} select '/audio/' || file source, start_time, round(end_time - start_time, 10) duration from clips")
def sample_rows(s, d):
    return clips.sample_rows(clips.clip_grid(files(s, d).select("file", "duration"), 60.0), "/audio/")


# ---- annotations

_OV = "least(c.end_time, a.end_time) - greatest(c.start_time, a.start_time)"
_HIT = f"clips c join ann a on c.file = a.audio_file and c.start_time < a.end_time and c.end_time > a.start_time and a.annotation is not null and a.end_time > a.start_time"
_IN = ", ".join(f"'{c}'" for c in CLASSES)
_CASES = ", ".join(f"coalesce(bool_or(h.annotation = '{c}'), false) \"{c}\"" for c in CLASSES)


@query(f"with {ANN}, {FILES}, {_grid_sql(5.0, 5.0, 'extend')} select c.file, c.start_time, c.end_time, a.annotation, a.start_time ann_start, a.end_time ann_end, {_OV} overlap from {_HIT} where {_OV} >= 0.2")
def interval_join_overlap(s, d):
    return ann.grid_matches(files(s, d), annotations(s, d), 5.0, 0.2)


def _multihot(where: str) -> str:
    return f"with {ANN}, {FILES}, {_grid_sql(5.0, 5.0, 'extend')}, h as (select c.file, c.start_time, a.annotation from {_HIT} where {where}) select c.file, c.start_time, c.end_time, {_CASES} from clips c left join h on c.file = h.file and c.start_time = h.start_time group by 1, 2, 3"


@query(_multihot(f"{_OV} >= 0.2"))
def labels_multihot(s, d):
    return ann.clip_labels(files(s, d), annotations(s, d), CLASSES, 5.0, 0.2)


@query(_multihot(f"{_OV} > 0 and ({_OV} >= 1.5 or ({_OV}) / (a.end_time - a.start_time) >= 0.5)"))
def labels_multihot_fraction(s, d):
    return ann.clip_labels(files(s, d), annotations(s, d), CLASSES, 5.0, 1.5, 0.5)


_IDX = "list_position([" + _IN + "], a.annotation) - 1"


@query(f"with {ANN}, {FILES}, {_grid_sql(5.0, 5.0, 'extend')}, h as (select c.file, c.start_time, cast({_IDX} as integer) i from {_HIT} where {_OV} >= 0.2 and a.annotation in ({_IN})), l as (select file, start_time, list_sort(list(distinct i)) labels from h group by 1, 2) select c.file, c.start_time, c.end_time, array_to_string(coalesce(l.labels, []), ',') labels from clips c left join l on c.file = l.file and c.start_time = l.start_time")
def labels_integer_lists(s, d):
    out = ann.clip_label_lists(files(s, d), annotations(s, d), CLASSES, 5.0, 0.2, integers=True)
    return out.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query(f"with {ANN}, {FILES}, {_grid_sql(5.0, 5.0, 'extend')}, h as (select c.file, c.start_time, {_IDX} i, a.annotation from {_HIT} where {_OV} >= 0.2 and a.annotation in ({_IN})), l as (select file, start_time, string_agg(annotation, ',' order by i) labels from h group by 1, 2) select c.file, c.start_time, c.end_time, coalesce(l.labels, '') labels from clips c left join l on c.file = l.file and c.start_time = l.start_time")
def labels_keep_duplicates(s, d):
    out = ann.clip_label_lists(files(s, d), annotations(s, d), CLASSES, 5.0, 0.2, keep_duplicates=True)
    return out.withColumn("labels", F.array_join("labels", ","))


@query(f"with {ANN} select * from ann where annotation in ('reedling', 'fen rail') or annotation is null")
def subset_labels(s, d):
    return ann.subset(annotations(s, d), ["reedling", "fen rail", None])


_T = "ann_id, audio_file, annotation, low_f, high_f"


@query(f"with {ANN} select {_T}, greatest(start_time, 10.0) - 10.0 start_time, least(end_time, 30.0) - 10.0 end_time from ann where end_time >= 10 and start_time < 30")
def trim_trim(s, d):
    return ann.trim(annotations(s, d), 10, 30)


@query(f"with {ANN} select {_T}, start_time - 10.0 start_time, end_time - 10.0 end_time from ann where end_time >= 10 and start_time < 30")
def trim_keep(s, d):
    return ann.trim(annotations(s, d), 10, 30, "keep")


@query(f"with {ANN} select {_T}, start_time - 10.0 start_time, end_time - 10.0 end_time from ann where start_time >= 10 and end_time <= 30 and end_time >= 10 and start_time < 30")
def trim_remove(s, d):
    return ann.trim(annotations(s, d), 10, 30, "remove")


_B = "ann_id, audio_file, annotation, start_time, end_time"
_BIN = "least(high_f, 6000.0) - greatest(low_f, 1000.0) > 0"


@query(f"with {ANN} select {_B}, greatest(low_f, 1000.0) low_f, least(high_f, 6000.0) high_f from ann where low_f is not null and high_f is not null and {_BIN}")
def bandpass_trim(s, d):
    return ann.bandpass(annotations(s, d), 1000, 6000)


@query(f"with {ANN} select {_B}, low_f, high_f from ann where {_BIN} and low_f >= 1000 and high_f <= 6000")
def bandpass_remove(s, d):
    return ann.bandpass(annotations(s, d), 1000, 6000, "remove")


@query(f"with {ANN} select ann_id, audio_file, case annotation when 'reedling' then 'REED' when 'fen rail' then 'RAIL' else annotation end annotation, start_time, end_time, low_f, high_f from ann")
def convert_labels(s, d):
    return ann.convert_labels(annotations(s, d), {"reedling": "REED", "fen rail": "RAIL"})


@query("select audio_file, annotation, cast(null as double) extra from boxed_annotations union all select file, 'window', test_species from localizer_preds")
def concat_tables(s, d):
    a = table(s, d, "boxed_annotations").select("audio_file", "annotation")
    b = table(s, d, "localizer_preds").select(F.col("file").alias("audio_file"), F.lit("window").alias("annotation"), F.col("test_species").alias("extra"))
    return ann.concat([a, b])


@query("select annotation, min(ann_id) first_seen from boxed_annotations where annotation is not null group by 1")
def unique_labels(s, d):
    return ann.unique_labels(table(s, d, "boxed_annotations"), "ann_id")


@query("select " + ", ".join(f"coalesce(max(cast(annotation = '{c}' as integer)), 0) \"{c}\"" for c in [*CLASSES, "unheard"]) + " from boxed_annotations")
def global_multi_hot(s, d):
    return ann.global_multi_hot(table(s, d, "boxed_annotations"), [*CLASSES, "unheard"])


@query(f"with {ANN}, {FILES} select distinct file from files where file not in (select audio_file from ann where audio_file is not null)")
def files_without_annotations(s, d):
    return ann.files_without_annotations(files(s, d), annotations(s, d))


@query(f"with {ANN} select audio_file, count(*) n_boxes, round(sum(end_time - start_time), 6) total_s from ann where audio_file is not null group by 1")
def boxes_nested_round_trip(s, d):
    back = ann.unnest_boxes(ann.nested_boxes(annotations(s, d).where("audio_file is not null"), ("audio_file",)))
    return back.groupBy("audio_file").agg(F.count("*").alias("n_boxes"), F.round(F.sum(F.col("end_time") - F.col("start_time")), 6).alias("total_s"))


@query(f"with {ANN} select ann_id, greatest(0.0, least(start_time + 1, end_time) - start_time) first_second, case when end_time > start_time then greatest(0.0, least(end_time, start_time + 1) - start_time) / (end_time - start_time) end fraction from ann where end_time >= start_time")
def overlap_lengths(s, d):
    a = annotations(s, d).where("end_time >= start_time")
    s0, e0 = F.col("start_time"), F.col("end_time")
    return a.select("ann_id", ann.overlap(s0, e0, s0, s0 + 1).alias("first_second"), ann.overlap_fraction(s0, e0, s0, s0 + 1).alias("fraction"))


# ---- codecs

_LISTS = f"lists as (select {_KEY} audio_file, list(distinct annotation order by annotation) labels from boxed_annotations where annotation is not null and {_KEY} is not null group by 1)"


def _lists(s, d):
    a = annotations(s, d).where("annotation is not null and audio_file is not null")
    return a.groupBy("audio_file").agg(F.array_sort(F.collect_set("annotation")).alias("labels"))


@query(f"with {_LISTS} select audio_file, " + " || ".join(f"cast(cast(list_contains(labels, '{c}') as integer) as varchar)" for c in CLASSES) + " hot from lists")
def categorical_to_multihot(s, d):
    return _lists(s, d).select("audio_file", F.array_join(codecs.categorical_to_multi_hot(F.col("labels"), CLASSES).cast("array<string>"), "").alias("hot"))


@query(f"with {_LISTS} select audio_file, array_to_string(list_filter([{_IN}], lambda c: list_contains(labels, c)), ',') labels from lists")
def multihot_to_categorical(s, d):
    hot = codecs.categorical_to_multi_hot(F.col("labels"), CLASSES)
    return _lists(s, d).select("audio_file", F.array_join(codecs.multi_hot_to_categorical(hot, CLASSES), ",").alias("labels"))


@query(f"with {_LISTS} select audio_file, array_to_string(list_filter({list(range(len(CLASSES)))}, lambda i: list_contains(labels, [{_IN}][i + 1])), ',') labels from lists")
def multihot_to_integers(s, d):
    hot = codecs.categorical_to_multi_hot(F.col("labels"), CLASSES)
    back = codecs.multi_hot_to_integers(codecs.integer_to_multi_hot(codecs.multi_hot_to_integers(hot), len(CLASSES)))
    return _lists(s, d).select("audio_file", F.array_join(back.cast("array<string>"), ",").alias("labels"))


@query(f"with {ANN} select audio_file, annotation as class, cast(1 as double) as value from ann where audio_file is not null and annotation in ({_IN}) group by 1, 2")
def melt_and_spread(s, d):
    hot = annotations(s, d).where("audio_file is not null").groupBy("audio_file").agg(*[F.max((F.col("annotation") == c).cast("int")).alias(c) for c in CLASSES])
    wide = codecs.spread(codecs.melt(hot, ["audio_file"], CLASSES), ["audio_file"], CLASSES)
    return codecs.melt(wide, ["audio_file"], CLASSES).where("value = 1")


# ---- selection

_H = "md5(concat_ws('|', '{}', {}))"
_FILEHOT = f"hot as (select {_KEY} file, " + ", ".join(f"cast(coalesce(bool_or(annotation = '{c}'), false) as integer) \"{c}\"" for c in CLASSES) + f" from boxed_annotations where {_KEY} is not null group by 1)"


def _filehot(s, d):
    a = annotations(s, d).where("audio_file is not null")
    return a.groupBy(F.col("audio_file").alias("file")).agg(*[F.coalesce(F.bool_or(F.col("annotation") == c), F.lit(False)).cast("int").alias(c) for c in CLASSES])


@query(f"with {_FILEHOT} select " + ", ".join(f'cast(sum("{c}") as bigint) "{c}"' for c in CLASSES) + " from hot")
def class_counts(s, d):
    return selection.class_counts(_filehot(s, d), CLASSES)


@query(f"with {ANN} select ann_id, audio_file, case when cast('0x' || substr({_H.format(7, 'audio_file')}, 1, 8) as bigint) < {int(0.2 * 2**32)} then 'test' else 'train' end split from ann where audio_file is not null")
def split_by_file(s, d):
    return selection.split_by_file(annotations(s, d).where("audio_file is not null").select("ann_id", "audio_file"), 0.2, 7, "audio_file")


@query(
    f"with {_FILEHOT}, t as (select file, c from hot, unnest(list_filter([{_IN}], lambda c: case c " + " ".join(f"when '{c}' then \"{c}\" = 1" for c in CLASSES) + " end)) u(c)),"
    f" r as (select *, count(*) over (partition by c) m, row_number() over (partition by c order by {_H.format(3, 'c, file')}, file) k from t),"
    " n as (select *, case when m < 60 then 60 // m + cast(k <= 60 % m as integer) else cast(k <= 60 as integer) end copies from r)"
    " select file, c resampled_class, cast(copies as integer) copies from n where copies > 0"
)
def resample_up_down(s, d):
    out = selection.resample(_filehot(s, d), ["file"], CLASSES, 60, n_negatives=0, seed=3)
    return out.groupBy("file", "resampled_class").agg(F.count("*").cast("int").alias("copies"))


@query(
    f"with a as (select ann_id, annotation, count(*) over (partition by annotation) m, row_number() over (partition by annotation order by {_H.format(5, 'cast(ann_id as varchar)')}) k from boxed_annotations where annotation is not null),"
    " x as (select max(m) n from a) select ann_id, annotation, cast(n // m + cast(k <= n % m as integer) as integer) copies from a, x"
)
def upsample_labels(s, d):
    a = table(s, d, "boxed_annotations").where("annotation is not null").select("ann_id", "annotation")
    return selection.upsample(a, "annotation", ["ann_id"], 5).groupBy("ann_id", "annotation").agg(F.count("*").cast("int").alias("copies"))


@query(f"select ann_id, annotation, row_number() over (partition by annotation order by {_H.format(9, 'cast(ann_id as varchar)')}) turn from boxed_annotations where annotation is not null")
def class_aware_order(s, d):
    a = table(s, d, "boxed_annotations").where("annotation is not null").select("ann_id", "annotation")
    return selection.class_aware_order(a, "annotation", ["ann_id"], 9)


@query(
    "with n as (select annotation, count(*) class_n from boxed_annotations where annotation is not null group by 1)"
    f" select ann_id, round(1.0 / class_n, 9) weight, round(-ln((cast('0x' || substr({_H.format(4, 'cast(ann_id as varchar)')}, 1, 8) as bigint) + 0.5) / 4294967296.0) * class_n, 6) race from boxed_annotations join n using (annotation)"
)
def weighted_draw_keys(s, d):
    a = table(s, d, "boxed_annotations").where("annotation is not null").select("ann_id", "annotation")
    return selection.weighted_order(a, "annotation", ["ann_id"], 4).select("ann_id", F.round("weight", 9).alias("weight"), F.round("race", 6).alias("race"))


@query("select pred_id from localizer_preds where test_species is null or isnan(test_species)")
def unlabelled_samples(s, d):
    return selection.unlabelled(table(s, d, "localizer_preds").withColumn("test_species", nan_to_null("test_species")), ["test_species"]).select("pred_id")


# ---- scores and metrics: embeddings under fixed linear classifiers

WEIGHTS = {f"c{k}": [round(math.sin((k + 1) * (i + 1) * 0.37), 4) for i in range(64)] for k in range(10)}


def _dot_sql(w: list[float]) -> str:
    return f"round(list_dot_product(cast(embedding as double[]), cast({w} as double[])), 6)"


_SCORES = "scores as (" + " union all ".join(f"select vec_id window_id, label, 'c{k}' as class, {_dot_sql(w)} score, cast(label = {k} as integer) target from embeddings" for k, w in enumerate(WEIGHTS.values())) + ")"


def _windows(s, d):
    return table(s, d, "embeddings").withColumnRenamed("vec_id", "window_id")


def _scores(s, d):
    return store.class_scores(_windows(s, d), WEIGHTS).withColumn("target", (F.concat(F.lit("c"), F.col("label").cast("string")) == F.col("class")).cast("int"))


@query(f"with {_SCORES} select window_id, class, score, target from scores")
def classifier_scores(s, d):
    return _scores(s, d).select("window_id", "class", "score", "target")


_PRED = f"{_SCORES}, p as (select *, cast(score >= 0.1 as integer) pred from scores), c as (select class, count(*) filter (pred = 1 and target = 1) tp, count(*) filter (pred = 1 and target = 0) fp, count(*) filter (pred = 0 and target = 1) fn, count(*) filter (pred = 0 and target = 0) tn from p group by 1)"


def _pred(s, d):
    return _scores(s, d).withColumn("pred", metrics.at_threshold("score", 0.1))


@query(f"with {_PRED} select window_id, class, pred from p")
def threshold_multi_target(s, d):
    return _pred(s, d).select("window_id", "class", "pred")


@query("select vec_id window_id, list_position(v, list_max(v)) - 1 best from (select vec_id, [" + ", ".join(_dot_sql(w) for w in WEIGHTS.values()) + "] v from embeddings)")
def argmax_single_target(s, d):
    scores = F.array(*[F.round(store.dot(F.col("embedding"), F.array(*[F.lit(x) for x in w])), 6) for w in WEIGHTS.values()])
    hot = metrics.argmax_one_hot(scores)
    return _windows(s, d).select("window_id", (F.array_position(hot, 1) - 1).cast("int").alias("best"))


@query(f"with {_PRED} select * from c")
def confusion_counts(s, d):
    return metrics.confusion(_pred(s, d))


_P, _R = "case when tp + fp > 0 then tp / (tp + fp) else 0.0 end", "case when tp + fn > 0 then tp / (tp + fn) else 0.0 end"
_F1, _J = "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end", "case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 0.0 end"


@query(f"with {_PRED} select class, case when tp + fn > 0 then round({_P}, 6) end as precision, case when tp + fn > 0 then round({_R}, 6) end recall, case when tp + fn > 0 then round({_F1}, 6) end f1, round({_J}, 6) jaccard, tp + fn support from c")
def precision_recall_f1(s, d):
    m = metrics.precision_recall_f1(_pred(s, d))
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "jaccard")], "support")


@query(f"with {_PRED} select round(avg({_P}), 6) as precision, round(avg({_R}), 6) recall, round(avg({_F1}), 6) f1, round(avg({_J}), 6) jaccard, round(sum(fp + fn) / sum(tp + fp + fn + tn), 6) hamming from c")
def macro_metrics(s, d):
    m = metrics.macro(_pred(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_RANK = """r as (select class, score, target, rank() over (partition by class order by score) + (count(*) over (partition by class, score) - 1) / 2.0 mid,
 sum(target) over (partition by class order by score desc) cp, count(*) over (partition by class order by score desc) ca from {})"""
_RANKED = "select class, case when sum(target) > 0 and sum(target) < count(*) then round((sum(mid) filter (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))), 6) end au_roc, case when sum(target) > 0 then round(sum(cp / ca) filter (target = 1) / sum(target), 6) end avg_precision, cast(sum(target) as bigint) support from r group by 1"


@query(f"with {_SCORES}, {_RANK.format('scores')} {_RANKED}")
def auroc_average_precision(s, d):
    return metrics.ranking(_scores(s, d)).select("class", F.round("au_roc", 6).alias("au_roc"), F.round("avg_precision", 6).alias("avg_precision"), "support")


@query(f"with {_SCORES}, known as (select * from scores where (window_id + cast(substr(class, 2) as integer)) % 3 <> 0), {_RANK.format('known')} {_RANKED}")
def nan_aware_metrics(s, d):
    unknown = F.pmod(F.col("window_id") + F.substring("class", 2, 2).cast("int"), F.lit(3)) == 0
    m = metrics.ranking(_scores(s, d).withColumn("target", F.when(~unknown, F.col("target"))))
    return m.select("class", F.round("au_roc", 6).alias("au_roc"), F.round("avg_precision", 6).alias("avg_precision"), "support")


@query(
    f"with {_SCORES}, b as (select class, target, greatest(-1, least(49, floor(round((1 / (1 + exp(-score))) / (1.0 / 49), 9)))) b from scores), g as (select class, b, sum(target) p, sum(1 - target) n from b group by 1, 2),"
    " w as (select *, sum(p) over (partition by class order by b desc) cp from g) select class, case when sum(p) > 0 and sum(n) > 0 then round(sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)), 6) end au_roc_binned from w group by 1"
)
def auroc_50_thresholds(s, d):
    m = metrics.binned_auroc(_scores(s, d).withColumn("score", losses.sigmoid(F.col("score"))))
    return m.select("class", F.round("au_roc_binned", 6).alias("au_roc_binned"))


@query("with e as (select vec_id window_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), x as (select window_id, list_transform(v, lambda a: exp(a - list_max(v))) w, v from e) select window_id, round(1 / (1 + exp(-v[1])), 6) sigmoid0, round(w[1] / list_sum(w), 6) softmax0, round(ln((w[1] / list_sum(w)) / (1 - w[1] / list_sum(w))), 6) logit0 from x")
def activations(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = _windows(s, d).select("window_id", v.alias("v"))
    first = lambda c: F.round(F.element_at(c, 1), 6)
    return e.select("window_id", F.round(losses.sigmoid(F.col("v")[0]), 6).alias("sigmoid0"), first(losses.softmax(F.col("v"))).alias("softmax0"), first(losses.softmax_and_logit(F.col("v"))).alias("logit0"))


@query(f"with {_SCORES}, t as (select class, score x, case when window_id % 3 <> 0 then target end t from scores) select class, round(sum(case when t is null then 0.01 else 1.0 end * (greatest(x, 0.0) - x * coalesce(t, 0) + ln(1 + exp(-abs(x))))) / greatest(sum(case when t is null then 0.01 else 1.0 end), 1e-8), 6) loss from t group by 1")
def weak_negative_bce(s, d):
    t = _scores(s, d).withColumn("t", F.when(F.col("window_id") % 3 != 0, F.col("target")))
    return t.groupBy("class").agg(F.round(losses.weak_negative_bce("score", "t"), 6).alias("loss"))


@query("select i step, round(case when i < 50 then 0.001 * (i + 1) / 50 else 0.001 * (0.1 + 0.9 * (1 + cos(pi() * (i - 50) / 950)) / 2) end, 12) lr from range(0, 1000) t(i)")
def lr_schedule(s, d):
    table(s, d, "deployments")
    return s.range(1000).select(F.col("id").alias("step"), F.round(losses.learning_rate(F.col("id"), 0.001, 1000, 0.05, 0.1), 12).alias("lr"))


@query(f"with {_SCORES} select class, cast(least(30, greatest(1, floor((score + 3) / 0.2) + 1)) as bigint) bin, count(*) n from scores group by 1, 2")
def score_histogram(s, d):
    bin_ = F.least(F.greatest(F.floor((F.col("score") + 3) / F.lit(0.2)) + 1, F.lit(1)), F.lit(30)).cast("long")
    return _scores(s, d).groupBy("class", bin_.alias("bin")).agg(F.count("*").alias("n"))


# ---- store

_WIN = f"win as (select pred_id window_id, {sql_key('file')} file, round(start_time, 6) start_time, round(end_time, 6) end_time, deployment_id from localizer_preds)"


def _win(s, d):
    return table(s, d, "localizer_preds").select(F.col("pred_id").alias("window_id"), "file", "start_time", "end_time", "deployment_id")


@query(f"with {_WIN} select window_id, file, start_time, end_time from win")
def window_key_normalise(s, d):
    return store.normal_windows(_win(s, d)).select("window_id", "file", "start_time", "end_time")


@query(f"with {_WIN} select file, start_time, end_time, min(window_id) window_id from win group by 1, 2, 3")
def dedupe_windows(s, d):
    return store.first_windows(_win(s, d)).select("file", "start_time", "end_time", "window_id")


@query(f"with {_WIN}, {FILES}, {_grid_sql(3.0, 3.0, 'extend')} select c.* from clips c where not exists (select 1 from win w where w.file = c.file and w.start_time = c.start_time and w.end_time = c.end_time)")
def existing_windows_anti(s, d):
    return store.missing_windows(clips.clip_grid(files(s, d).select("file", "duration"), 3.0), _win(s, d))


@query(f"with {_WIN}, {FILES}, {_grid_sql(3.0, 3.0, 'extend')} select c.file, c.start_time, c.end_time, min(w.window_id) window_id from clips c left join win w on w.file = c.file and w.start_time = c.start_time and w.end_time = c.end_time group by 1, 2, 3")
def match_windows_first(s, d):
    return store.match_windows(clips.clip_grid(files(s, d).select("file", "duration"), 3.0), _win(s, d), first=True)


@query(f"with {_WIN}, {FILES} select w.window_id from win w join files f on w.file = f.file join deployments p on w.deployment_id = p.deployment_id where cast(f.recorded_at as date) between '2023-03-01' and '2024-06-30' and strftime(f.recorded_at, '%H:%M:%S') between '04:00:00' and '10:30:00' and p.project in ('cave_ridge', 'upland_song')")
def find_windows_filters(s, d):
    w = store.normal_windows(_win(s, d)).join(files(s, d).select("file", "recorded_at"), "file")
    w = w.join(if_small(table(s, d, "deployments").select("deployment_id", "project")), "deployment_id")
    return store.filter_windows(w, ("2023-03-01", "2024-06-30"), ("04:00:00", "10:30:00"), projects=["cave_ridge", "upland_song"]).select("window_id")


@query(f"select vec_id window_id, {_dot_sql(WEIGHTS['c3'])} score from embeddings order by score desc, window_id limit 25")
def similarity_top_k(s, d):
    return store.similarity_search(_windows(s, d), WEIGHTS["c3"], 25)


@query(f"select vec_id window_id, {_dot_sql(WEIGHTS['c1'])} score from embeddings order by abs(score - 0.5), window_id limit 10")
def similarity_target_score(s, d):
    return store.similarity_search(_windows(s, d), WEIGHTS["c1"], 10, target_score=0.5)


@query(f"with {_SCORES}, r as (select cast(substr(class, 2) as bigint) query_id, window_id, score, row_number() over (partition by class order by score desc, window_id) k from scores) select query_id, window_id, score, cast(k as integer) as \"rank\" from r where k <= 7")
def similarity_many_queries(s, d):
    return store.similarity_many(_windows(s, d), [(k, w) for k, w in enumerate(WEIGHTS.values())], 7)


@query(
    "with q as (select vec_id query_id, cast(embedding as double[]) e from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id window_id, round(list_dot_product(e, cast(embedding as double[])), 6) score from q, embeddings),"
    " r as (select *, row_number() over (partition by query_id order by score desc, window_id) k from s) select query_id, window_id, score, cast(k as integer) as \"rank\" from r where k <= 7"
)
def similarity_row_queries(s, d):
    w = _windows(s, d)
    return store.similarity_join(w, w.where("window_id % 100 = 0").select(F.col("window_id").alias("query_id"), F.col("embedding").alias("vector")), 7)


_SEL = "select class, window_id, score, cast(k as integer) as \"rank\" from r where k <= {}"


@query(f"with {_SCORES}, r as (select *, row_number() over (partition by class order by score desc, window_id) k from scores where score >= -0.5 and score <= 1.0) {_SEL.format(12)}")
def select_top_k(s, d):
    return store.select_windows(_scores(s, d), 12, min_score=-0.5, max_score=1.0).select("class", "window_id", "score", "rank")


@query(f"with {_SCORES}, r as (select *, row_number() over (partition by class order by md5(concat_ws('|', '11', class, cast(window_id as varchar)))) k from scores where score >= 0) {_SEL.format(5)}")
def select_random_k(s, d):
    return store.select_windows(_scores(s, d), 5, "random_k", min_score=0.0, seed=11).select("class", "window_id", "score", "rank")


@query(f"with {_SCORES} select class, window_id, score from scores where score >= 0.75")
def select_threshold(s, d):
    return store.select_windows(_scores(s, d), None, "all", min_score=0.75).select("class", "window_id", "score")


@query(f"with {_SCORES}, r as (select *, row_number() over (partition by class, label order by score desc, window_id) k from scores) select class, label, window_id, score, cast(k as integer) as \"rank\" from r where k <= 3")
def stratified_top_k(s, d):
    return store.select_windows(_scores(s, d), 3, strata=("label",)).select("class", "label", "window_id", "score", "rank")


@query(f"with {_SCORES}, b as (select * from (values (-1.0, 0.0), (0.0, 0.5), (0.25, 1.0)) t(low, high)) select class, cast(low as double) low, cast(high as double) high, count(*) filter (score >= low and score < high) n from scores, b group by 1, 2, 3")
def count_detections_bins(s, d):
    return store.count_in_bins(_scores(s, d), [(-1.0, 0.0), (0.0, 0.5), (0.25, 1.0)])


@query(
    f"with {_WIN}, a as (select file, start_time, end_time, min(window_id) window_id from win group by 1, 2, 3), b as (select {sql_key('file')} file, round(start_time, 6) start_time, round(end_time, 6) end_time, -min(det_id) - 1 window_id from loca_2021_detections group by 1, 2, 3)"
    " select file, start_time, end_time, coalesce(a.window_id, b.window_id) window_id from a full join b using (file, start_time, end_time)"
)
def dataset_merge_skip(s, d):
    old = store.first_windows(_win(s, d)).select("file", "start_time", "end_time", "window_id")
    det = table(s, d, "loca_2021_detections").select(F.col("det_id").alias("window_id"), "file", "start_time", "end_time")
    new = store.first_windows(det.withColumn("extra", F.lit(0))).select("file", "start_time", "end_time", (-F.col("window_id") - 1).alias("window_id"))
    return store.merge_labels(old, new, ["window_id"])


@query("select vec_id window_id, round(list_max(list_transform(embedding, lambda x: least(greatest(x, -0.2), 0.2))), 6) top, round(list_min(list_transform(embedding, lambda x: least(greatest(x, -0.2), 0.2))), 6) bottom from embeddings")
def embeddings_clamped(s, d):
    e = store.clip_values(F.transform("embedding", lambda x: x.cast("double")), 0.2)
    return _windows(s, d).select("window_id", F.round(F.array_max(e), 6).alias("top"), F.round(F.array_min(e), 6).alias("bottom"))


# ---- samples: the embeddings as 64 samples at 64 Hz

_X = "x as (select vec_id id, list_transform(embedding, lambda v: cast(v as double)) x from embeddings)"


def _samples(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_SUM = "round(list_sum({}), 6)"


def _sum(c):
    return F.round(signal.total(c), 6)


@query(f"with {_X} select id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) rms, round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) * sqrt(2)), 6) dbfs from x")
def samples_rms_dbfs(s, d):
    return _samples(s, d).select("id", F.round(signal.rms(F.col("x")), 6).alias("rms"), F.round(signal.dbfs(F.col("x")), 6).alias("dbfs"))


@query(f"with {_X} select id, 32 n, {_SUM.format('x[17:48]')} total from x")
def samples_trim(s, d):
    t = signal.trim(F.col("x"), 0.25, 0.75, 64)
    return _samples(s, d).select("id", F.size(t).alias("n"), _sum(t).alias("total"))


@query(f"with {_X}, g as (select id, list_transform(x, lambda v: least(greatest(v * pow(10, 14.0 / 20), -1.0), 1.0)) g from x) select id, {_SUM.format('g')} total, round(list_max(g), 6) top from g")
def samples_gain_clip(s, d):
    g = signal.apply_gain(F.col("x"), 14.0)
    return _samples(s, d).select("id", _sum(g).alias("total"), F.round(F.array_max(g), 6).alias("top"))


@query(f"with {_X}, g as (select id, list_transform(x, lambda v: v / greatest(list_max(x), -list_min(x)) * 0.5) g from x) select id, {_SUM.format('g')} total, round(greatest(list_max(g), -list_min(g)), 6) peak from g")
def samples_normalise(s, d):
    g = signal.normalize(F.col("x"), 0.5)
    return _samples(s, d).select("id", _sum(g).alias("total"), F.round(F.greatest(F.array_max(g), -F.array_min(g)), 6).alias("peak"))


@query(f"with {_X} select id, 101 padded, round(list_sum(x), 6) pad_total, 150 looped, round(2 * list_sum(x) + list_sum(x[1:22]), 6) loop_total from x")
def samples_pad_loop(s, d):
    p, q = signal.pad_to(F.col("x"), 101), signal.loop_to(F.col("x"), 150)
    return _samples(s, d).select("id", F.size(p).alias("padded"), _sum(p).alias("pad_total"), F.size(q).alias("looped"), _sum(q).alias("loop_total"))


@query(f"with {_X}, m as (select id, list_transform(list_zip(x, list_reverse(x)), lambda p: least(greatest(p[1] * pow(10, -3.0 / 20) + p[2] * pow(10, -3.0 / 20), -1.0), 1.0)) m from x) select id, {_SUM.format('m')} total, round(m[1], 6) first from m")
def samples_mix(s, d):
    m = signal.mix(F.col("x"), signal.change_speed(F.col("x"), -1.0))
    return _samples(s, d).select("id", _sum(m).alias("total"), F.round(F.element_at(m, 1), 6).alias("first"))


@query(f"with {_X}, p as (select id, i, x[i + 1] >= 0.05 up from x, range(0, 64) t(i)), g as (select id, i, i - row_number() over (partition by id order by i) isl from p where up) select id, min(i) \"start\", count(*) length from g group by id, isl")
def samples_events_runs(s, d):
    r = _samples(s, d).select("id", F.inline(signal.event_runs(F.col("x"), 0.05)))
    return r.select("id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))


def _dft_sql(k: int) -> str:
    part = lambda f: "list_dot_product(x, cast([" + ", ".join(repr(f(2 * math.pi * k * i / 64)) for i in range(64)) + "] as double[]))"
    scale = 1 / 64 if k == 0 else 2 / 64
    return f"round(sqrt(pow({part(math.cos)}, 2) + pow({part(math.sin)}, 2)) * {scale}, 6)"


@query(f"with {_X} select id, " + ", ".join(f"{_dft_sql(k)} b{k}" for k in range(6)) + " from x")
def samples_spectrum_dft(s, d):
    spec = dsp.per_array(dsp.spectrum)(F.col("x"))
    return _samples(s, d).select("id", spec.alias("f")).select("id", *[F.round(F.col("f")[k], 6).alias(f"b{k}") for k in range(6)])


@query(f"with {_X}, m as (select id, list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x))) m from x) select id, {_SUM.format('m')} total, round(m[1] * 255, 6) linear0 from m")
def min_max_linear_scale(s, d):
    m = signal.min_max_scale(F.col("x"))
    return _samples(s, d).select("id", _sum(m).alias("total"), F.round(signal.linear_scale(F.element_at(m, 1)), 6).alias("linear0"))


@query(f"with {_X} select id, len(list_filter(x, lambda v: v > 0.2)) clipped, round(10 * log10(greatest(x[1] * x[1], 1e-10)), 6) db0 from x")
def clipping_and_db(s, d):
    first = F.element_at("x", 1)
    return _samples(s, d).select("id", signal.clipped_count(F.col("x"), 0.2).cast("long").alias("clipped"), F.round(signal.to_db(first * first), 6).alias("db0"))


# ---- keys, geometry, events

@query("with p as (select distinct file, string_split(regexp_replace(trim(file, ' \t\r\n'), '/{2,}', '/', 'g'), '/') a from localizer_preds) select distinct array_to_string(a, '/') path, case when len(a) > 1 then a[-2] end parent, case when len(a) > 2 then a[-3] || '/' || a[-2] end two, string_split(a[-1], '_')[1] first_part from p")
def path_parts(s, d):
    p = table(s, d, "localizer_preds").select(clean_key("file").alias("path")).distinct()
    c = F.col("path")
    return p.select("path", parent_folder(c).alias("parent"), two_parents(c).alias("two"), filename_first_part(c).alias("first_part"))


_COORD = f"co as (select {sql_key('file')} file, (array_agg(x order by coord_id))[1] x, (array_agg(y order by coord_id))[1] y, (array_agg(case when not isnan(z) then z end order by coord_id))[1] z from loca_2021_aru_coords where not isnan(x) and not isnan(y) and x <> -9999 group by 1)"


def _coords(s, d):
    c = table(s, d, "loca_2021_aru_coords").select(clean_key("file").alias("file"), nan_to_null("x").alias("x"), nan_to_null("y").alias("y"), nan_to_null("z").alias("z"), "coord_id")
    return clips.first_per_file(c.where("x is not null and y is not null and x <> -9999"), "coord_id").drop("coord_id")


_D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + coalesce((a.z - b.z) * (a.z - b.z), 0))"


@query(f"with {_COORD} select a.file, b.file near, round({_D3}, 6) dist from co a join co b on a.file <> b.file and abs(a.x - b.x) <= 80 and abs(a.y - b.y) <= 80 where {_D3} <= 80")
def nearby_recorders(s, d):
    return localize.nearby_dict(_coords(s, d), 80.0).withColumn("dist", F.round("dist", 6))


@query(f"with {_COORD} select file, 'r' || cast(cast(floor(x / 500) as bigint) as varchar) || '_' || cast(cast(floor(y / 500) as bigint) as varchar) region_id from co where x - floor(x / 500) * 500 <= 400 and y - floor(y / 500) * 500 <= 400")
def region_containing(s, d):
    co = _coords(s, d)
    gx, gy = F.floor(F.col("x") / 500).cast("long"), F.floor(F.col("y") / 500).cast("long")
    name = F.concat(F.lit("r"), F.col("gx").cast("string"), F.lit("_"), F.col("gy").cast("string"))
    squares = co.select(gx.alias("gx"), gy.alias("gy")).distinct().select(name.alias("region_id"), (F.col("gx") * 500.0).alias("x0"), (F.col("gy") * 500.0).alias("y0"), (F.col("gx") * 500.0 + 400).alias("x1"), (F.col("gy") * 500.0 + 400).alias("y1"))
    return region_of(co, squares, "x", "y", 200.0).select("file", "region_id")


@query(f"with {_COORD} select distinct {sql_key('file')} file from loca_2021_detections where {sql_key('file')} is not null and {sql_key('file')} not in (select file from co)")
def missing_coordinates(s, d):
    det = table(s, d, "loca_2021_detections").select(clean_key("file").alias("file")).where("file is not null")
    return localize.missing_coordinates(det, _coords(s, d))


_EV = f"det as (select distinct 'zeep' as class, date_trunc('month', received_at) start_timestamp, {sql_key('file')} file from loca_2021_detections where zeep = 1 and {sql_key('file')} is not null)"


@query(f"with {_COORD}, {_EV}, m as (select p.class, p.start_timestamp, p.file, list(distinct q.file order by q.file) o from det p join co a on p.file = a.file join det q on q.class = p.class and q.start_timestamp = p.start_timestamp and q.file <> p.file join co b on b.file = q.file where {_D3} <= 80 group by 1, 2, 3) select class, start_timestamp, file, file || ',' || array_to_string(o, ',') receivers from m where len(o) >= 2")
def candidate_events(s, d):
    det = table(s, d, "loca_2021_detections").where("zeep = 1").select(F.lit("zeep").alias("class"), F.date_trunc("month", "received_at").alias("start_timestamp"), clean_key("file").alias("file")).where("file is not null")
    ev = localize.candidate_events(det, _coords(s, d), 80.0, 3)
    return ev.select("class", F.col("start_timestamp").cast("timestamp_ntz").alias("start_timestamp"), "file", F.array_join("receivers", ",").alias("receivers"))


_TD = """r as (select vec_id event_id, i rank, cast(embedding[2 * i + 1] as double) * 100 x, cast(embedding[2 * i + 2] as double) * 100 y, cast(embedding[60] as double) * 50 px, cast(embedding[61] as double) * 50 py, i * 0.01 tdoa from embeddings, range(0, 5) t(i)),
q as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) d from r), z as (select q.event_id, q.rank, ((q.d - f.d) / 343.0 - q.tdoa) * 343.0 residual from q join q f on q.event_id = f.event_id and f.rank = 0)"""


def _receivers(s, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("event_id"), e.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"))
    at = lambda i: F.element_at("e", i)
    return rows.select("event_id", "rank", (F.element_at("e", F.col("rank") * 2 + 1) * 100).alias("x"), (F.element_at("e", F.col("rank") * 2 + 2) * 100).alias("y"), (at(60) * 50).alias("px"), (at(61) * 50).alias("py"), (F.col("rank") * 0.01).alias("tdoa"))


@query(f"with {_TD} select event_id, rank, round(residual, 6) residual from z")
def tdoa_residuals(s, d):
    return localize.tdoa_residuals(_receivers(s, d)).select("event_id", F.col("rank").cast("long").alias("rank"), F.round("residual", 6).alias("residual"))


@query(f"with {_TD} select event_id, round(sqrt(avg(residual * residual)), 6) residual_rms from z group by 1")
def residual_rms(s, d):
    r = localize.residual_rms(localize.tdoa_residuals(_receivers(s, d)))
    return r.select("event_id", F.round("residual_rms", 6).alias("residual_rms"))


@query("select vec_id event_id, round(331.3 * sqrt(1 + cast(label as double) / 273.15), 6) speed, round(cast(embedding[1] as double) * cast(embedding[1] as double) + cast(embedding[2] as double) * cast(embedding[2] as double) - cast(embedding[3] as double) * cast(embedding[3] as double), 6) lorentz from embeddings")
def sound_speed_lorentz(s, d):
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(s, d, "embeddings").select(F.col("vec_id").alias("event_id"), F.round(localize.speed_of_sound(F.col("label").cast("double")), 6).alias("speed"), F.round(localize.lorentz(e), 6).alias("lorentz"))


@query(f"with {_WIN}, {FILES} select window_id, cast(epoch_us(recorded_at) + cast(round(start_time * 1000000) as bigint) as bigint) start_us from win join files using (file) where recorded_at is not null")
def window_start_timestamps(s, d):
    w = store.normal_windows(_win(s, d)).join(files(s, d).select("file", "recorded_at"), "file").where("recorded_at is not null")
    return w.select("window_id", F.unix_micros(localize.start_timestamp(F.col("recorded_at"), F.col("start_time"))).alias("start_us"))


@query("select gps_row_id, status = 'A' as has_fix, total_samples = 0 as first_row, last_rmc_gps_time is null as no_message, timer_count < 0 or timer_count > 999 as overflow from audiomoth_gps")
def gps_row_checks(s, d):
    g = table(s, d, "audiomoth_gps")
    t = F.col("timer_count")
    return g.select("gps_row_id", (F.col("status") == "A").alias("has_fix"), (F.col("total_samples") == 0).alias("first_row"), F.col("last_rmc_gps_time").isNull().alias("no_message"), ((t < 0) | (t > 999)).alias("overflow"))


# ---- kernels without SQL: checked against brute force and exact cases in the tests


@query()
def gcc_tdoa(s, d):
    def delay(x):
        return list(dsp.tdoa(x[8:56], x[4:52], 0.2, 64.0))

    return _samples(s, d).select("id", dsp.per_array(delay)(F.col("x")).alias("delay_and_peak"))


@query()
def pulse_score(s, d):
    return _samples(s, d).select("id", dsp.per_array(lambda x: dsp.pulse_score(abs(x), 64.0, (2.0, 12.0)), "double")(F.col("x")).alias("score"))


@query()
def bandpass_filter(s, d):
    return _samples(s, d).select("id", dsp.per_array(lambda x: dsp.zero_phase(x, dsp.Butterworth(5, 4.0, 20.0, 64.0)))(F.col("x")).alias("filtered"))


@query()
def localize_least_squares(s, d):
    rows = _receivers(s, d)
    true = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2) / 343.0
    by = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", true.alias("t")))).alias("r"))
    ev = by.select("event_id", F.col("r.x").alias("xs"), F.col("r.y").alias("ys"), F.transform("r.t", lambda t: t - F.col("r.t")[0]).alias("tdoas"))
    return localize.locate(ev)


@query()
def accel_sequences(s, d):
    def times(x):
        return [float(len(q)) for q in dsp.accel_sequences((abs(x) * 2).cumsum(), points=(3, 100), duration=(0.0, 15.0), dy=(-0.2, 0.2))]

    return _samples(s, d).select("id", dsp.per_array(times)(F.col("x")).alias("lengths"))

