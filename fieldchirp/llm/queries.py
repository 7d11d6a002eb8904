"""Queries of the problems of training data (1, 6, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldchirp.llm.garbled import garbled_texts
from fieldchirp.llm.leak import leaked_passages
from fieldchirp.llm.mix import mix_sources
from fieldchirp.llm.splits import same_recording_pairs, split_rows
from fieldchirp.llm.topn import best_windows
from fieldchirp.plans.tables import sql_key, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return best_windows(table(spark, d, "localizer_preds"), 5).select("pred_id", "top_rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return same_recording_pairs(table(spark, d, "loca_2021_detections")).select("file_a", "file_b")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(table(spark, d, "loca_2021_detections"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark_items")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p6_found, p6_splits, p8_found, p9_mix, p9_report, p10_found, p10_restored)}

ORACLES = {
    "p1_found": f"""
with w as (select {sql_key("file")} f, start_time, min(pred_id) pred_id from localizer_preds where file is not null group by 1, 2),
s as (select w.f, w.start_time, w.pred_id, p.test_species v from w join localizer_preds p using (pred_id) where not isnan(p.test_species)),
r as (select pred_id, row_number() over (partition by f order by v desc, start_time, pred_id) k from s)
select pred_id, cast(k as integer) top_rank from r where k <= 5""",
    "p6_found": f"""
with s as (select distinct {sql_key("file")} f, cast(round(start_time * 10000) as bigint) t from loca_2021_detections where not isnan(start_time)),
m as (select f, t, count(*) over (partition by f) n from s where f is not null),
p as (select a.f fa, b.f fb, a.n n, a.t t, b.t - a.t d, (b.t - a.t) // 200 c from m a join m b on a.n >= 11 and (a.n < b.n or (a.n = b.n and a.f < b.f))),
k as (select fa, fb, c, n, count(distinct t) k from p group by all),
q as (select x.fa, x.fb, x.c from k x left join k y on x.fa = y.fa and x.fb = y.fb and y.c = x.c + 1 where x.k + coalesce(y.k, 0) >= ceil(0.7 * x.n - 1e-9)),
r as (select x.fa, x.fb from p x join q using (fa, fb, c) join p y on x.fa = y.fa and x.fb = y.fb and y.d between x.d and x.d + 200 group by x.fa, x.fb, x.d, x.n having count(distinct y.t) >= ceil(0.7 * x.n - 1e-9))
select distinct least(fa, fb) file_a, greatest(fa, fb) file_b from r""",
    "p8_found": """
with w as (select 'd' t, doc_id id, regexp_extract_all(lower(strip_accents(lower(text))), '[\\p{L}\\p{N}]+') w from documents
  union all select 'i', item_id, regexp_extract_all(lower(strip_accents(lower(text))), '[\\p{L}\\p{N}]+') from benchmark_items),
g as (select t, id, array_to_string(w[i : i + 11], ' ') win from w, lateral unnest(range(1, greatest(len(w) - 10, 1))) u(i) where len(w) >= 12)
select distinct d.id doc_id, i.id item_id from g d join g i on d.win = i.win and d.t = 'd' and i.t = 'i'""",
}
