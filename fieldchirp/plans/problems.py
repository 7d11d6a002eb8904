"""Queries of the general data problems (2, 3, 4, 5, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldchirp.operators.intervals import annotation_spans
from fieldchirp.operators.nearby import nearby_files
from fieldchirp.operators.orphans import find_orphans, snapshot_counts
from fieldchirp.operators.spikes import implausible_readings
from fieldchirp.operators.timestamps import recording_times
from fieldchirp.plans.tables import sql_key, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "audiomoth_gps")).select("gps_row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = [table(spark, d, n) for n in ("localizer_preds", "audiomoth_gps", "deployments", "recordings")]
    return recording_times(*t).select("src_table", "field_name", "row_id", "utc_us")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearby_files(table(spark, d, "loca_2021_aru_coords"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    det, coords, rec = (table(spark, d, n) for n in ("loca_2021_detections", "loca_2021_aru_coords", "recordings"))
    return find_orphans(
        [
            ("loca_2021_detections", det, "det_id", "file", "received_at", coords, "coord_id", "file", "received_at", "removed_at"),
            ("loca_2021_aru_coords", coords, "coord_id", "file", "received_at", rec, "recording_id", "filename", "received_at", "removed_at"),
        ],
        batches=2,
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("src").alias("src_table"), F.col("ref_id").alias("row_id"), "orphan_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_counts(_orphans(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return annotation_spans(table(spark, d, "boxed_annotations"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p5_report, p7_found)}


def _orphan_sql(src: str, row_id: str, parent: str, parent_key: str) -> str:
    return f"""
select '{src}' src_table, c.row_id, min(c.t0) t0,
  case when count(p.k) = 0 then 'missing' when count(*) filter (p.received_at <= c.t0) = 0 then 'late' else 'deleted' end orphan_kind
from (select {row_id} row_id, received_at t0, {sql_key("file")} k from {src}) c
left join (select {sql_key(parent_key)} k, received_at, removed_at from {parent}) p on c.k = p.k
where c.k is not null group by c.row_id
having not coalesce(bool_or(p.received_at <= c.t0 and (p.removed_at is null or p.removed_at > c.t0)), false)"""


_ORPHANS = _orphan_sql("loca_2021_detections", "det_id", "loca_2021_aru_coords", "file") + " union all " + _orphan_sql("loca_2021_aru_coords", "coord_id", "recordings", "filename")

ORACLES = {
    "p4_found": f"""
with p as (select distinct {sql_key("file")} k, x, y, case when not isnan(z) then z end z from loca_2021_aru_coords
  where file is not null and not isnan(x) and not isnan(y) and x <> -9999 and y <> -9999)
select distinct a.k file_a, b.k file_b from p a join p b
on a.k < b.k and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + coalesce((a.z - b.z) * (a.z - b.z), 0) <= 900""",
    "p5_found": f"select src_table, row_id, orphan_kind from ({_ORPHANS})",
    "p5_report": f"select src_table, strftime(t0, '%Y-%m') as month, orphan_kind, count(*) n_orphans from ({_ORPHANS}) group by 1, 2, 3",
    "p7_found": f"""
with v as (select {sql_key("audio_file")} audio_file, cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e
  from (select * from boxed_annotations where not isnan(start_time) and not isnan(end_time))),
p as (select *, max(e) over (partition by audio_file order by s, e rows between unbounded preceding and 1 preceding) before
  from v where e > s and audio_file is not null),
i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by audio_file order by s, e rows unbounded preceding) isl from p),
q as (select audio_file, isl, min(s) f, max(e) t from i group by 1, 2)
select audio_file, 'period' span_kind, f from_ms, t to_ms from q
union all select * from (select audio_file, 'gap', t, lead(f) over (partition by audio_file order by f) n from q) where n is not null""",
}
