"""Problem 3: mixed timestamp formats and time zones, made one UTC instant.

A text is read under every interpretation it allows.  Most allow one.  Where
a wall clock ran twice through an hour, a zone abbreviation stands for several
zones, or nothing says whether day or month comes first, the candidates go
into a mixture: the values of one recording share an unknown start, a source
has its habits of format; expectation-maximisation over both chooses, and
what stays undecided is marked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.functions.keys import clean_key
from fieldchirp.operators.small import if_small
from fieldchirp.scratch import materialize

# Offsets from UTC, in minutes, of zone abbreviations (the zone of the deployment decides first).
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "UT": [0], "WET": [0], "WEST": [60], "BST": [60, 360], "IST": [330, 60, 120], "CET": [60], "CEST": [120],
    "MEZ": [60], "MESZ": [120], "EET": [120], "EEST": [180], "MSK": [180], "SAST": [120], "EAT": [180], "CAT": [120], "WAT": [60], "NPT": [345],
    "EST": [-300], "EDT": [-240], "CST": [-360, 480], "CDT": [-300], "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420], "AST": [-240, 180],
    "ADT": [-180], "NST": [-210], "NDT": [-150], "AKST": [-540], "AKDT": [-480], "HST": [-600], "COT": [-300], "BRT": [-180], "ART": [-180], "CLT": [-240],
    "JST": [540], "KST": [540], "SGT": [480], "HKT": [480], "AWST": [480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
}
# Month names.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?"
_ZONE = r"\s*(?:(Z|z)|(?:UTC|GMT)?\s*([+-]\d{2}:?\d{2})|([A-Za-z]{2,5})|\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_ISO = re.compile(rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME}{_ZONE}")
_YSLASH = re.compile(rf"(\d{{4}})/(\d{{2}})/(\d{{2}})[T ]{_TIME}{_ZONE}")
_SLASH = re.compile(rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[T ]{_TIME}\s*([AaPp][Mm])?{_ZONE}")
_COMPACT = re.compile(rf"(\d{{4}})(\d{{2}})(\d{{2}})[T_](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}")
_NAMED = re.compile(rf"(?:[A-Za-z]{{3}},\s*)?(\d{{1,2}}) ([A-Za-z]{{3}})[a-z]* (\d{{4}}) {_TIME}{_ZONE}")
_EPOCH = re.compile(r"(\d{9,10})(?:\.(\d{1,9}))?|(\d{12,13})|(\d{15,16})|(\d{18,19})")
_US = 1_000_000
_EPOCH_DAY = date(1970, 1, 1).toordinal()


class Reader:
    """Reads texts; keeps what it learned of zones, so that most values cost a look-up."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, ...]] = {}

    def offsets(self, zone: str, wall: int) -> tuple[int, ...]:
        """Offsets (seconds) that hold at a wall time (seconds); none in a gap, two where the hour is repeated."""
        key = (zone, wall // 900)
        if key not in self.known:
            out: tuple[int, ...] = ()
            try:
                tz = ZoneInfo(zone)
                naive = datetime(1970, 1, 1) + timedelta(seconds=key[1] * 900)
                for fold in (0, 1):
                    off = naive.replace(tzinfo=tz, fold=fold).utcoffset()
                    back = (naive - off).replace(tzinfo=timezone.utc).astimezone(tz).replace(tzinfo=None)
                    if back == naive and int(off.total_seconds()) not in out:
                        out += (int(off.total_seconds()),)
            except (KeyError, ValueError, OverflowError, OSError):
                out = ()
            self.known[key] = out
        return self.known[key]

    def abbreviation(self, name: str, zone: str | None, wall: int) -> tuple[int, ...]:
        key = (name, zone, wall // 900)
        if key not in self.known:
            out = ()
            for off in self.offsets(zone, wall) if zone else ():
                local = datetime.fromtimestamp(wall - off, ZoneInfo(zone))
                if local.tzname() == name:
                    out += (off,)
            if not out and zone and name in ABBREVIATIONS:
                # The zone's own use of the name at another time of the year is as good.
                year = datetime(1970, 1, 1) + timedelta(seconds=wall)
                for month in (1, 7):
                    local = datetime(year.year, month, 1, tzinfo=ZoneInfo(zone))
                    if local.tzname() == name:
                        out += (int(local.utcoffset().total_seconds()),)
            self.known[key] = out or tuple(60 * m for m in ABBREVIATIONS.get(name, ()))
        return self.known[key]

    def read(self, text: str, zone: str | None, month_first: bool | None) -> list[int]:
        """UTC microseconds of every instant that the text can denote.

        ``zone`` holds for texts without zone (and decides between meanings of
        an abbreviation); None leaves them without instant.  ``month_first``
        None means that slashed dates may be either.
        """
        return [u for u, _ in self.readings(text, zone, month_first)]

    def readings(self, text: str, zone: str | None, month_first: bool | None) -> list[tuple[int, str]]:
        """The instants, each with the reading that gives it: which of several offsets, after ``d`` or ``m`` where the order of the date was open."""
        if month_first is not None or not _SLASH.fullmatch(text.strip()):
            return [(u, str(i)) for i, u in enumerate(self._instants(text, zone, bool(month_first)))]
        found = [(u, f"{o}{i}") for o in "dm" for i, u in enumerate(self._instants(text, zone, o == "m"))]
        same = len({u for u, _ in found}) == 1  # the same day either way
        return [(found[0][0], "0")] if same and len(found) > 1 else found

    def _instants(self, text: str, zone: str | None, month_first: bool) -> list[int]:
        text = text.strip()
        half = None
        if m := _ISO.fullmatch(text) or _YSLASH.fullmatch(text) or _COMPACT.fullmatch(text):
            y, mo, d, h, mi, s, frac, *z = m.groups()
        elif m := _SLASH.fullmatch(text):
            a, b, y, h, mi, s, frac, half, *z = m.groups()
            mo, d = (a, b) if month_first else (b, a)
        elif m := _NAMED.fullmatch(text):
            d, name, y, h, mi, s, frac, *z = m.groups()
            mo = MONTHS.get(name.lower(), 0)
        elif m := _EPOCH.fullmatch(text):
            sec, frac, ms, us, ns = m.groups()
            if sec:
                return [int(sec) * _US + int((frac or "0").ljust(6, "0")[:6])]
            return [int(ms) * 1000 if ms else int(us) if us else int(ns) // 1000]
        else:
            return []
        h, mi, s = int(h), int(mi), int(s)
        if half:
            if not 1 <= h <= 12:
                return []
            h = h % 12 + (12 if half.lower() == "pm" else 0)
        if h > 23 or mi > 59 or s > 59:
            return []
        try:
            wall = (date(int(y), int(mo), int(d)).toordinal() - _EPOCH_DAY) * 86400 + h * 3600 + mi * 60 + s
        except ValueError:
            return []
        zulu, off, abbr, region = z
        if zulu:
            offs: tuple[int, ...] = (0,)
        elif off:
            n = int(off[1:3]) * 60 + int(off[-2:])
            offs = (60 * (n if off[0] == "+" else -n),)
        elif region:
            offs = self.offsets(region, wall)
        elif abbr:
            offs = self.abbreviation(abbr.upper(), zone, wall)
        else:
            offs = self.offsets(zone, wall) if zone else ()
        micros = int((frac or "0").ljust(6, "0")[:6])
        return [(wall - o) * _US + micros for o in offs]


def read_column(rows: DataFrame, keep: str) -> DataFrame:
    """Add ``cands`` (array of (utc microseconds, reading)) to rows with text, zone, month_first (null where unknown).

    ``keep`` is the DDL of the columns kept.  Runs on whatever rows it gets;
    filter out texts already standard before.
    """
    names = [c.strip().split()[0] for c in keep.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for b in batches:
            out = b[names].copy()
            first = [None if f is None or f != f else bool(f) for f in b["month_first"]]
            out["cands"] = [[{"utc": u, "reading": r} for u, r in reader.readings(t, z, f)] for t, z, f in zip(b["text"], b["zone"].where(b["zone"].notna(), None), first, strict=True)]
            yield out

    return rows.mapInPandas(run, f"{keep}, cands array<struct<utc:bigint,reading:string>>")


def settle(
    found: DataFrame, anchors: DataFrame, recording: str = "key", place: str = "idx_us", source: str = "source", spread_s: float = 30.0, rounds: int = 8, decide: float = 0.95,
    habits: DataFrame | None = None, still: float = 1e-3,
) -> DataFrame:
    """Choose among candidates by expectation-maximisation.

    ``found``: rows with ``cands`` (instants, or instants with their reading),
    the recording, the value's offset from the recording's start (``place``,
    microseconds) and its ``source`` (whose habits of reading are learned).
    ``anchors``: (recording, start_us, n), starts that unambiguous values give.
    ``habits``: (source, reading, n), how often unambiguous values of a source
    were read so.

    E: a candidate is as likely as its start lies near the recording's
    (normal, ``spread_s``), times the source's habit.  M: the recording's
    start and the habits are re-estimated from the weighted candidates; both
    are tables, joined by key.  Rounds end when no habit moves by more than
    ``still``.  Returns (all columns of found, utc_us, posterior, resolved);
    rows that stay below ``decide`` keep their likeliest candidate with
    resolved false.
    """
    if found.schema["cands"].dataType.elementType.typeName() == "long":
        found = found.withColumn("cands", F.transform("cands", lambda c, i: F.struct(c.alias("utc"), i.cast("string").alias("reading"))))
    f = found.withColumns({"__row": F.monotonically_increasing_id(), "__s": F.coalesce(F.col(source).cast("string"), F.lit(""))})
    cand = f.select("*", F.posexplode("cands").alias("__i", "__p")).withColumns({"__c": F.col("__p.utc"), "__r": F.col("__p.reading")}).drop("__p")
    a = anchors.select(F.col(recording).alias(recording), F.col("start_us").alias("__a"), F.col("n").alias("__n"))
    base = materialize(cand.withColumn("__start", F.col("__c") - F.col(place)).join(a, recording, "left"), "anchored")
    spark = found.sparkSession
    learned = habits.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__s"), F.col("reading").alias("__r"), F.col("n").cast("double").alias("__h")) if habits is not None else spark.createDataFrame([], "__s string, __r string, __h double")
    learned = materialize(learned.groupBy("__s", "__r").agg(F.sum("__h").alias("__h")), "habits")
    sd = F.lit(spread_s * 1e6)
    now, seen = base.withColumn("__m", F.col("__a")), learned
    for r in range(rounds):
        z = (F.col("__start") - F.coalesce("__m", F.col("__start"))) / sd
        fit = F.exp(F.greatest(-0.5 * z * z, F.lit(-600.0))) + F.lit(1e-12)
        likely = now.join(seen, ["__s", "__r"], "left").withColumn("__l", fit * (F.coalesce("__h", F.lit(0.0)) + 1.0))
        total = likely.groupBy("__row").agg(F.sum("__l").alias("__t"))
        weighted = materialize(likely.join(total, "__row").withColumn("__w", F.col("__l") / F.col("__t")).drop("__m", "__l", "__t", "__h"), "em")
        if r + 1 == rounds:
            break
        counted = weighted.groupBy("__s", "__r").agg(F.sum("__w").alias("__h")).unionByName(learned).groupBy("__s", "__r").agg(F.sum("__h").alias("__h"))
        counted = materialize(counted, "habits")
        moved = counted.join(seen.withColumnRenamed("__h", "__b"), ["__s", "__r"], "left").agg(F.max(F.abs(F.col("__h") - F.coalesce("__b", F.lit(0.0))) / (F.col("__h") + 1.0))).first()[0]
        if r and (moved or 0.0) <= still:
            break
        seen = counted
        # a recording without anchor gathers round the weighted mean of its own candidates
        own = weighted.groupBy(recording).agg((F.sum(F.col("__w") * F.col("__start")) / F.sum("__w")).alias("__own"), F.sum("__w").alias("__k"))
        mean = F.when(F.col("__a").isNull(), F.col("__own")).otherwise((F.col("__a") * F.col("__n") + F.col("__own") * F.col("__k")) / (F.col("__n") + F.col("__k")))
        now = base.join(own, recording, "left").withColumn("__m", mean).drop("__own", "__k")
    best = weighted.groupBy("__row").agg(F.max_by(F.struct(*found.columns, F.col("__c").alias("utc_us"), F.col("__w").alias("posterior")), F.struct(F.col("__w"), -F.col("__i"))).alias("b"))
    return best.select("b.*").withColumn("resolved", F.col("posterior") >= decide)


STANDARD_T = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$"
STANDARD_UTC = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\+00:00$"
_KEPT = "src_table string, field_name string, row_id bigint, key string, idx_us bigint, source string"


def _field(df: DataFrame, table: str, field: str, row_id: str, key: Column, place: Column, zone: Column, standard: Column) -> DataFrame:
    text = F.col(field)
    return df.select(
        F.lit(table).alias("src_table"), F.lit(field).alias("field_name"), F.col(row_id).cast("long").alias("row_id"), key.alias("key"), F.round(place * 1e6).cast("long").alias("idx_us"),
        F.concat_ws("/", F.lit(field), F.col("deployment_id").cast("string")).alias("source"), text.alias("text"), zone.alias("zone"), F.col("__tz").startswith("America").alias("month_first"), standard.alias("standard"),
    ).where(text.isNotNull())


def recording_times(preds: DataFrame, gps: DataFrame, deployments: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Every non-standard value of start_timestamp, audiomoth_time and last_rmc_gps_time as one instant.

    Columns: src_table, field_name, row_id, key, utc_us, posterior, resolved.
    Texts that denote no instant (placeholders, impossible dates, wall times
    that a clock change skipped) give no row.  A row whose deployment isn't
    known has no zone: texts that need one denote no instant, and what comes
    first in slashed dates is learned from the source.  Null texts and empty
    tables give nothing.
    """
    dep = if_small(deployments.select(F.col("deployment_id").alias("__d"), F.col("tz_name").alias("__tz"), F.col("clock_setting").alias("__clock")))
    p = preds.select("pred_id", "file", "deployment_id", "start_time", "start_timestamp").join(dep, F.col("deployment_id") == F.col("__d"), "left")
    g = gps.select("gps_row_id", "audio_file", "deployment_id", "pps_number", "audiomoth_time", "last_rmc_gps_time").join(dep, F.col("deployment_id") == F.col("__d"), "left")
    zone = F.when(F.col("__clock") == "local", F.col("__tz")).when(F.col("__clock") == "utc", "UTC")
    pps = F.col("pps_number").cast("double")
    start = F.when(~F.isnan("start_time"), F.col("start_time"))
    fields = [
        _field(p, "localizer_preds", "start_timestamp", "pred_id", clean_key("file"), start, zone, F.col("start_timestamp").rlike(STANDARD_UTC)),
        _field(g, "audiomoth_gps", "audiomoth_time", "gps_row_id", clean_key("audio_file"), pps, zone, (F.col("__clock") == "utc") & F.col("audiomoth_time").rlike(STANDARD_T)),
        _field(g, "audiomoth_gps", "last_rmc_gps_time", "gps_row_id", clean_key("audio_file"), pps, F.lit("UTC"), F.col("last_rmc_gps_time").rlike(STANDARD_T)),
    ]
    values = fields[0].unionByName(fields[1]).unionByName(fields[2])
    standard = F.coalesce(F.col("standard"), F.lit(False))
    found = materialize(read_column(values.where(~standard), _KEPT).where(F.size("cands") > 0), "instants")
    sure = found.where(F.size("cands") == 1).select("src_table", "field_name", "row_id", "key", F.col("cands")[0]["utc"].alias("utc_us"), F.lit(1.0).alias("posterior"), F.lit(True).alias("resolved"))
    doubt = found.where(F.size("cands") > 1)
    if doubt.isEmpty():
        return sure
    # Anchors: what the other values of those recordings, standard ones too, say of the start.
    keys = if_small(materialize(doubt.select("key").where("key is not null").distinct(), "doubted"))
    clean = F.when(F.col("text").endswith("+00:00"), F.col("text")).otherwise(F.concat("text", F.lit("+00:00")))
    usual = values.where(standard).join(keys, "key", "left_semi").select("key", (F.unix_micros(F.try_to_timestamp(clean)) - F.col("idx_us")).alias("start_us"))
    parsed = found.where(F.size("cands") == 1).join(keys, "key", "left_semi").select("key", (F.col("cands")[0]["utc"] - F.col("idx_us")).alias("start_us"))
    anchors = usual.unionByName(parsed).where("start_us is not null").groupBy("key").agg(F.percentile_approx("start_us", 0.5).alias("start_us"), F.count("*").alias("n"))
    if recordings is not None:
        rec = recordings.select(clean_key("filename").alias("key"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("r")).where("r is not null").join(keys, "key", "left_semi").groupBy("key").agg(F.min("r").alias("r"))
        anchors = anchors.join(rec, "key", "full").select("key", F.coalesce("start_us", "r").alias("start_us"), F.coalesce("n", F.lit(1)).alias("n"))
    reading = F.col("cands")[0]["reading"]
    habits = found.where((F.size("cands") == 1) & reading.rlike("^[dm]")).groupBy("source", reading.alias("reading")).agg(F.count("*").alias("n"))
    settled = settle(doubt.withColumn("idx_us", F.coalesce("idx_us", F.lit(0))), anchors, habits=habits)
    return sure.unionByName(settled.select(*sure.columns))
