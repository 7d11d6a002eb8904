from datetime import datetime, timezone

import pytest

from fieldchirp.operators.timestamps import Reader, recording_times, settle

Z = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000
T = Z(2023, 3, 1, 13, 28, 56)


@pytest.mark.parametrize(
    ("text", "zone", "month_first", "want"),
    [
        ("Wed, 01 Mar 2023 13:28:56 +0000", None, False, [T]),
        ("1 Mar 2023 13:28:56.250 UTC", None, False, [T + 250_000]),
        ("2023-03-01T08:28:56.000-0500", None, False, [T]),
        ("2023-03-01T08:28:56[America/New_York]", None, False, [T]),
        ("2023-03-01 08:28:56.000 EST", "America/New_York", False, [T]),
        ("2023-03-01 13:28:56.000UTC", None, False, [T]),
        ("2023-03-01 19:13:56.000 UTC+05:45", None, False, [T]),
        ("2023-03-01T13:28:56,000Z", None, False, [T]),
        ("2023-03-01T13:28:56.123456789Z", None, False, [T + 123_456]),
        ("20230301T132856.000Z", None, False, [T]),
        ("20230301_191356", "Asia/Kathmandu", False, [T]),
        ("03/01/2023 1:28:56.000 PM UTC", None, True, [T]),
        ("01/03/2023 13:28:56.000 UTC", None, False, [T]),
        ("2023/03/01 13:28:56", "UTC", False, [T]),
        ("1677677336", None, False, [T]),
        ("1677677336.5", None, False, [T + 500_000]),
        ("1677677336000", None, False, [T]),
        ("2023-11-05T01:30:00.000", "America/New_York", False, [Z(2023, 11, 5, 5, 30), Z(2023, 11, 5, 6, 30)]),
        ("2023-11-05 01:30:00 EST", "America/New_York", False, [Z(2023, 11, 5, 6, 30)]),
        ("2023-03-12T02:30:00", "America/New_York", False, []),
        ("0000-00-00T00:00:00.000", "UTC", False, []),
        ("2023-13-40T25:61:00.000", "UTC", False, []),
        ("31/31/2023 10:00:00 UTC", None, True, []),
        ("no fix", "UTC", False, []),
        ("", "UTC", False, []),
        ("2023-03-01 13:28:56", None, False, []),
        ("x" * 100_000, "UTC", False, []),
    ],
)
def test_reading(text, zone, month_first, want):
    assert Reader().read(text, zone, month_first) == want


def test_other_rows_settle_repeated_hours(spark):
    preds = [
        (1, " a.wav", 1, 0.0, "2023-11-05T01:10:00.000"), (2, "a.wav", 1, 3600.0, "2023-11-05 06:10:00.000+00:00"), (3, "a.wav", 1, 3660.0, "2023-11-05T01:11:00.000"),
        (4, "b.wav", 1, 0.0, "2023-11-05T01:10:00.000"), (5, "c.wav", 1, 0.0, None), (6, "c.wav", 9, 0.0, "2023-11-05T01:10:00.000"), (7, None, 1, None, "2023-12-01T00:00:00"),
    ]
    gps = [(1, "b.wav", 1, 0, "2023-11-05T01:10:00.100", "2023-11-05T06:10:00.000"), (2, "b.wav", 1, 1, "--", "2023-11-05T06:10:01Z")]
    p = spark.createDataFrame(preds, "pred_id long, file string, deployment_id int, start_time double, start_timestamp string")
    g = spark.createDataFrame(gps, "gps_row_id long, audio_file string, deployment_id int, pps_number int, audiomoth_time string, last_rmc_gps_time string")
    d = spark.createDataFrame([(1, "America/New_York", "local")], "deployment_id int, tz_name string, clock_setting string")
    got = {(r.field_name, r.row_id): (r.utc_us, r.resolved) for r in recording_times(p, g, d).collect()}
    first, second = Z(2023, 11, 5, 5, 10), Z(2023, 11, 5, 6, 10)
    assert got[("start_timestamp", 1)] == (first, True)
    assert got[("start_timestamp", 3)] == (second + 60_000_000, True)
    assert got[("start_timestamp", 4)] == (second, True)
    assert got[("audiomoth_time", 1)] == (second + 100_000, True)
    assert got[("last_rmc_gps_time", 2)] == (second + 1_000_000, True)
    assert got[("start_timestamp", 7)] == (Z(2023, 12, 1, 5), True)
    assert len(got) == 6
    assert recording_times(p.limit(0), g.limit(0), d).count() == 0


def test_undecided_is_marked(spark):
    row = [("x.wav", 0, "s", [Z(2023, 11, 5, 5), Z(2023, 11, 5, 6)])]
    f = spark.createDataFrame(row, "key string, idx_us long, source string, cands array<long>")
    none = spark.createDataFrame([], "key string, start_us long, n long")
    r = settle(f, none).first()
    assert not r.resolved and r.utc_us in row[0][3] and r.posterior < 0.95


def test_formats_are_learned_where_no_rule_is_given(spark):
    """Without deployment nothing says what comes first in slashed dates: a source's clear dates settle the others, or they stay open."""
    preds = [(i, f"a{i}.wav", 7, 0.0, f"{13 + i % 16}/03/2023 10:00:00 UTC") for i in range(40)] + [(50, "b.wav", 7, 0.0, "04/05/2023 10:00:00 UTC"), (51, "b2.wav", 7, 0.0, "06/06/2023 10:00:00 UTC")]
    preds += [(100 + i, f"m{i}.wav", 8, 0.0, f"03/{13 + i % 16}/2023 10:00:00 AM UTC") for i in range(40)] + [(80, "n.wav", 8, 0.0, "04/05/2023 10:00:00 AM UTC")]
    preds += [(90, "o.wav", 9, 0.0, "04/05/2023 10:00:00 UTC"), (91, "q.wav", 10, 0.0, "04/05/2023 10:00:00 UTC"), (92, "q.wav", 10, 60.0, "2023-04-05 10:01:00 UTC")]
    p = spark.createDataFrame(preds, "pred_id long, file string, deployment_id int, start_time double, start_timestamp string")
    g = spark.createDataFrame([], "gps_row_id long, audio_file string, deployment_id int, pps_number int, audiomoth_time string, last_rmc_gps_time string")
    d = spark.createDataFrame([], "deployment_id int, tz_name string, clock_setting string")
    got = {r.row_id: r for r in recording_times(p, g, d).collect()}
    assert got[50].utc_us == Z(2023, 5, 4, 10) and got[50].resolved  # day first, as the source writes
    assert got[51].utc_us == Z(2023, 6, 6, 10) and got[51].resolved
    assert got[80].utc_us == Z(2023, 4, 5, 10) and got[80].resolved  # month first
    assert not got[90].resolved and got[90].utc_us in (Z(2023, 4, 5, 10), Z(2023, 5, 4, 10))
    assert got[91].utc_us == Z(2023, 4, 5, 10) and got[91].resolved  # the recording's other value decides
    assert len(got) == len(preds)
