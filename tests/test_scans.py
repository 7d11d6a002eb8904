"""Ordered scans, intervals and orphans against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldchirp.operators.intervals import annotation_spans, merge_intervals
from fieldchirp.operators.orphans import OrphanState, find_orphans, open_orphans, orphans_on_arrival, parent_rows, process_batch, reference_events, snapshot_counts
from fieldchirp.operators.rangescan import running

T0 = datetime(2024, 1, 1)


def test_running_sums_do_not_depend_on_partitions(spark):
    random.seed(1)
    rows = [(random.choice(["hot", "hot", "hot", "b", None]), random.randrange(50), i, random.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o int, id long, v long")
    want, sums = {}, {}
    for g, o, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        sums[g] = sums.get(g, 0) + v
        want[i] = (sums[g], sums[g] - v)
    for n in (1, 7):
        got = running(df, ["g"], ["o", "id"], {"s": "v"}, partitions=n)
        assert {r.id: r.s for r in got.collect()} == {i: w[0] for i, w in want.items()}
    before = running(df, ["g"], ["o", "id"], {"s": "v"}, before=True, partitions=5)
    assert {r.id: r.s for r in before.collect()} == {i: w[1] for i, w in want.items()}
    whole = running(df, [], ["id"], {"s": "v"}, partitions=5).agg(F.max("s")).first()[0]
    assert whole == sum(r[3] for r in rows)
    assert running(df.limit(0), ["g"], ["o"], {"s": "v"}).count() == 0


def _islands(rows):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        cur = None
        for _, a, b in sorted(r for r in rows if r[0] == e and r[1] is not None and r[2] is not None and r[2] > r[1]):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out += [(e, "period", *cur), (e, "gap", cur[1], a)]
                cur = [a, b]
        if cur:
            out.append((e, "period", *cur))
    return sorted(out)


def test_intervals_match_brute_force_on_any_partitioning(spark):
    random.seed(2)
    rows = [("hot", a, a + random.randrange(-2, 30)) for a in (random.randrange(3000) for _ in range(400))]
    rows += [("long", 0, 100000), ("long", 5, 6), ("long", 100000, 100001), ("long", 100003, 100004), (None, 1, 2), ("x", None, 3), ("x", 4, None), ("y", 5, 5)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "entity string, s long, e long").withColumn("from_ms", F.lit("clash"))
    for n in (1, 3, 11):
        got = sorted(tuple(r) for r in merge_intervals(df, "entity", "s", "e", n).collect())
        assert got == _islands(rows)
    assert merge_intervals(df.limit(0), "entity", "s", "e").count() == 0


def test_annotation_spans_round_and_skip(spark):
    rows = [(" a//b.wav", 0.0004, 1.0), ("a/b.wav", 1.0001, 2.0), ("a/b.wav", 2.5, 2.5), ("a/b.wav", float("nan"), 9.0), ("a/b.wav", 3.0, None), (None, 0.0, 1.0)]
    got = annotation_spans(spark.createDataFrame(rows, "audio_file string, start_time double, end_time double")).collect()
    assert [tuple(r) for r in got] == [("a/b.wav", "period", 0, 2000)]


def _case(spark):
    random.seed(3)
    at = lambda h: T0 + timedelta(hours=h)
    refs = [(i, random.choice(["hot", "hot", "k1", "k2", "none", None]), at(random.randrange(100))) for i in range(150)]
    parents = []
    for k in ("hot", "hot", "k1", "k2", "k2", "k3"):
        a = random.randrange(90)
        parents.append((k, at(a), random.choice([None, at(a + random.randrange(-3, 30))])))
    return refs, parents, spark.createDataFrame(refs, "id long, f string, at timestamp"), spark.createDataFrame(parents, "f string, at timestamp, gone timestamp")


def _kinds(refs, parents):
    out = {}
    for i, k, t in refs:
        if k is None:
            continue
        mine = [p for p in parents if p[0] == k]
        if any(p[1] <= t and (p[2] is None or p[2] > t) for p in mine):
            continue
        out[i] = "missing" if not mine else "late" if all(p[1] > t for p in mine) else "deleted"
    return out


def test_orphans_match_brute_force(spark):
    refs, parents, r, p = _case(spark)
    p = p.withColumn("pid", F.monotonically_increasing_id())
    for n in (1, 3):
        got = find_orphans([("t", r, "id", "f", "at", p, "pid", "f", "at", "gone")], partitions=5, batches=n)
        assert {x.ref_id: x.orphan_kind for x in got.collect()} == _kinds(refs, parents)
    assert sum(x.n_orphans for x in snapshot_counts(got).collect()) == len(_kinds(refs, parents))
    none = find_orphans([("t", r, "id", "f", "at", p.limit(0), "pid", "f", "at", "gone")])
    assert {x.orphan_kind for x in none.collect()} == {"missing"}
    assert find_orphans([("t", r.limit(0), "id", "f", "at", p, "pid", "f", "at", "gone")]).count() == 0


def _open_now(refs, parents):
    alive = {k for k, _, gone in parents if gone is None}
    return {i for i, k, _ in refs if k is not None and k not in alive}


def test_orphan_state_in_any_cut_and_order(spark):
    refs, parents, _, _ = _case(spark)
    late = lambda h: T0 + timedelta(hours=h)
    parents = [(i, *p) for i, p in enumerate([*parents, ("hot", late(30), None), ("k4", late(3), late(20)), ("k1", late(1), late(2))])]
    parents = [(i, k, a, late(99) if k == "hot" else g) for i, k, a, g in parents]
    refs += [(900, "k4", late(5)), (901, "k4", late(50))]
    rows = [("r", x) for x in refs] + [("p", (i, k, a, None)) for i, k, a, g in parents] + [("p", x) for x in parents if x[3] is not None]
    rng = random.Random(4)
    order = sorted(rows[: len(refs) + len(parents)], key=lambda _: rng.random()) + rows[len(refs) + len(parents) :]  # removals last
    state, told_r, told_p = OrphanState(), [], {}
    for lo, hi in ((0, 60), (60, 61), (61, len(refs) + len(parents)), (len(refs) + len(parents), len(order))):
        batch = order[lo:hi]
        r, p = [x for kind, x in batch if kind == "r"], [x for kind, x in batch if kind == "p"]
        rd = reference_events(spark.createDataFrame(r, "id long, f string, at timestamp"), "t", "id", "f", "at") if r else None
        pd = parent_rows(spark.createDataFrame(p, "pid long, f string, at timestamp, gone timestamp"), "t", "pid", "f", "at", "gone") if p else None
        before = {x.ref_id for x in open_orphans(spark, state).collect()} if told_r else set()
        changes, state = process_batch(state, rd, pd, partitions=3)
        told_r += r
        told_p |= {x[0]: x[1:] for x in p}
        known = list(told_p.values())
        assert {x.ref_id: x.orphan_kind for x in orphans_on_arrival(spark, state).collect()} == _kinds(told_r, known)
        after = {x.ref_id for x in open_orphans(spark, state).collect()}
        assert after == _open_now(told_r, known)
        c = changes.collect()
        assert {x.ref_id for x in c if x.open and x.was_open is False} == after - before - {x[0] for x in r}  # reopened
        assert {x.ref_id for x in c if not x.open and x.was_open} == before - after  # resolved
    assert any(x.was_open is False and x.open for x in c)  # the last batch held removals alone


def test_a_parent_sent_again_replaces_itself_and_batches_touch_their_keys_only(spark):
    at = lambda h: T0 + timedelta(hours=h)
    refs = lambda rows: reference_events(spark.createDataFrame(rows, "id long, f string, at timestamp"), "t", "id", "f", "at")
    pars = lambda rows: parent_rows(spark.createDataFrame(rows, "pid long, f string, at timestamp, gone timestamp"), "t", "pid", "f", "at", "gone")
    _, s1 = process_batch(OrphanState(), refs([(1, "a", at(2)), (2, "b", at(2)), (3, "c", None)]), pars([(1, "a", at(1), None), (2, "b", at(1), None)]))
    changes, s2 = process_batch(s1, None, pars([(1, "a", at(1), at(5))]))
    assert [(x.ref_id, x.kind, x.open, x.was_open) for x in changes.collect()] == [(1, None, True, False)]
    assert {b: p for b, p in s2.references.items() if s1.references.get(b) != p}.keys() <= s1.references.keys() and sum(s2.references[b] != s1.references[b] for b in s1.references) == 1
    changes, s3 = process_batch(s2, None, pars([(1, "a", at(1), at(5))]))
    assert changes.count() == 0
    assert {x.ref_id for x in open_orphans(spark, s3).collect()} == {1, 3}
    changes, s4 = process_batch(s3, None, pars([(9, "a", at(9), None)]))
    assert [(x.ref_id, x.open, x.was_open) for x in changes.collect()] == [(1, False, True)]
