"""Top N per group and splits by recording."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldchirp.llm import queries, splits
from fieldchirp.llm.splits import connected, find_recordings, same_recording_pairs, split_rows
from fieldchirp.llm.topn import best_windows, top_n


def test_top_n_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", " a", "b"]), rng.choice([0.0, 3.0, 6.0, float(rng.randrange(300)), None]), rng.choice([None, float("nan"), 0.5, 0.5, 0.9, rng.random()])) for i in range(900)]
    rows += [(2000, None, 0.0, 0.9), (2001, "one", 1.0, 0.1)]
    df = spark.createDataFrame(rows, "pred_id long, file string, start_time double, test_species double").withColumn("score", F.lit("clash"))
    win = {}
    for i, f, t, s in rows:
        if f is not None:
            k = (f.strip(), t if t is not None else ("own", i))
            if k not in win or i < win[k][0]:
                win[k] = (i, s)
    by = {}
    for (f, t), (i, s) in win.items():
        if s is not None and s == s:
            by.setdefault(f, []).append((-s, isinstance(t, tuple), 0 if isinstance(t, tuple) else t, i))
    want = {(r[3], k) for v in by.values() for k, r in enumerate(sorted(v)[:5], 1)}
    for n in (1, 6):
        assert {(r.pred_id, r.top_rank) for r in best_windows(df, 5, n).collect()} == want
    assert best_windows(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "g string, v int")
    assert sorted((r.v, r.top_rank) for r in top_n(nulls, ["g"], ["v"], 1).collect()) == [(1, 1), (3, 1)]


def _detections(spark):
    rng = random.Random(9)
    files = {f"r{i}": sorted(rng.uniform(0, 600) for _ in range(rng.randrange(5, 40))) for i in range(40)}
    files["hot"] = sorted(rng.uniform(0, 30_000) for _ in range(900))
    for i, (src, shift, drop) in enumerate([("r0", 0, 0.1), ("r0", 17.3, 0.15), ("r1", -4.2, 0.2), ("r2", 0, 0), ("hot", 3.5, 0.1), ("r3", 1.0, 0.6)]):
        files[f"copy{i}"] = [t + shift + rng.uniform(-0.003, 0.003) for t in files[src] if rng.random() >= drop]
    rows, n = [], 0
    for f, ts in files.items():
        for t in ts:
            rows.append((n, f, round(t, 3)))
            n += 1
    rows += [(n, None, 5.0), (n + 1, "r0", None), (n + 2, "r1", float("nan"))] + [(n + 3 + i, f" {r[1]}", r[2]) for i, r in enumerate(rows[:30])]
    return rows, spark.createDataFrame(rows, "det_id long, file string, start_time double")


def _brute(rows):
    starts = {}
    for _, f, t in rows:
        if f is not None and t is not None and t == t:
            starts.setdefault(f.strip(), set()).add(round(t * 10_000))
    out = set()
    for a, b in combinations(sorted(starts), 2):
        x, y = sorted((starts[a], starts[b]), key=len)
        if len(x) < 11:
            continue
        ys = sorted(y)
        diffs = sorted((v - u, u) for u in x for v in ys)
        lo, best, inside = 0, 0, {}
        for d, u in diffs:
            inside[u] = inside.get(u, 0) + 1
            while diffs[lo][0] < d - 200:
                w = diffs[lo][1]
                inside[w] -= 1
                if not inside[w]:
                    del inside[w]
                lo += 1
            best = max(best, len(inside))
        if best >= 0.7 * len(x):
            out.add((a, b))
    return out


def test_pairs_and_splits(spark):
    rows, df = _detections(spark)
    want = _brute(rows)
    assert {(r.file_a, r.file_b) for r in same_recording_pairs(df).collect()} == want and len(want) >= 5
    assert same_recording_pairs(df.limit(0)).count() == 0
    got = split_rows(df).collect()
    assert sorted(r.det_id for r in got) == [r[0] for r in rows]
    split = {r.det_id: r.split for r in got}
    of = {}
    for i, f, _ in rows:
        if f is not None:
            of.setdefault(f.strip(), set()).add(split[i])
    assert all(len(v) == 1 for v in of.values())
    assert all(of[a] == of[b] for a, b in want)
    share = sum(s == "train" for s in split.values()) / len(split)
    assert 0.7 < share < 0.9


def test_pairs_where_the_larger_file_holds_far_more(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for i, (n, ratio) in enumerate([(11, 2), (11, 5), (11, 10), (60, 5), (12, 40), (15, 3), (23, 10)]):
        small = sorted(rng.uniform(0, 900) for _ in range(n))
        kept = rng.sample(small, -(-7 * n // 10))
        large = [t + 31.7 + rng.uniform(-0.004, 0.004) for t in kept] + [rng.uniform(0, 950) for _ in range(n * ratio - len(kept))]
        # half of them contained in one far longer file
        name = "long" if i % 2 else f"l{i}"
        rows += [(f"s{i}", t) for t in small] + [(name, t + (5000 * i if i % 2 else 0)) for t in large]
        want.add((name, f"s{i}") if name < f"s{i}" else (f"s{i}", name))
    # starts so close that two meet one, or one meets two
    near = [t + d for t in (1, 40, 90, 170, 260, 340, 500) for d in (0, 0.012)]
    rows += [("near", t) for t in near] + [("near2", t + 3 + rng.choice([0, 0.006])) for t in near] + [("near2", 3000 + i) for i in range(30)]
    rows = [(i, f, round(float(t), 3)) for i, (f, t) in enumerate(rows)]
    brute = _brute(rows)
    assert want <= brute
    got = {(r.file_a, r.file_b) for r in same_recording_pairs(spark.createDataFrame(rows, "det_id long, file string, start_time double")).collect()}
    assert got == brute


def test_copies_and_regular_grids(spark):
    rng = random.Random(12)
    rows = [(f"same{i}", 3.0 * k + 7 * i) for i in range(40) for k in range(60)]  # exact copies on a grid: one class
    rows += [(f"grid{i}", 3.0 * k) for i in range(12) for k in range(40) if rng.random() < 0.9]  # the grid with holes
    rows += [(f"own{i}", rng.uniform(0, 600)) for i in range(20) for _ in range(25)]
    rows = [(i, f, round(t, 3)) for i, (f, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "det_id long, file string, start_time double")
    found = find_recordings(df)
    assert {r["class"] for r in found.classes.where("file like 'same%'").collect()} == {"same0"}
    want = _brute(rows)
    got = same_recording_pairs(df).collect()
    assert {(r.file_a, r.file_b) for r in got} == want and len(want) > 40 * 39 / 2 and len(got) == len(want)
    at = {}
    for _, f, t in rows:
        at.setdefault(f, []).append(t)
    for r in got:
        a, b = at[r.file_a], at[r.file_b]
        common = sum(any(abs(t + r.shift - u) <= 0.0101 for u in b) for t in a) if len(a) <= len(b) else sum(any(abs(t - r.shift - u) <= 0.0101 for u in a) for t in b)
        assert common == r.n_common


def test_contraction(spark):
    rng = random.Random(10)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)] + [(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}") for _ in range(25)] + [("x", None), ("x", "x"), ("v0", "v1")]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if b is not None and a != b:
            root[find(a)] = find(b)
    got = {r.vertex: r.component for r in connected(spark.createDataFrame(edges, "file_a string, file_b string")).collect()}
    assert set(got) == set(root)
    pairs = {(find(v), c) for v, c in got.items()}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    assert connected(spark.createDataFrame([], "file_a string, file_b string")).count() == 0


def test_queries_are_listed():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert {"p1_found", "p6_found", "p8_found", "p9_mix", "p10_found"} <= set(queries.QUERIES)


def test_meets_of_many_files_that_share_nothing(monkeypatch):
    rng = np.random.default_rng(13)
    met, repeat = [0], np.repeat

    def counted(*a):
        out = repeat(*a)
        met[0] += len(out)
        return out

    files = {f"f{i:04}": np.sort(rng.choice(6_000_000, 20, replace=False)) for i in range(4000)}
    files["f9999"] = np.sort(np.append(rng.permutation(files["f0007"])[:14] + 4321, rng.choice(6_000_000, 60, replace=False)))
    width = 1200 * splits.UNIT
    starts = pd.DataFrame([(f, len(t), 0, t) for f, t in files.items()], columns=["file", "n", "bucket", "ts"])
    probes = pd.DataFrame([(f, len(t), t, [0, 1, 2, 3]) for f, t in files.items() if len(t) == 20], columns=["file", "n", "ts", "use"])
    monkeypatch.setattr(splits.np, "repeat", counted)
    got = splits._meet(probes, starts, width, 100, 0.7)
    assert ("f0007", "f9999") in set(zip(got["small"], got["large"], strict=True)) and len(got) < 20
    assert met[0] < 100 * 80_000  # pairs at one common gap would be many times that
