import random

from fieldchirp.operators.nearby import near_pairs, nearby_files, region_of


def test_pairs_match_brute_force(spark):
    random.seed(4)
    rows = [(random.choice([f"f{i}", "hot"]), random.choice([0.0, 30.0, random.uniform(-200, 200)]), random.uniform(-100, 100), random.choice([None, float("nan"), 0.0, 25.0])) for i in range(120)]
    rows += [("a", 0.0, 0.0, None), ("b", 30.0, 0.0, 5.0), ("c", 30.0000001, 0.0, None), ("d", None, 1.0, 1.0), (None, 0.0, 0.0, 0.0), ("e", -9999.0, 0.0, 0.0)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "file string, x double, y double, z double")
    ok = [r for r in rows if None not in r[:3] and r[1] != -9999]
    want = set()
    for a in ok:
        for b in ok:
            dz = 0 if any(v is None or v != v for v in (a[3], b[3])) else a[3] - b[3]
            if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + dz**2 <= 900:
                want.add((a[0], b[0]))
    assert {tuple(r) for r in nearby_files(df).collect()} == want
    assert ("a", "b") in want and ("a", "c") not in want
    assert nearby_files(df.limit(0)).count() == 0
    fine = {(r.key_a, r.key_b) for r in near_pairs(df.where("x <> -9999"), "file", "x", "y", "z", 30.0).collect()}
    assert fine == want


def test_a_dense_place_is_no_square_of_its_positions(spark):
    """60,000 jittered positions of four keys within one block."""
    random.seed(5)
    at = {"a": (0.0, 0.0), "b": (3.0, 2.0), "c": (29.0, 0.0), "d": (300.0, 0.0)}
    rows = [(k, x + random.gauss(0, 0.3), y + random.gauss(0, 0.3), 1.0) for k, (x, y) in at.items() for _ in range(15_000)]
    df = spark.createDataFrame(rows, "file string, x double, y double, z double")
    assert {tuple(r) for r in nearby_files(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_regions_of_any_extent(spark):
    random.seed(6)
    pts = [(i, random.uniform(-1000, 1000), random.uniform(-1000, 1000)) for i in range(300)]
    reg = [(f"r{i}", x, y, x + w, y + w) for i, (x, y, w) in enumerate((random.uniform(-1000, 500), random.uniform(-1000, 500), random.choice([0.5, 30.0, 400.0, 1500.0])) for _ in range(40))]
    got = {(r.id, r.region_id) for r in region_of(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(reg, "region_id string, x0 double, y0 double, x1 double, y1 double"), "x", "y", 2.0).collect()}
    assert got == {(i, n) for i, x, y in pts for n, x0, y0, x1, y1 in reg if x0 <= x <= x1 and y0 <= y <= y1}


def test_regions_contain_points(spark):
    pts = spark.createDataFrame([("p", 1.0, 1.0), ("q", 5.0, 5.0), ("r", None, 0.0)], "file string, x double, y double")
    reg = spark.createDataFrame([("in", 0.0, 0.0, 5.0, 5.0), ("out", 6.0, 6.0, 9.0, 9.0), ("null", None, 0.0, 9.0, 9.0)], "region_id string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.file, r.region_id) for r in region_of(pts, reg, "x", "y", 2.0).collect()) == [("p", "in"), ("q", "in")]
