"""Problem 4: points near other points or regions, by space-filling-curve codes.

Every point gets the Morton (Z-order) code of its grid cell.  A disc (or box)
is covered by runs of consecutive codes; the runs are joined with the sorted
codes of the points and the hits are refined by exact distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldchirp.scratch import materialize

BITS = 31
FINE = 4  # cells per side of a block, a power of two
CELLS = 8  # the same for the blocks that discs are joined by


def _spread(v: Column) -> Column:
    """Spread the lower 31 bits of ``v`` to the even bits of a long."""
    # The usual bit masks of interleaving.
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(ix: Column, iy: Column) -> Column:
    """Z-order code of two cell numbers of any sign (below 2**30 in size)."""
    off = 1 << (BITS - 1)
    return _spread(ix.cast("long") + off).bitwiseOR(F.shiftleft(_spread(iy.cast("long") + off), 1))


def cell(c, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("long") if isinstance(c, str) else F.floor(c / F.lit(size)).cast("long")


def box_ranges(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, block: float, fine: int = FINE) -> DataFrame:
    """Cover boxes with ranges of codes, one row per block a box touches.

    A block is a square of ``fine`` x ``fine`` cells, whose codes are
    consecutive.  The code grows with either coordinate, so within a block the
    part of a box lies between the codes of its two corners.  Adds ``block``
    (the code of the block), ``lo`` and ``hi``.
    """
    f = block / fine
    df = df.withColumns({"__fx0": cell(x0, f), "__fy0": cell(y0, f), "__fx1": cell(x1, f), "__fy1": cell(y1, f)}).where("__fx0 <= __fx1 and __fy0 <= __fy1")
    down = lambda c: F.floor(F.col(c) / fine).cast("long")
    df = df.withColumn("__bx", F.explode(F.sequence(down("__fx0"), down("__fx1")))).withColumn("__by", F.explode(F.sequence(down("__fy0"), down("__fy1"))))
    lo = [F.greatest(F.col(f"__f{d}0"), F.col(f"__b{d}") * fine) for d in "xy"]
    hi = [F.least(F.col(f"__f{d}1"), F.col(f"__b{d}") * fine + (fine - 1)) for d in "xy"]
    df = df.withColumns({"lo": morton(*lo), "hi": morton(*hi)}).withColumn("block", block_of(F.col("lo"), fine))
    return df.drop("__fx0", "__fy0", "__fx1", "__fy1", "__bx", "__by")


def block_of(code: Column, fine: int = FINE) -> Column:
    return F.shiftright(code, 2 * (fine.bit_length() - 1))


def near_pairs(points: DataFrame, key: str, x: str, y: str, z: str, radius: float, distance: bool = True) -> DataFrame:
    """Pairs of different keys with positions at most ``radius`` apart (inclusive).

    Distance is in x, y, z, or in x, y where either z is missing.  A key may
    have several positions; the pair is near if any two of them are.  Null and
    NaN coordinates mean missing; rows without x, y or key take no part.
    Repeated positions are taken once.  Empty tables give no pairs.

    Positions are first gathered in cells of an eighth of the radius.  Cells
    are joined by their boxes: an equality on the block of codes plus a range
    on the code itself.  A block holds at most 64 cells twice over (with and
    without z), so a place however dense is no hot key there.  Cells wholly
    within the radius of each other make their keys pairs as they are.  Cells of
    which some positions may be nearer and others not are compared by the
    boxes of each key in cells eight times finer, and position by position
    only where these can't tell either and the two keys aren't a pair yet; two
    cells that hold the same single key not at all.  What is left grows with the pairs that come out, not with the square
    of the positions.

    Columns: key_a, key_b (key_a < key_b); with ``distance`` the least one as
    dist, for which every pair of cells is compared position by position.
    """
    num = lambda c: F.when(~F.isnan(F.col(c)), F.col(c) + F.lit(0.0))
    p = points.select(F.col(key).alias("key"), num(x).alias("x"), num(y).alias("y"), num(z).alias("z")).where("key is not null and x is not null and y is not null")
    fine = radius / CELLS
    code = morton(cell("x", fine), cell("y", fine)).alias("code")
    places = p.select("key", "x", "y", F.coalesce("z", F.lit(0.0)).alias("z"), F.col("z").isNotNull().alias("hz"), code).distinct()
    edges = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))]
    cells = places.groupBy("code", "hz").agg(*edges, F.min("key").alias("k0"), F.max("key").alias("k1"))
    r = radius * (1 + 1e-9) + 1e-9  # a hair wider, as the edges are rounded; the exact test follows
    right = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns]).withColumn("block", block_of(F.col("b_code"), CELLS))
    left = box_ranges(cells, F.col("x0") - r, F.col("y0") - r, F.col("x1") + r, F.col("y1") + r, radius, CELLS)
    apart = lambda c: F.greatest(F.col(f"{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"{c}1"), F.lit(0.0))
    across = lambda c: F.greatest(F.col(f"{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"{c}0"))
    flat = lambda c, v: F.when(F.col("hz") & F.col("b_hz"), v).otherwise(0.0) if c == "z" else v
    square = lambda f: sum((flat(c, f(c)) * flat(c, f(c)) for c in "yz"), f("x") * f("x"))
    # each unordered pair of cells once; a cell meets itself too
    once = (F.col("code") < F.col("b_code")) | ((F.col("code") == F.col("b_code")) & (F.col("hz") <= F.col("b_hz")))
    alone = (F.col("k0") == F.col("k1")) & (F.col("b_k0") == F.col("b_k1")) & (F.col("k0") == F.col("b_k0"))
    met = left.join(right, "block").where(F.col("b_code").between(F.col("lo"), F.col("hi")) & (square(apart) <= r * r) & once & ~alone)
    sure = square(across) * (1 + 1e-9) <= radius * radius
    met = met.select("code", "hz", "b_code", "b_hz", sure.alias("sure"))
    b = lambda df: df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    cell_key, b_key = ["code", "hz"], ["b_code", "b_hz"]
    gap = lambda c: F.col(c) - F.col(f"b_{c}")
    ends = [F.least("key", "b_key").alias("key_a"), F.greatest("key", "b_key").alias("key_b")]
    if distance:
        exact = met.join(places, cell_key).join(b(places), b_key).where("key <> b_key").withColumn("d2", square(gap)).where(F.col("d2") <= radius * radius)
        return exact.groupBy(*ends).agg(F.min("d2").alias("d2")).select("key_a", "key_b", F.sqrt("d2").alias("dist"))

    met = materialize(met, "near-cells")
    held = places.select(*cell_key, "key").distinct()
    whole = met.where("sure").join(held, cell_key).join(b(held), b_key).where("key <> b_key").select(*ends)
    # Where some positions may be nearer and others not, the boxes of each key in cells eight times finer.
    tiny = morton(cell("x", fine / CELLS), cell("y", fine / CELLS)).alias("tiny")
    boxes = places.groupBy(*cell_key, "key", tiny).agg(*edges)
    closer = met.where("not sure").join(boxes, cell_key).join(b(boxes), b_key).where((F.col("key") != F.col("b_key")) & (square(apart) <= r * r))
    closer = materialize(closer.select(*cell_key, "tiny", "key", *b_key, "b_tiny", "b_key", sure.alias("sure")), "near-boxes")
    known = materialize(whole.unionByName(closer.where("sure").select(*ends)).distinct(), "near-known")
    # Position by position only what no box could tell.
    doubt = closer.where("not sure").select("*", *ends).join(known, ["key_a", "key_b"], "left_anti")
    spots = places.withColumn("tiny", tiny)
    exact = doubt.join(spots, [*cell_key, "tiny", "key"]).join(b(spots), [*b_key, "b_tiny", "b_key"]).where(square(gap) <= radius * radius)
    return known.unionByName(exact.select("key_a", "key_b").distinct())


def region_of(points: DataFrame, regions: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Each point with the axis-parallel regions (region_id, x0, y0, x1, y1; edges included) that contain it.

    A region is cut into blocks as wide as befits its extent (``size``
    doubled as often as it takes for at most some 25 blocks a region), blocks
    are coded, and points meet them once for each width in use (at most as
    many as there are doublings); the hits are refined exactly.  Columns of
    the points are kept, with region_id added; points in no region don't
    appear; null corners contain nothing.
    """
    named = regions.select("region_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x0 <= x1 and y0 <= y1")
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.lit(4.0 * size)
    named = named.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1.0)))), F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in named.select("level").distinct().collect())  # as many as doublings of the size
    px, py = F.col(x), F.col(y)
    found = None
    for level in levels:
        width = size * 2.0**level
        mine = named.where(F.col("level") == level)
        cover = box_ranges(mine, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), width).select(*[F.col(c).alias(f"__{c}") for c in ("region_id", "x0", "y0", "x1", "y1", "lo", "hi", "block")])
        coded = points.withColumn("__code", morton(cell(x, width / FINE), cell(y, width / FINE))).withColumn("__cb", block_of(F.col("__code")))
        inside = px.between(F.col("__x0"), F.col("__x1")) & py.between(F.col("__y0"), F.col("__y1"))
        hit = coded.join(cover, (F.col("__cb") == F.col("__block")) & F.col("__code").between(F.col("__lo"), F.col("__hi")) & inside)
        hit = hit.select(*[coded[c] for c in points.columns], F.col("__region_id").alias("region_id"))
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else points.limit(0).withColumn("region_id", F.lit(None).cast(regions.schema["region_id"].dataType))


def nearby_files(coords: DataFrame, radius: float = 30.0, placeholder: float = -9999.0) -> DataFrame:
    """Pairs of recording files whose positions are within ``radius`` metres."""
    from fieldchirp.functions.keys import clean_key

    ok = lambda c: F.when(F.col(c) != placeholder, F.col(c))
    p = coords.select(clean_key("file").alias("file"), ok("x").alias("x"), ok("y").alias("y"), F.col("z").alias("z"))
    return near_pairs(p, "file", "x", "y", "z", radius, distance=False).select(F.col("key_a").alias("file_a"), F.col("key_b").alias("file_b"))
