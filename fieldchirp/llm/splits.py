"""Problem 6: splits that keep all rows of one recording together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldchirp.functions.keys import clean_key
from fieldchirp.operators.rangescan import running
from fieldchirp.scratch import materialize

UNIT = 10_000  # times are counted in tenths of a millisecond
CHUNK = 60  # starts of a file that are probed together; a multiple of every size of a block
PROBED = 2_000_000  # starts of chunks that a task probes with
HELD = 2_000_000  # starts that a task probes
REACH = 1200 * UNIT  # least width of the spans of time that a larger file is cut into
SLICE = 1_000_000  # triples of starts met at once
# Triples to probe a block by, by its size: whichever one of its starts fails, one of the triples is left.
TRIPLES = {4: ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)), 5: ((0, 1, 2), (2, 3, 4), (0, 1, 3)), 6: ((0, 1, 2), (3, 4, 5))}


def start_points(detections: DataFrame) -> DataFrame:
    """Distinct (file, t), t the start_time to a tenth of a millisecond; rows without either are left out."""
    t = F.col("start_time").cast("double")
    return detections.select(clean_key("file").alias("file"), F.when(~F.isnan(t), F.round(t * UNIT).cast("long")).alias("t")).where("file is not null and t is not null").distinct()


def _spread(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (many[0] of them), lo[1], ..."""
    return np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)


def _hash(bits: int, *values: np.ndarray) -> np.ndarray:
    h = np.uint64(0)
    for v, odd in zip(values, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=False):
        h = h + v.astype(np.uint64) * np.uint64(odd)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _bits(n: int, most: int) -> int:
    return int(np.clip(int(n).bit_length(), 10, most))


class Waiting:
    """Arrays gathered until there are enough to go on with."""

    def __init__(self, go: Callable[..., None]) -> None:
        self.go, self.parts, self.n = go, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])
            if self.n > SLICE:
                self.end()

    def end(self) -> None:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.n = [], 0
            self.go(*columns)


def _pairs(place: np.ndarray, core: np.ndarray, tol: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of starts, x of the core, y - x from -2 tol to ``reach``, by the rank of y from x.

    Two starts of a small file may meet one of the larger, or two in turned order, so gaps begin at -2 tol.
    """
    end = len(place)
    back = int((np.arange(end) - np.searchsorted(place, place - 2 * tol, "left")).max())
    xs, i = np.flatnonzero(core), -back
    while len(xs):
        at = xs[(xs + i >= 0) & (xs + i < end)]
        gap = place[at + i] - place[at]
        near = (gap >= -2 * tol) & (gap <= reach)
        yield at[near], at[near] + i
        if i > 0:  # later ranks lie farther
            xs = at[near]
        i += 1


def _meet(probes: pd.DataFrame, starts: pd.DataFrame, width: int, tol: int, share: float) -> pd.DataFrame:
    """Shifts that bring a block, but for one start at most, upon starts of a larger file, one per (small, large, slot).

    Triples of starts of the larger files are looked up by both their gaps in
    a table of the triples of all blocks.  A shift is dropped where two starts
    of the block fail, or more of the chunk than may fail in all.
    """
    none = pd.DataFrame({"small": pd.Series(dtype=str), "large": pd.Series(dtype=str), "slot": pd.Series(dtype="int64"), "shift": pd.Series(dtype="int64")})
    if probes.empty or starts.empty:
        return none
    cell = 4 * tol
    held = starts["ts"].map(len).to_numpy()
    unit = np.repeat(np.arange(len(held)), held)
    t = np.concatenate(starts["ts"].to_list())
    bucket = starts["bucket"].to_numpy()
    place = unit.astype(np.int64) * 4 * width + (t - (bucket[unit] - 1) * width)
    core = t // width == bucket[unit]
    n_large, large = starts["n"].to_numpy(), starts["file"].to_numpy()

    size = probes["ts"].map(len).to_numpy()
    ts, at_row = np.concatenate(probes["ts"].to_list()), np.cumsum(size) - size
    n_small, small = probes["n"].to_numpy(), probes["file"].to_numpy()
    spare = n_small - np.ceil(n_small * share - 1e-9).astype(np.int64)
    of_block = np.minimum(6, n_small // (spare // 2 + 1))
    used = probes["use"].map(len).to_numpy()
    row = np.repeat(np.arange(len(size)), used)
    block = at_row[row] + of_block[row] * np.concatenate(probes["use"].to_list()).astype(np.int64)
    parts = [(np.flatnonzero(of_block[row] == s), abc) for s, family in TRIPLES.items() for abc in family]
    row, block, base, g1, g2 = (np.concatenate(c) for c in zip(*((row[k], block[k], ts[block[k] + a], ts[block[k] + b] - ts[block[k] + a], ts[block[k] + c] - ts[block[k] + b]) for k, (a, b, c) in parts), strict=True))

    # Two tables of the triples: by the two cells that each gap may lie in, and by those of the first gap alone.
    ends = [((g1 + d) // cell, (g2 + e) // cell) for d in (-2 * tol, 2 * tol) for e in (-2 * tol, 2 * tol)]
    bits = _bits(4 * len(g1), 24)
    key = np.concatenate([_hash(bits, *c) for c in ends])
    entry = np.argsort(key, kind="stable")
    begin = np.append(0, np.cumsum(np.bincount(key, minlength=1 << bits)))
    entry %= len(g1)
    fine, known_bits = 2 * tol, _bits(64 * len(g1), 26)
    known = np.zeros(1 << known_bits, dtype=bool)
    for d in (-1, 0, 1):
        for e in (-1, 0, 1):
            known[_hash(known_bits, g1 // fine + d, g2 // fine + e)] = True
    key = np.concatenate([(g1 + d) // cell + 1 for d in (-2 * tol, 2 * tol)])
    by_one = np.argsort(key, kind="stable")
    cells = g1.max() // cell + 3
    begin_one = np.append(0, np.cumsum(np.bincount(key, minlength=cells)))
    by_one %= len(g1)
    most, least = np.full(cells, -1, dtype=np.int64), np.full(cells, np.iinfo(np.int64).max // 2)
    np.maximum.at(most, key, np.tile(g2, 2))
    np.minimum.at(least, key, np.tile(g2, 2))
    # Starts a tick in each span, to tell which is less: the thirds of a pair or the triples of its gap.
    at_unit = np.cumsum(held) - held
    crowd = held / (place[at_unit + held - 1] - place[at_unit] + 1)

    taken_bits = _bits(32 * len(place), 26)
    taken = np.zeros(1 << taken_bits, dtype=bool)
    for d in (0, -1):
        taken[_hash(taken_bits, place // cell + d)] = True

    def near(due: np.ndarray) -> np.ndarray:
        ok = taken[_hash(taken_bits, (due - 2 * tol) // cell)]
        sure = due[ok]
        k = np.searchsorted(place, sure - 2 * tol, "left")
        ok[ok] = (k < len(place)) & (place[np.minimum(k, len(place) - 1)] <= sure + 2 * tol)
        return ok

    def verified(x: np.ndarray, mine: np.ndarray) -> pd.DataFrame:
        for lo, many, spared in ((block, of_block[row], 1), (at_row[row], size[row], spare[row])):
            m = many[mine]
            which = np.repeat(np.arange(len(mine)), m)
            away = ts[_spread(lo[mine], m)] - base[mine[which]]
            within = np.abs(away) <= width - 4 * tol  # beyond the margins nothing can be said here
            which, away = which[within], away[within]
            ok = np.bincount(which[~near(place[x[which]] + away)], minlength=len(mine)) <= (spared if np.isscalar(spared) else spared[mine])
            x, mine = x[ok], mine[ok]
        shift = t[x] - base[mine]
        return pd.DataFrame({"small": row[mine], "large": unit[x], "slot": shift // cell, "shift": shift}).drop_duplicates(["small", "large", "slot"])

    found = []

    def larger(x: np.ndarray, mine: np.ndarray) -> None:
        more = n_large[unit[x]] - n_small[row[mine]]
        keep = more > 0
        ties = np.flatnonzero(more == 0)
        keep[ties] = small[row[mine[ties]]] < large[unit[x[ties]]]
        if keep.any():
            found.append(verified(x[keep], mine[keep]))

    def slices(many: np.ndarray) -> Iterator[slice]:
        upto, at = np.cumsum(many), 0
        while at < len(many):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            yield slice(at, end)
            at = end

    def look_up(x: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        h = _hash(bits, one // cell, two // cell)
        many = begin[h + 1] - begin[h]
        for s in slices(many):
            theirs = np.repeat(np.arange(s.start, s.stop), many[s])
            mine = entry[_spread(begin[h[s]], many[s])]
            ok = (np.abs(g1[mine] - one[theirs]) <= 2 * tol) & (np.abs(g2[mine] - two[theirs]) <= 2 * tol)
            larger(x[theirs[ok]], mine[ok])

    def look_out(x: np.ndarray, one: np.ndarray, c: np.ndarray) -> None:
        many = begin_one[c + 1] - begin_one[c]
        for s in slices(many):
            theirs = np.repeat(np.arange(s.start, s.stop), many[s])
            mine = by_one[_spread(begin_one[c[s]], many[s])]
            ok = np.abs(g1[mine] - one[theirs]) <= 2 * tol
            mine, theirs = mine[ok], x[theirs[ok]]
            ok = near(place[theirs] + g1[mine] + g2[mine])
            larger(theirs[ok], mine[ok])

    def look_on(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
        lo = np.searchsorted(place, place[y] + least[c] - 2 * tol, "left")
        many = np.searchsorted(place, place[y] + most[c] + 2 * tol, "right") - lo
        one = place[y] - place[x]
        for s in slices(many):
            k = np.repeat(np.arange(s.start, s.stop), many[s])
            two = place[_spread(lo[s], many[s])] - place[y[k]]
            ok = known[_hash(known_bits, (one // fine)[k], two // fine)]
            triples.add(x[k[ok]], one[k[ok]], two[ok])

    few, crowded, triples = Waiting(look_out), Waiting(look_on), Waiting(look_up)
    for x, y in _pairs(place, core, tol, (cells - 2) * cell - 1):
        one = place[y] - place[x]
        c = one // cell + 1
        held_by = begin_one[c + 1] - begin_one[c]
        thirds = (most[c] - least[c] + 4 * tol) * crowd[unit[x]] + 1
        out = (held_by > 0) & (held_by <= thirds / 3)
        few.add(x[out], one[out], c[out])
        up = (held_by > 0) & ~out
        crowded.add(x[up], y[up], c[up])
    for waiting in (few, crowded, triples):
        waiting.end()
    if not found:
        return none
    out = pd.concat(found)
    out["small"], out["large"] = small[out["small"]], large[out["large"]]
    return out.drop_duplicates(["small", "large", "slot"])


@dataclass
class Recordings:
    """``classes``: every file of enough starts with the class of files that hold exactly the same starts but for one shift, (file, class, n, first).
    ``pairs``: different classes that hold the same recording, (class_a, class_b, n_common, shift), shift in tenths of a millisecond from a to b.
    A class bears the name of its first file.
    """

    classes: DataFrame
    pairs: DataFrame


def _growing(df: DataFrame) -> DataFrame:
    """Joined by sorting: the table grows with the data, however small its files look."""
    return df.hint("merge")


def _probes(placed: DataFrame, spare_of: Callable[[Column], Column], cell: int, partitions: int | None) -> DataFrame:
    """Chunks of starts with the blocks to probe by: (file, n, chunk, ts, use, width).

    Of a file with k starts that may fail, k // 2 + 1 blocks of as many starts
    as fit, six at most; where there are more, those whose gaps the fewest
    blocks of the corpus share: gaps that every file has, as on a regular
    grid, are left out where a file has others.
    """
    need = F.floor(spare_of(F.col("n")) / 2) + 1
    size = F.least(F.lit(max(TRIPLES)), F.floor(F.col("n") / need)).cast("int")
    chunk = F.floor((F.col("pos") - 1) / CHUNK).alias("chunk")
    chunks = materialize(placed.groupBy("file", "n", chunk).agg(F.array_sort(F.collect_list("t")).alias("ts")).withColumn("s", size).where(F.size("ts") >= F.col("s")), "chunks")
    t = lambda i: F.col("ts")[(F.col("s") * F.col("i") + i).cast("int")]
    last = F.col("s") - 1
    blocks = chunks.withColumn("i", F.explode(F.sequence(F.lit(0), (F.floor(F.size("ts") / F.col("s")) - 1).cast("int"))))
    blocks = blocks.select("file", "n", "chunk", "i", (t(last) - t(0)).alias("width"), F.explode(F.array((t(1) - t(0)), (t(last) - t(last - 1)))).alias("gap")).withColumn("cell", F.floor(F.col("gap") / cell)).drop("gap")
    often = blocks.groupBy("cell").agg(F.count("*").alias("often"))
    cost = blocks.join(_growing(often), "cell").groupBy("file", "n", "chunk", "i", "width").agg(F.sum("often").alias("cost")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(cost, ["file"], ["cost", "width", "chunk", "i"], {"rank": "one"}, partitions=partitions, name="blocks")
    use = ranked.where(F.col("rank") <= need).groupBy("file", "chunk").agg(F.array_sort(F.collect_list("i")).alias("use"), F.max("width").alias("width"))
    return chunks.drop("s").join(_growing(use), ["file", "chunk"])


def find_recordings(detections: DataFrame, min_starts: int = 11, share: float = 0.7, tolerance: float = 0.01, partitions: int | None = None) -> Recordings:
    """Files that hold the same recording, by classes of exact copies.

    Two files hold the same recording when each has at least ``min_starts``
    distinct start times and ``share`` of those of the file with fewer recur
    in the other within ``tolerance`` seconds, directly or after one shift.
    Files whose starts are the same but for one shift are one class and are
    searched once.

    No pair is missed, whatever else the larger file holds.  The starts of a
    file are cut into blocks of four, five or six.  With k starts that needn't
    recur, k // 2 + 1 blocks can't all lack two or more, so one of any so many
    lacks one at most: the rarest are probed, by triples of their starts of
    which one is left whichever start fails, against the triples of starts at
    the same two gaps in files with as many starts or more.  The shifts so
    found are verified over all starts, in integers.
    ``ValueError`` where ``share`` and ``min_starts`` leave too few blocks.

    A larger file is cut into spans of time as wide as the widest probe, with
    margins; no file is collected.  The work grows with the triples of starts
    near each other and with the number of those at the same two gaps, which
    is small unless starts are dense or regular.  Null and NaN keys or times
    take no part; repeated rows count once; an empty table
    gives no pairs.
    """
    count_spare = lambda n: n - math.ceil(n * share - 1e-9)
    if share <= 0.5 or any(2 * (n // 4) <= count_spare(n) for n in range(min_starts, min_starts + math.ceil(2 / (share - 0.5)) + 4)):
        raise ValueError("share and min_starts leave no block of four with three common starts for certain")
    spare_of = lambda n: n - F.ceil(n * share - 1e-9)
    tol = round(tolerance * UNIT)
    spark = detections.sparkSession
    placed = running(start_points(detections).withColumn("one", F.lit(1).cast("long")), ["file"], ["t"], {"pos": "one"}, partitions=partitions, name="starts").drop("one")
    counts = placed.groupBy("file").agg(F.max("pos").alias("n"), F.min("t").alias("first")).where(F.col("n") >= min_starts)
    placed = materialize(placed.join(_growing(counts), "file"), "starts")
    # 128 bits of the starts after the first, whatever their order: a partial aggregate, so no file is collected.
    since = F.col("t") - F.col("first")
    marks = placed.groupBy("file", "n", "first").agg(F.bit_xor(F.xxhash64(since)).alias("x"), F.bit_xor(F.xxhash64(since, F.lit(1))).alias("y"))
    named = marks.groupBy("n", "x", "y").agg(F.min("file").alias("class"))
    classes = materialize(marks.join(_growing(named), ["n", "x", "y"]).select("file", "class", "n", "first"), "classes")
    ones = classes.where("file = class").select("file")
    placed = materialize(placed.join(_growing(ones), "file", "left_semi").drop("first"), "class-starts")
    none = Recordings(classes, spark.createDataFrame([], "class_a string, class_b string, n_common long, shift long"))
    most = [r[0] for r in placed.where("pos = 1").orderBy(F.col("n").desc()).limit(2).select("n").collect()]
    if len(most) < 2:
        return none

    # A file longer than all others has none to be found in.
    probes = materialize(_probes(placed.where(F.col("n") <= most[1]), spare_of, 4 * tol, partitions), "probes")
    n_probed, widest = probes.agg(F.sum(F.size("ts")), F.max("width")).first()
    width = max(widest + 4 * tol, REACH)
    bucket = F.floor(F.col("t") / width)
    spans = placed.select("file", "n", "t", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), bucket.alias("own"))
    # A span holds its margins too; one with nothing but margins is none.
    spans = spans.groupBy("file", "n", "bucket").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.max(F.col("own") == F.col("bucket")).alias("core")).where("core").drop("core")
    spans = materialize(spans, "spans")
    n_held = spans.agg(F.sum(F.size("ts"))).first()[0]
    # Every p meets every q: as few of both as leave tasks of bounded size, and enough tasks to keep all cores at work.
    p = 1 + n_probed // PROBED
    q = max(1 + n_held // HELD, -(-2 * spark.sparkContext.defaultParallelism // p))
    starts = spans.withColumns({"q": F.pmod(F.xxhash64("file", "bucket"), F.lit(q)).cast("int"), "p": F.explode(F.sequence(F.lit(0), F.lit(p - 1)))})
    sent = probes.select("file", "n", "ts", "use", F.pmod(F.xxhash64("file", "chunk"), F.lit(p)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("q"))
    apart = lambda df: df.repartition(2 * p * q, "p", "q").groupBy("p", "q")
    met = apart(sent).cogroup(apart(starts)).applyInPandas(lambda a, b: _meet(a, b, width, tol, share), "small string, large string, slot long, shift long")
    # One candidate per pair and shift, to four tolerances.
    cand = materialize(met.groupBy("small", "large", "slot").agg(F.min("shift").alias("shift")), "shifts")

    reach = 8 * tol
    cells = 16 * tol
    ours = cand.join(_growing(placed.select(F.col("file").alias("small"), "n", "t")), "small").withColumn("due", F.col("t") + F.col("shift"))
    ours = ours.withColumn("cell", F.explode(F.sequence(F.floor((F.col("due") - reach) / cells), F.floor((F.col("due") + reach) / cells))))
    theirs = placed.select(F.col("file").alias("large"), F.col("t").alias("tl"), F.floor(F.col("t") / cells).alias("cell"))
    hit = ours.join(_growing(theirs), ["large", "cell"]).where(F.abs(F.col("tl") - F.col("due")) <= reach)
    group = ["small", "large", "n", "slot"]
    hit = hit.select(*group, "t", (F.col("tl") - F.col("t")).alias("d"))
    # A start recurs for every lower end of a range of twice the tolerance from d - 2 tol to d; its ranges are cut so that it counts once.
    after = F.lead("d").over(Window.partitionBy(*group, "t").orderBy("d"))
    edges = F.array(F.struct((F.col("d") - 2 * tol).alias("at"), F.lit(1).alias("k")), F.struct((F.least(F.col("d"), F.col("after") - 2 * tol - 1) + 1).alias("at"), F.lit(-1).alias("k")))
    tally = hit.withColumn("after", after).select(*group, F.inline(edges)).groupBy(*group, "at").agg(F.sum("k").alias("k"))
    held = tally.withColumn("m", F.sum("k").over(Window.partitionBy(*group).orderBy("at")))
    best = held.groupBy("small", "large", "n").agg(F.max("m").alias("n_common"), F.max_by("at", F.struct("m", "at")).alias("d"))
    enough = best.where(F.col("n_common") >= F.ceil(F.col("n") * share - 1e-9))
    pairs = enough.select(F.col("small").alias("class_a"), F.col("large").alias("class_b"), "n_common", (F.col("d") + tol).alias("shift"))
    return Recordings(classes, materialize(pairs, "class-pairs"))


def recording_groups(found: Recordings, seed: int = 17) -> DataFrame:
    """Recording of every file that has another name: (vertex, component), by contraction of the links between classes and from files to their class."""
    links = found.pairs.select(F.col("class_a").alias("file_a"), F.col("class_b").alias("file_b"))
    copies = found.classes.where("file <> class").select(F.col("class").alias("file_a"), F.col("file").alias("file_b"))
    return connected(links.unionByName(copies), seed=seed)


def same_recording_pairs(detections: DataFrame, min_starts: int = 11, share: float = 0.7, tolerance: float = 0.01, partitions: int | None = None, seed: int = 17) -> DataFrame:
    """Pairs of file keys that hold the same recording: file_a < file_b, n_common, shift (seconds from a to b).

    The pairs of classes of ``find_recordings`` spelt out for their files, of
    which both must lie in one component of ``recording_groups``.
    """
    found = find_recordings(detections, min_starts, share, tolerance, partitions)
    groups = recording_groups(found, seed)
    member = lambda s: found.classes.select(F.col("class").alias(f"class_{s}"), F.col("file").alias(f"f{s}"), F.col("n").alias(f"n{s}"), F.col("first").alias(f"t{s}"))
    named = lambda s: found.classes.where("file = class").select(F.col("class").alias(f"class_{s}"), F.col("first").alias(f"r{s}"))
    across = found.pairs.join(_growing(named("a")), "class_a").join(_growing(named("b")), "class_b").join(_growing(member("a")), "class_a").join(_growing(member("b")), "class_b")
    across = across.select("fa", "fb", "n_common", (F.col("shift") + (F.col("tb") - F.col("rb")) - (F.col("ta") - F.col("ra"))).alias("shift"))
    same = member("a").join(_growing(member("b")), F.col("class_a") == F.col("class_b")).where("fa < fb").select("fa", "fb", F.col("na").alias("n_common"), (F.col("tb") - F.col("ta")).alias("shift"))
    of = lambda s: groups.select(F.col("vertex").alias(f"f{s}"), F.col("component").alias(f"g{s}"))
    held = across.unionByName(same).join(_growing(of("a")), "fa").join(_growing(of("b")), "fb").where("ga = gb")
    turned = F.col("fa") > F.col("fb")
    return held.select(F.least("fa", "fb").alias("file_a"), F.greatest("fa", "fb").alias("file_b"), "n_common", (F.when(turned, -1.0).otherwise(1.0) * F.col("shift") / UNIT).alias("shift"))


def connected(edges: DataFrame, a: str = "file_a", b: str = "file_b", seed: int = 17, max_rounds: int = 200) -> DataFrame:
    """Component label of every vertex that has an edge: (vertex, component).

    Random-mate contraction: each round every vertex tosses a coin; a vertex
    with tails collapses into its smallest neighbour with heads, edges are
    relabelled, loops and repeats vanish.  About a quarter of the vertices go
    in each round.  When no edge is left the labels are unwound from the last
    round to the first.  Every round is a few joins on written tables; neither
    edges nor components come to the driver.  Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.distinct(), "edges")
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if e.isEmpty():
            break
        heads = lambda c: (F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(c)), F.lit(2)) == 1)  # noqa: E731, B023
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = materialize(both.where(~heads("u") & heads("v")).groupBy("u").agg(F.min("v").alias("into")), "contract")
        maps.append(into)
        to = lambda c: into.select(F.col("u").alias(c), F.col("into").alias(f"{c}2"))  # noqa: E731, B023
        moved = e.join(_growing(to("u")), "u", "left").join(_growing(to("v")), "v", "left").select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v")).where("u <> v")
        swap = F.col("u") > F.col("v")
        e = materialize(moved.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("contraction did not end")
    return _unwind(spark, maps, edges.schema[a].dataType.simpleString())


def _unwind(spark: SparkSession, maps: list[DataFrame], kind: str) -> DataFrame:
    labels = spark.createDataFrame([], f"vertex {kind}, component {kind}")
    if not maps:
        return labels
    labels = maps[-1].select(F.col("u").alias("vertex"), F.col("into").alias("component"))
    for m in reversed(maps[:-1]):
        later = labels.select(F.col("vertex").alias("into"), F.col("component").alias("further"))
        mine = m.join(_growing(later), "into", "left").select(F.col("u").alias("vertex"), F.coalesce("further", "into").alias("component"))
        labels = materialize(labels.unionByName(mine), "labels")
    roots = labels.select(F.col("component").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return labels.unionByName(roots)


def split_rows(detections: DataFrame, row_id: str = "det_id", shares: tuple = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 17, partitions: int | None = None) -> DataFrame:
    """Each row with its split: (row id, recording, split).

    ``recording`` names the group: the component of the file key, the key
    itself where it has no other name, or the row itself where it has no key.
    Groups larger than half the smallest share come first (so that one of them
    can't swallow a small split), the others in seeded random order; the
    running weight decides, so shares are met as closely as groups allow.
    """
    named = recording_groups(find_recordings(detections, partitions=partitions), seed)
    rows = detections.select(F.col(row_id).alias(row_id), clean_key("file").alias("file"))
    rows = rows.join(_growing(named.select(F.col("vertex").alias("file"), "component")), "file", "left")
    unit = F.coalesce("component", "file", F.concat(F.lit("row:"), F.col(row_id).cast("string")))
    rows = rows.select(row_id, unit.alias("recording"))
    weights = materialize(rows.groupBy("recording").agg(F.count("*").alias("w")), "weights")
    total = weights.agg(F.sum("w")).first()[0] or 0
    big = F.col("w") * 2 < total * min(s for _, s in shares)
    ordered = weights.withColumns({"big": big, "h": F.xxhash64(F.lit(seed), F.col("recording"))})
    placed = running(ordered, [], ["big", "h", "recording"], {"upto": "w"}, before=True, partitions=partitions, name="cumweight")
    middle = (F.col("upto") + F.col("w") / 2) / F.lit(max(total, 1))
    bound, split = 0.0, F.lit(shares[-1][0])
    bounds = []
    for name, s in shares:
        bound += s
        bounds.append((name, bound))
    for name, top in reversed(bounds[:-1]):
        split = F.when(middle < top, name).otherwise(split)
    return rows.join(_growing(placed.select("recording", split.alias("split"))), "recording").select(row_id, "recording", "split")


