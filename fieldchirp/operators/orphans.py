"""Problem 5: references to records that do not exist.

Per key the arrivals and removals of parents and the references to them form
one sequence of events in time.  A reference that finds no valid parent when
it arrives waits as an orphan: ``missing`` while no parent row of the key is
known, ``deleted`` when some had arrived but all were gone, ``late`` when all
arrived after it.  Parents that arrive later resolve what waits, removals
reopen what was resolved.

The state is keyed: parents by row id (a row sent again with its removal
replaces what was known of it) and all references, each with its kind on
arrival and whether it is open now.  It lies in ``BUCKETS`` buckets of the
key.  A batch reads only the buckets of its own keys, judges only its own
keys anew, by one ordered scan over (key, time), and writes these buckets to
a new place; what other buckets hold isn't touched.  So batches may come in
any cut and any order, a key with a third of all rows is spread over many
tasks, and a batch that is run again gives the same state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldchirp.functions.keys import clean_key
from fieldchirp.operators.rangescan import running
from fieldchirp.scratch import fresh_path, materialize

BUCKETS = 16
_PARENT = "src string, key string, parent_id string, at timestamp, gone timestamp, known timestamp"
_REFERENCE = "src string, key string, ref_id long, at timestamp, kind string, open boolean"
_FIRST = "1900-01-01"  # stands for the earliest time


@dataclass
class OrphanState:
    """Where the state lies: a path for every bucket that holds something, written by the last batch that touched it."""

    parents: dict[int, str] = field(default_factory=dict)
    references: dict[int, str] = field(default_factory=dict)


def reference_events(refs: DataFrame, src: str, ref_id: str, key: str, at: str) -> DataFrame:
    """Reference rows (src, key, at, ref_id); rows without a key refer to nothing and are left out, a null time is the earliest."""
    when = F.coalesce(F.col(at).cast("timestamp"), F.lit(_FIRST).cast("timestamp"))
    return refs.select(F.lit(src).alias("src"), clean_key(key).alias("key"), when.alias("at"), F.col(ref_id).cast("long").alias("ref_id")).where("key is not null")


def parent_rows(parents: DataFrame, src: str, parent_id: str | Column | None, key: str, at: str, removed_at: str | None = None) -> DataFrame:
    """Parent rows (src, key, parent_id, at, gone, known): a row replaces what was known of its id, by the latest of its times.

    A parent without arrival time counts as there from the start.  Without
    ``parent_id`` the content is the id, so the same row sent again changes
    nothing, and a removal must come with its row.
    """
    when = F.coalesce(F.col(at).cast("timestamp"), F.lit(_FIRST).cast("timestamp"))
    gone = F.col(removed_at).cast("timestamp") if removed_at else F.lit(None).cast("timestamp")
    k = clean_key(key)
    own = F.col(parent_id) if isinstance(parent_id, str) else parent_id
    own = F.concat_ws("|", when.cast("string"), gone.cast("string")) if own is None else own.cast("string")
    return parents.select(F.lit(src).alias("src"), k.alias("key"), own.alias("parent_id"), when.alias("at"), gone.alias("gone"), F.greatest(when, gone).alias("known")).where("key is not null")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("src", "key"), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, paths: dict[int, str], buckets: list[int], schema: str) -> DataFrame:
    mine = [paths[b] for b in buckets if b in paths]
    return spark.read.schema(schema).parquet(*mine) if mine else spark.createDataFrame([], schema)


def _write(df: DataFrame, name: str, paths: dict[int, str]) -> dict[int, str]:
    """One folder per bucket; the paths of those touched replace the earlier ones."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # Rebalanced, so that a bucket is few files and one with a hot key is several.
    df.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    listed = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = listed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(listed)
    new = {int(n.split("=")[1]): f"{path}/{n}" for n in (f.getPath().getName() for f in files) if n.startswith("bucket=")}
    return paths | new


def _latest(parents: DataFrame) -> DataFrame:
    """One row a parent: what was last known of it (of versions equally late, the one that is gone, then gone first)."""
    last = F.max_by(F.struct("at", "gone"), F.struct(F.col("known"), F.col("gone").isNotNull(), -F.unix_micros(F.coalesce("gone", "at"))))
    return parents.groupBy("src", "key", "parent_id").agg(last.alias("p"), F.max("known").alias("known")).select("src", "key", "parent_id", "p.*", "known")


def _steps(parents: DataFrame) -> DataFrame:
    """Arrivals (+1) and removals (-1), netted by (key, time) before any sort.  A parent removed no later than it arrived is never valid but has arrived."""
    one, minus, zero = (F.lit(v).cast("long") for v in (1, -1, 0))
    steps = F.array(
        F.struct(F.col("at").alias("at"), one.alias("arrived_d"), F.when(F.col("gone") <= F.col("at"), zero).otherwise(one).alias("valid_d")),
        F.when(F.col("gone") > F.col("at"), F.struct(F.col("gone").alias("at"), zero.alias("arrived_d"), minus.alias("valid_d"))),
    )
    events = parents.select("src", "key", F.inline(F.filter(steps, lambda s: s.isNotNull())))
    return events.groupBy("src", "key", "at").agg(F.sum("arrived_d").alias("arrived_d"), F.sum("valid_d").alias("valid_d"))


def _judge(refs: DataFrame, parents: DataFrame, partitions: int | None) -> DataFrame:
    """Kind on arrival (null: a valid parent was there) and whether the reference is open after all events known."""
    steps = _steps(parents)
    zero = F.lit(0).cast("long")
    # Events of the same instant come before references: a parent received then is in time, one removed then is gone.
    events = steps.select("src", "key", "at", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("ref_id"), "arrived_d", "valid_d")
    events = events.unionByName(refs.select("src", "key", "at", F.lit(1).alias("rank"), "ref_id", zero.alias("arrived_d"), zero.alias("valid_d")))
    seen = running(events, ["src", "key"], ["at", "rank", "ref_id"], {"arrived": "arrived_d", "valid": "valid_d"}, partitions=partitions, name="orphans")
    now = steps.groupBy("src", "key").agg(F.sum("valid_d").alias("valid_now"))
    known = F.col("valid_now").isNotNull()
    kind = F.when(F.col("valid") <= 0, F.when(F.col("arrived") > 0, "deleted").when(known, "late").otherwise("missing"))
    judged = seen.where(F.col("ref_id").isNotNull()).join(now, ["src", "key"], "left")
    return judged.select("src", "key", "ref_id", "at", kind.alias("kind"), (F.coalesce("valid_now", F.lit(0)) <= 0).alias("open"))


def process_batch(state: OrphanState, refs: DataFrame | None, parents: DataFrame | None, partitions: int | None = None) -> tuple[DataFrame, OrphanState]:
    """One incremental step: (src, key, at, ref_id) references and parent rows in; what changed and the new state out.

    Changes: (src, key, ref_id, at, kind, open, was_open), a row for each
    reference that is new or whose kind or openness the batch changed:
    resolved ones have ``was_open`` true and ``open`` false, reopened ones the
    other way round, new ones null.  References sent again under the same id
    count once.  An empty batch changes nothing.
    """
    some = refs if refs is not None else parents
    if some is None:
        raise ValueError("nothing to process")
    spark = some.sparkSession
    refs = refs.select("src", "key", "ref_id", "at") if refs is not None else spark.createDataFrame([], "src string, key string, ref_id long, at timestamp")
    parents = parents if parents is not None else spark.createDataFrame([], _PARENT)
    if not state.parents and not state.references:
        old_parents, old_refs = (spark.createDataFrame([], schema) for schema in (_PARENT, _REFERENCE))
        keys = None
    else:
        keys = materialize(refs.select("src", "key").unionByName(parents.select("src", "key")).distinct(), "batch-keys")
        buckets = sorted(r[0] for r in keys.select(_bucket().alias("b")).distinct().collect())  # at most BUCKETS
        old_parents, old_refs = _read(spark, state.parents, buckets, _PARENT), _read(spark, state.references, buckets, _REFERENCE)
    mine = lambda df: df if keys is None else df.join(keys, ["src", "key"], "left_semi")
    with_others = lambda new, old: new if keys is None else new.unionByName(old.join(keys, ["src", "key"], "left_anti"))

    now_parents = _latest(mine(old_parents).unionByName(parents))
    next_parents = _write(with_others(now_parents, old_parents), "state-parents", state.parents)
    if keys is None:
        now_parents = _read(spark, next_parents, sorted(next_parents), _PARENT)
    before = mine(old_refs)
    both = before.select("src", "key", "ref_id", "at").unionByName(refs)
    judged = _judge(both.groupBy("src", "key", "ref_id").agg(F.min("at").alias("at")), now_parents, partitions)
    next_state = OrphanState(next_parents, _write(with_others(judged, old_refs), "state-references", state.references))
    touched = sorted(b for b, p in next_state.references.items() if state.references.get(b) != p)
    judged = mine(_read(spark, next_state.references, touched, _REFERENCE))
    was = before.select("src", "key", "ref_id", F.col("kind").alias("was_kind"), F.col("open").alias("was_open"), F.lit(True).alias("known"))
    changed = judged.join(was, ["src", "key", "ref_id"], "left").where(F.col("known").isNull() | ~F.col("kind").eqNullSafe(F.col("was_kind")) | (F.col("open") != F.col("was_open")))
    return changed.select("src", "key", "ref_id", "at", "kind", "open", "was_open"), next_state


def _all_references(spark: SparkSession, state: OrphanState) -> DataFrame:
    return _read(spark, state.references, sorted(state.references), _REFERENCE)


def orphans_on_arrival(spark: SparkSession, state: OrphanState) -> DataFrame:
    """References that found no valid parent when they arrived: (src, key, ref_id, at, orphan_kind)."""
    return _all_references(spark, state).where("kind is not null").select("src", "key", "ref_id", "at", F.col("kind").alias("orphan_kind"))


def open_orphans(spark: SparkSession, state: OrphanState) -> DataFrame:
    """References that dangle now, whatever was valid when they arrived: resolved ones are gone, reopened ones back."""
    return _all_references(spark, state).where("open").select("src", "key", "ref_id", "at", "kind")


def find_orphans(relations: list[tuple], partitions: int | None = None, batches: int = 1) -> DataFrame:
    """Orphans of several tables: (src, key, ref_id, at, orphan_kind), kinds as on arrival.

    ``relations``: (src, refs, ref_id, ref_key, ref_at, parents, parent_id,
    parent_key, parent_at, parent_removed).  A null reference time is taken as
    the earliest.  Rows sent twice are judged each for itself.  Empty tables
    give an empty result (all missing, if only the parents are empty).

    With ``batches`` above one the tables are fed in slices of time: rows when
    they arrive, a removal as a second version of its row when it happens.
    """
    refs = parents = None
    for src, r, ref_id, ref_key, ref_at, p, parent_id, p_key, p_at, p_gone in relations:
        re, pe = reference_events(r, src, ref_id, ref_key, ref_at), parent_rows(p, src, parent_id, p_key, p_at, p_gone)
        refs = re if refs is None else refs.unionByName(re)
        parents = pe if parents is None else parents.unionByName(pe)
    spark = refs.sparkSession
    state = OrphanState()
    if batches == 1:
        _, state = process_batch(state, refs, parents, partitions)
        return orphans_on_arrival(spark, state)
    span = refs.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    first, last = (span[0] or 0), (span[1] or 0)
    cuts = [first + (last - first) * i // batches for i in range(1, batches)]
    arrived = parents.select("src", "key", "parent_id", "at", F.lit(None).cast("timestamp").alias("gone"), F.col("at").alias("known"))
    removed = parents.where("gone is not null")
    told = arrived.unionByName(removed)
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        within = lambda c: F.lit(True) & (F.lit(True) if lo is None else F.unix_micros(c) >= lo) & (F.lit(True) if hi is None else F.unix_micros(c) < hi)  # noqa: E731, B023
        _, state = process_batch(state, refs.where(within("at")), told.where(within("known")), partitions)
    return orphans_on_arrival(spark, state)


def snapshot_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference and kind."""
    month = F.date_format("at", "yyyy-MM")
    return orphans.groupBy(F.col("src").alias("src_table"), month.alias("month"), "orphan_kind").agg(F.count("*").alias("n_orphans"))
