"""Ordered scans over groups of any size.

A window function puts a whole group into one task, so one long file or one
large source decides the run time.  Here the rows are *range*-partitioned on
(group, order): a large group is spread over as many partitions as it needs.
Each partition folds its own rows in order and leaves one summary; the driver
chains the summaries (one per range partition, so their number is bounded by
the number of partitions, never by the data), and what a partition needs to
know of the partitions before it comes back as a broadcast table of the same
bounded size.

Only the first group of a partition can have begun in an earlier one, so the
carried values touch just the rows marked ``__head``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldchirp.scratch import fresh_path
from fieldchirp.session import shuffle_partitions

PID, HEAD = "__pid", "__head"


@dataclass
class Sorted:
    """Rows as written by the ordered pass, and its summaries by partition."""

    rows: DataFrame
    summaries: list[dict]


def group_starts(columns: list[pa.Array | pa.ChunkedArray], before: tuple | None) -> np.ndarray:
    """True where a row's group differs from that of the row before it."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for k, column in enumerate(columns):
        v = column.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
        new[0] |= before is None or v[0] != before[k]
    return new


def ordered_pass(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    fold: Callable[[Iterator[pa.Table]], Iterator[pa.Table | dict]],
    schema: T.StructType,
    partitions: int | None = None,
    name: str = "scan",
) -> Sorted:
    """Sort ``df`` globally, fold each partition, and keep rows and summaries.

    ``fold`` gets the partition's batches in order and yields tables of
    ``schema`` (which must hold ``__pid`` and ``__head``) and at the end one
    dict, the summary, or none if the partition is empty.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    keys = [F.col(g).asc() for g in group] + [F.col(o).asc() if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # The summary row leaves the other columns null.
    full = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("__summary", T.StringType())])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()

        def tables():
            for b in batches:
                if b.num_rows:
                    yield pa.Table.from_batches([b])

        for out in fold(tables()):
            if isinstance(out, dict):
                row = {f.name: [None] for f in full.fields} | {"__summary": [json.dumps(out | {PID: pid})]}
                yield from pa.table(row, schema=arrow).to_batches()
            elif out.num_rows:
                out = out.append_column(PID, pa.array(np.full(out.num_rows, pid, dtype=np.int32)))
                cols = [out[f.name].cast(arrow.field(f.name).type) for f in schema.fields]
                yield from pa.Table.from_arrays([*cols, pa.nulls(out.num_rows, pa.string())], schema=arrow).to_batches()

    path = fresh_path(spark, name)
    marked = ranged.mapInArrow(run, full).withColumn("__kind", F.col("__summary").isNotNull().cast("int"))
    marked.write.partitionBy("__kind").parquet(path)
    back = spark.read.schema(T.StructType([*full.fields, T.StructField("__kind", T.IntegerType())])).parquet(path)
    # One summary per range partition: at most n rows reach the driver.
    summaries = [json.loads(r[0]) for r in back.where("__kind = 1").select("__summary").collect()]
    return Sorted(back.where("__kind = 0").drop("__kind", "__summary"), sorted(summaries, key=lambda s: s[PID]))


def with_carry(scan: Sorted, carries: list[tuple], schema: str) -> DataFrame:
    """Join what earlier partitions leave behind: one row per range partition.

    ``carries`` holds (pid, value, ...) and is bounded by the number of range
    partitions, which is why broadcasting it is safe at any input size.
    """
    spark = scan.rows.sparkSession
    side = spark.createDataFrame(carries, f"{PID} int, {schema}")
    return scan.rows.join(F.broadcast(side), PID, "left")


def running(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    sums: dict[str, str],
    before: bool = False,
    keep_below: tuple[str, int] | None = None,
    partitions: int | None = None,
    name: str = "running",
) -> DataFrame:
    """Running sums of integer columns within each group, in the given order.

    ``sums`` maps the new column to the column summed (nulls count as 0);
    ``before`` leaves the row itself out.  Integer addition is associative, so
    the result doesn't depend on the partitioning.  ``keep_below=(new, n)``
    drops rows whose running value exceeds n already within their partition;
    as values never fall (the caller vouches that they are not negative), such
    rows exceed n globally too, and sums clipped at n still place the others
    exactly.
    """
    out = [*sums]
    schema = T.StructType(
        [*df.schema.fields, *(T.StructField(c, T.LongType()) for c in out), T.StructField(HEAD, T.BooleanType()), T.StructField(PID, T.IntegerType())]
    )
    names = df.columns

    def fold(tables: Iterator[pa.Table]) -> Iterator[pa.Table | dict]:
        first: tuple | None = None
        last: tuple | None = None
        total = dict.fromkeys(out, 0)
        for t in tables:
            if first is None:
                first = tuple(t[g][0].as_py() for g in group)
            new = group_starts([t[g] for g in group], last) if group else np.zeros(t.num_rows, dtype=bool)
            begins = np.flatnonzero(new)
            seg = np.cumsum(new) - 1
            cols = {}
            for c in out:
                v = pc.fill_null(t[sums[c]].cast(pa.int64()), 0).to_numpy()
                run = np.cumsum(v)
                # What the running sum holds when the row's group begins; rows of a group begun earlier go on from its total.
                base = np.append(run[begins] - v[begins], -total[c])[seg]
                run = run - base
                total[c] = int(run[-1])
                cols[c] = run - v if before else run
            head = np.ones(t.num_rows, dtype=bool)
            for g, value in zip(group, first, strict=True):
                head &= t[g].to_numpy(zero_copy_only=False) == value
            last = tuple(t[g][-1].as_py() for g in group)
            t = t.select(names)
            for c in out:
                t = t.append_column(c, pa.array(cols[c]))
            t = t.append_column(HEAD, pa.array(head))
            yield t.filter(pa.array(cols[keep_below[0]] <= keep_below[1])) if keep_below else t
        if first is not None:
            yield {"first": list(first), "last": list(last), "total": total}

    scan = ordered_pass(df, group, order, fold, schema, partitions, name)
    carries, open_group, sofar = [], None, dict.fromkeys(out, 0)
    for s in scan.summaries:
        joined = s["first"] == open_group
        if joined:
            carries.append((s[PID], *sofar.values()))
        goes_on = joined and s["last"] == open_group
        sofar = {c: (sofar[c] if goes_on else 0) + s["total"][c] for c in out}
        open_group = s["last"]
    joined = with_carry(scan, carries, ", ".join(f"__c_{c} long" for c in out))
    done = joined.withColumns({c: F.col(c) + F.when(F.col(HEAD), F.coalesce(F.col(f"__c_{c}"), F.lit(0))).otherwise(0) for c in out})
    if keep_below:
        done = done.where(F.col(keep_below[0]) <= keep_below[1])
    return done.select(*names, *out)


__all__ = ["HEAD", "PID", "Sorted", "group_starts", "ordered_pass", "running", "with_carry"]
