"""Problem 7: overlapping, nested and gapped intervals per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldchirp.functions.keys import clean_key
from fieldchirp.operators.rangescan import HEAD, PID, ordered_pass, with_carry

_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("from_ms", T.LongType()),
        T.StructField("to_ms", T.LongType()),
        T.StructField("prev_to", T.LongType()),
        T.StructField(HEAD, T.BooleanType()),
        T.StructField(PID, T.IntegerType()),
    ]
)


def _local_islands(tables: Iterator[pa.Table]) -> Iterator[pa.Table | dict]:
    """Merge the sorted intervals of one partition into islands.

    A row whose start is beyond the running maximum of the ends before it (of
    its entity) begins an island.  The last island stays open from batch to
    batch, as if it were the first row of the next one.
    """
    first = held = None
    for t in tables:
        rows = pd.DataFrame({"entity": t["entity"].to_numpy(zero_copy_only=False), "from_ms": t["from_ms"].to_numpy(), "to_ms": t["to_ms"].to_numpy()})
        if first is None:
            first = rows.entity[0]
        known = 0
        if held is not None:
            rows = pd.concat([held[["entity", "from_ms", "to_ms"]], rows], ignore_index=True)
            known = 1
        new = (rows.entity != rows.entity.shift()).to_numpy()
        far = rows.groupby(np.cumsum(new)).to_ms.cummax()
        prev = far.shift().astype("Int64").mask(new)
        begins = new | (rows.from_ms > prev).fillna(True).to_numpy()
        at = np.flatnonzero(begins)
        isl = rows.iloc[at].reset_index(drop=True)
        isl["to_ms"] = far.to_numpy()[np.append(at[1:], len(rows)) - 1]
        isl["prev_to"] = prev.iloc[at].array
        if known:
            isl.loc[0, "prev_to"] = held.prev_to[0]
        held = isl.iloc[-1:].reset_index(drop=True)
        if len(isl) > 1:
            yield _islands(isl.iloc[:-1], first)
    if held is not None:
        yield _islands(held, first)
        yield {"first": first, "last": held.entity[0], "from": int(held.from_ms[0]), "to": int(held.to_ms[0])}


def _islands(isl: pd.DataFrame, first: str) -> pa.Table:
    return pa.table(
        {
            "entity": pa.array(isl.entity, pa.string()),
            "from_ms": pa.array(isl.from_ms, pa.int64()),
            "to_ms": pa.array(isl.to_ms, pa.int64()),
            "prev_to": pa.array(isl.prev_to, pa.int64(), from_pandas=True),
            HEAD: pa.array((isl.entity == first).to_numpy()),
        }
    )


def to_millis(seconds) -> F.Column:
    """Seconds to the nearest millisecond; NaN and null give null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(~F.isnan(c), F.round(c * 1000.0).cast("long"))


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Continuous periods per entity and the gaps between them.

    ``start`` and ``end`` are integers (e.g. milliseconds).  Rows without
    entity, start or end, or whose end isn't after the start, count for
    nothing; intervals that overlap or touch join.  Repeated rows change
    nothing; other columns of ``df`` are ignored, whatever their names.  An
    empty table gives an empty result.

    Columns: entity, span_kind (``period`` or ``gap``), from_ms, to_ms.
    """
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("from_ms"), F.col(end).cast("long").alias("to_ms")).where(
        "entity is not null and from_ms is not null and to_ms > from_ms"
    )
    # Of intervals that begin together the longest says all: repeats are gone before the sort, so any number of them can be split.
    rows = rows.groupBy("entity", "from_ms").agg(F.max("to_ms").alias("to_ms"))
    scan = ordered_pass(rows, ["entity"], ["from_ms", "to_ms"], _local_islands, _SCHEMA, partitions, "intervals")
    # Chain: what the entity that begins a partition has behind it (its furthest end, and where that island began).
    carries, open_entity, far, anchor = [], None, None, None
    for c in scan.summaries:
        joined = c["first"] == open_entity
        if joined:
            carries.append((c[PID], far, anchor))
        if joined and c["last"] == open_entity:
            # One entity throughout: its last island is a new one only if it begins beyond all that came before.
            far, anchor = (c["to"], c["from"]) if c["from"] > far else (max(far, c["to"]), anchor)
        else:
            open_entity, far, anchor = c["last"], c["to"], c["from"]
    isl = with_carry(scan, carries, "__far long, __anchor long")
    prev = F.when(F.col(HEAD), F.greatest("prev_to", "__far")).otherwise(F.col("prev_to"))
    isl = isl.withColumn("prev", prev).withColumn("attached", F.coalesce(F.col("from_ms") <= F.col("prev"), F.lit(False)))
    # An attached island extends the one the carry names.  (entity, from) is unique but for those, so nothing is skewed.
    periods = (
        isl.groupBy("entity", F.when(F.col("attached"), F.col("__anchor")).otherwise(F.col("from_ms")).alias("from_ms"))
        .agg(F.max("to_ms").alias("to_ms"))
        .select("entity", F.lit("period").alias("span_kind"), "from_ms", "to_ms")
    )
    gaps = isl.where(~F.col("attached") & F.col("prev").isNotNull()).select(
        "entity", F.lit("gap").alias("span_kind"), F.col("prev").alias("from_ms"), F.col("from_ms").alias("to_ms")
    )
    return periods.unionByName(gaps)


def annotation_spans(annotations: DataFrame, partitions: int | None = None) -> DataFrame:
    """Periods and gaps per recording over all labels of an annotation table."""
    rows = annotations.select(clean_key("audio_file").alias("audio_file"), to_millis("start_time").alias("s"), to_millis("end_time").alias("e"))
    return merge_intervals(rows, "audio_file", "s", "e", partitions).withColumnRenamed("entity", "audio_file")
