"""Broadcasts only of tables whose size was counted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 200_000  # narrow rows that every task may be sent


def if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most ``rows`` rows, else for a join by sorting; counts the rows."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df.hint("merge")
