"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes a broadcast may hold.
BROADCAST_BYTES = 40_000_000
#: Narrow rows a broadcast may hold; at well under 200 bytes each this stays below 40 MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, row_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast when ``df`` has at most BROADCAST_ROWS rows, else leave a shuffled join.

    With ``row_bytes``, the size of a wide row, the bound is BROADCAST_BYTES instead.

    ``rows`` is a bound the caller can prove (say, a client count given as
    a parameter); without it at most BROADCAST_ROWS + 1 rows are counted.
    """
    most = BROADCAST_ROWS if row_bytes is None else min(BROADCAST_ROWS, BROADCAST_BYTES // max(1, row_bytes))
    if rows is None:
        rows = df.limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df
