"""Time helpers. The clock is always a parameter, never the wall clock."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(now: str | datetime.datetime, hours_back: float = 0) -> Column:
    """Literal UTC instant ``hours_back`` hours before ``now``."""
    at = datetime.datetime.fromisoformat(now) if isinstance(now, str) else now
    at -= datetime.timedelta(hours=hours_back)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 (UTC session)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(col.cast("timestamp"))


def normalise_end(column: str | Column) -> Column:
    """Extend a date-only end (10 characters) to the end of that day."""
    col = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(col) == 10, F.concat(col, F.lit("T23:59:59"))).otherwise(col)
