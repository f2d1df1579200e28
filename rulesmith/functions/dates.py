"""Times from text, and times as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The time of a text yyyy-MM-dd or ISO 8601; null for any other text."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), text.try_cast("timestamp"))


def millis(time: Column) -> Column:
    """Milliseconds from 1970 to a time as its calendar and clock show it, whatever the session's zone; what is under one is cut off."""
    clock = F.hour(time) * 3600 + F.minute(time) * 60
    seconds = F.date_diff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + clock
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), time) * 1000).cast("long")
