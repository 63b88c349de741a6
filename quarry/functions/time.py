"""Timestamp literals matching the tables' TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(text: str) -> Column:
    """A TIMESTAMP_NTZ literal (no session time-zone shift), so comparisons
    with the tables' columns stay un-cast and are pushed to the scan."""
    return F.lit(text).cast("timestamp_ntz")
