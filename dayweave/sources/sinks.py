"""Writers for stage tables, results and exported slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.operators.calendar import subset_period


def write_stage(df: DataFrame, path: str, by: Sequence[str] = ("entity",), mode: str = "overwrite") -> None:
    """Stage table as Parquet, partitioned by entity (or another coarse column)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as CSV with a header."""
    df.write.mode(mode).option("header", "true").csv(path)


def export_slice(df: DataFrame, start, end, columns: Sequence[str], day: str = "day") -> DataFrame:
    """Closed date range and a column list; days without any value are left out."""
    out = subset_period(df, start, end, day).select(day, *columns)
    known = F.lit(False)
    for c in columns:
        known = known | F.col(c).isNotNull()
    return out.where(known)
