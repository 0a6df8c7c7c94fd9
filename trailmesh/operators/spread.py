"""Shuffles whose tasks grow in number with the rows, not in size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task sorts or groups, about.
ROWS = 1_000_000


def spread(df: DataFrame, keys: list[str], counted: DataFrame | int | None = None, rows: int = ROWS) -> DataFrame:
    """df dealt out by its keys to a task for every ``rows`` rows; later groupings, windows and joins by these keys stay in place.

    ``counted`` is a table of as many rows that is cheaper to count, such as the file that df is read from, or their number.
    """
    spark = df.sparkSession
    n = -(-(counted if isinstance(counted, int) else (df if counted is None else counted).count()) // rows)
    return df.repartition(max(n, 2 * spark.sparkContext.defaultParallelism), *keys)
