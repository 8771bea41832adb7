"""Where results go other than into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_text(df: DataFrame, rows: int = 1000) -> str:
    """A table for reading; a last line says so if there are more rows."""
    return df._jdf.showString(rows, 0, False)


def to_csv(df: DataFrame, rows: int = 1_000_000) -> str:
    """CSV text of a small result; one of more than `rows` rows raises ValueError, as it is for `df.write.csv`."""
    found = df.limit(rows + 1).toPandas()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    return found.to_csv(index=False)


def to_nothing(df: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
