"""SQL over tables by name: views with the partition as a column, and table functions with named arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.table import MergeTable


def partitioned_view(table: MergeTable, name: str, as_of_ms: int | None = None) -> DataFrame:
    """A temporary view of a snapshot with two more columns: `partition_path`, and `file_path`."""
    df = table.read(as_of_ms)
    if not df.inputFiles():
        df = df.withColumn("file_path", F.lit(None).cast("string"))
    else:
        df = df.withColumn("file_path", F.col("_metadata.file_path"))
    df = df.withColumn("partition_path", F.regexp_extract(F.url_decode(F.regexp_replace("file_path", r"\+", "%2B")), r"_data/(.*)/[^/]+$", 1))
    df.createOrReplaceTempView(name)
    return df


def table_function(table: MergeTable, name: str) -> None:
    """`SELECT * FROM name(first => 'd=2024-01', last => 'd=2024-02')`: rows of a range of partitions, both ends included, all by default."""
    view = f"{name}_rows"
    df = partitioned_view(table, view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    table.spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(first STRING DEFAULT '', last STRING DEFAULT '\U0010ffff')
        RETURNS TABLE({columns}) RETURN SELECT * FROM {view} WHERE partition_path >= first AND partition_path <= last""")


__all__ = ["partitioned_view", "table_function"]
