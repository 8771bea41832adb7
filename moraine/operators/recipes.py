"""Merge queries that give a table a meaning of its own, each with the query that finishes the job on reading.

Merges fold some files of a partition together and never promise one row a key, so readers always finish.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.expressions import any_value, arg_max

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Recipe:
    """merge: for MergeTable(merge_query=); finish: for what read() gives; insert: for MergeTable(insert_query=), if the table needs one."""

    merge: Step
    finish: Step
    insert: Step | None = None


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "any": any_value}


def aggregating(keys: list[str], folds: Mapping[str, str], count: str | None = None) -> Recipe:
    """One row for each key: folds names sum, max, min or any for each other column. count: a column seeded with 1 and summed."""
    folds = dict(folds) | ({count: "sum"} if count else {})

    def run(df: DataFrame) -> DataFrame:
        out = df.groupBy(*keys).agg(*[_FOLDS[f](c).alias(c) for c, f in folds.items()])
        # Sums of whole numbers stay whole numbers of the same type.
        return out.select(*keys, *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in folds])

    return Recipe(run, run, (lambda df: df.withColumn(count, F.lit(1).cast("bigint"))) if count else None)


def replacing(keys: list[str], by: str) -> Recipe:
    """The newest value of each column for each key."""

    def run(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c != by]
        return df.groupBy(*keys).agg(F.max(by).alias(by), *[arg_max(c, by).alias(c) for c in rest]).select(*df.columns)

    return Recipe(run, run)


def deduplicating(keys: list[str]) -> Recipe:
    """One row for each key; rows with equal keys are taken to be equal."""

    def run(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(*[any_value(c).alias(c) for c in rest]).select(*df.columns) if rest else df.distinct()

    return Recipe(run, run)
