"""User queries over a hidden view: SQL text that names the view, or a function of a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame

Query = str | Callable[[DataFrame], DataFrame]

#: Plan nodes that treat each row by itself.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRDD", "LocalRelation", "Relation", "LogicalRelation", "Sort", "Range", "OneRowRelation", "RepartitionByExpression", "LogicalQueryStage", "UnresolvedHint", "ResolvedHint"}
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|\w+|\s+|.", re.DOTALL)


def rename_view(sql: str, old: str, new: str) -> str:
    """sql with the word `old` replaced where it is a word of its own, outside of strings, comments and quoted names."""
    return "".join(new if t == old else t for t in _TOKEN.findall(sql))


@contextmanager
def view(df: DataFrame):
    """A temporary view under a name that nobody else has."""
    name = f"v_{uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def apply(query: Query | None, df: DataFrame, name: str) -> DataFrame:
    """The query over df, which SQL text calls `name`."""
    if query is None:
        return df
    if callable(query):
        return query(df)
    with view(df) as v:
        return df.sparkSession.sql(rename_view(query, name, v))


def row_wise(df: DataFrame) -> bool:
    """Whether a query's result can be computed a row at a time, so that it does not matter which rows are put in together."""
    plan = df._jdf.queryExecution().analyzed()
    nodes, text = [plan], plan.toString()
    while nodes:
        node = nodes.pop()
        if node.nodeName().split(" ")[0] not in _ROWWISE:
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return not re.search(r"uuid\(|rand\(|monotonically|scalar-subquery|exists#|list#", text)
