"""How rows find their partition: Hive-style columns, an opaque string, or a Python function of a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that carries a row's partition while it is written.
PART = "__partition"
#: Row key that names a partition directly.
GIVEN = "_partition"
#: Characters that Hive-style folder names spell as %XX.
ESCAPED = "%\"#'*/:=?\\{}[]^"


def escape(value: Column) -> Column:
    """A value as part of a `key=value` folder name."""
    out = value
    for c in ESCAPED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(F.when(out == "", None).otherwise(out), F.lit("__HIVE_DEFAULT_PARTITION__"))


def from_folder(name: str) -> str:
    """The partition string in a folder name that Spark's writer made of it."""
    return unquote(name.split("=", 1)[1])


class Partitioning:
    """spec: a mapping name -> Column or SQL text (Hive style), a Column or SQL text (an opaque string), or a function dict -> str (slow)."""

    def __init__(self, spec: Mapping[str, Column | str] | Column | str | Callable[[dict], str], types: Mapping[str, T.DataType | str] | None = None):
        self.spec = spec
        #: Types that partition columns have when read; text unless named.
        self.types = dict(types or {})

    @property
    def hive(self) -> bool:
        return isinstance(self.spec, Mapping)

    def column(self, df: DataFrame) -> Column:
        if isinstance(self.spec, Mapping):
            parts = [F.concat(F.lit(f"{k}="), escape((F.expr(v) if isinstance(v, str) else v).cast("string"))) for k, v in self.spec.items()]
            out = F.concat_ws("/", *parts)
        elif isinstance(self.spec, Column):
            out = self.spec.cast("string")
        elif isinstance(self.spec, str):
            out = F.expr(self.spec).cast("string")
        else:
            out = self._function(df)
        return F.coalesce(F.col(f"`{GIVEN}`"), out) if GIVEN in df.columns else out

    def _function(self, df: DataFrame) -> Column:
        fn = self.spec

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for r in rows:
                yield pd.Series([fn(x) for x in r.to_dict("records")], dtype="object")

        run.__annotations__ = {"rows": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string")(F.struct(*[F.col(f"`{c}`") for c in df.columns]))

    def read_schema(self) -> T.StructType:
        kinds = {k: self.types.get(k, T.StringType()) for k in (self.spec if self.hive else ())}
        return T.StructType([T.StructField(k, T._parse_datatype_string(t) if isinstance(t, str) else t) for k, t in kinds.items()])
