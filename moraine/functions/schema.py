"""Schemas of tables: column names with type names as the log spells them, and what they are in Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import types as T


class SchemaConflict(ValueError):
    """A column came with another type than it has."""

    def __init__(self, column: str, current: str, new: str):
        super().__init__(f"column {column!r} is {current}, not {new}")
        self.column, self.current, self.new = column, current, new


#: Type names of the log and their Spark types.
SIMPLE = {
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "BLOB": T.BinaryType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
    "INTERVAL": T.DayTimeIntervalType(),
}
_NAMES = {type(t): n for n, t in SIMPLE.items()}
#: Other spellings, read but never written.
ALIASES = {"HUGEINT": "DOUBLE", "INT8": "BIGINT", "INT4": "INTEGER", "INT": "INTEGER", "TEXT": "VARCHAR", "STRING": "VARCHAR", "JSON": "VARCHAR", "UTINYINT": "SMALLINT", "USMALLINT": "INTEGER", "UINTEGER": "BIGINT", "REAL": "FLOAT", "BOOL": "BOOLEAN", "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE"}


def type_name(t: T.DataType) -> str:
    """The log's name of a Spark type."""
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return f"{type_name(t.elementType)}[]"
    if isinstance(t, T.MapType):
        return f"MAP({type_name(t.keyType)}, {type_name(t.valueType)})"
    if isinstance(t, T.StructType):
        return "STRUCT(" + ", ".join(f"{_quoted(f.name)} {type_name(f.dataType)}" for f in t.fields) + ")"
    if isinstance(t, T.NullType):
        return '"NULL"'
    if isinstance(t, (T.CharType, T.VarcharType)):
        return "VARCHAR"
    if type(t) in _NAMES:
        return _NAMES[type(t)]
    raise TypeError(f"{t.simpleString()} cannot be stored")


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


class _Reader:
    """Recursive descent over one type name."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def eat(self, pattern: str) -> str | None:
        m = re.compile(rf"\s*({pattern})", re.IGNORECASE).match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[1]
        return None

    def need(self, pattern: str) -> str:
        got = self.eat(pattern)
        if got is None:
            raise ValueError(f"unknown type {self.text!r} at {self.at}")
        return got

    def type(self) -> T.DataType:
        if self.eat(r"STRUCT\s*\("):
            fields = []
            while not self.eat(r"\)"):
                self.eat(",")
                name = self.need(r'"(?:[^"]|"")*"|[^\s",()]+')
                name = name[1:-1].replace('""', '"') if name[0] == '"' else name
                fields.append(T.StructField(name, self.type()))
            out: T.DataType = T.StructType(fields)
        elif self.eat(r"MAP\s*\("):
            key = self.type()
            self.need(",")
            out = T.MapType(key, self.type())
            self.need(r"\)")
        elif self.eat(r"(?:DECIMAL|NUMERIC)\s*\("):
            p = int(self.need(r"\d+"))
            s = int(self.need(r"\d+")) if self.eat(",") else 0
            self.need(r"\)")
            out = T.DecimalType(p, s)
        elif self.eat('"NULL"'):
            out = T.NullType()
        else:
            word = (self.eat("TIMESTAMP WITH TIME ZONE") or self.need(r"\w+")).upper()
            word = ALIASES.get(word, word)
            if word == "DECIMAL":
                out = T.DecimalType(18, 3)
            elif word in SIMPLE:
                out = SIMPLE[word]
            else:
                raise ValueError(f"unknown type {word!r} in {self.text!r}")
        while self.eat(r"\[\d*\]"):
            out = T.ArrayType(out)
        return out


def spark_type(name: str) -> T.DataType:
    """The Spark type of the log's type name."""
    r = _Reader(name)
    out = r.type()
    if r.text[r.at :].strip():
        raise ValueError(f"unknown type {name!r}")
    return out


class TableSchema:
    """Columns in order of appearance. Columns are added and never removed; all may be null."""

    def __init__(self, columns: dict[str, str] | None = None):
        self.columns_and_types = dict(columns or {})

    @classmethod
    def of(cls, schema: T.StructType) -> TableSchema:
        """Of a DataFrame; columns that never had a value (void) are left out, as any type may follow."""
        return cls({f.name: type_name(f.dataType) for f in schema.fields if not isinstance(f.dataType, T.NullType)})

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        return cls(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.columns_and_types)

    def accumulate(self, columns: Iterable[str], types: Iterable[str]) -> bool:
        """Adds columns; False if any was known before. Another type for a known column is a SchemaConflict."""
        known = False
        for c, t in zip(columns, types, strict=True):
            known |= c in self.columns_and_types
            have = self.columns_and_types.setdefault(c, t)
            if have != t:
                raise SchemaConflict(c, have, t)
        return not known

    def add(self, other: TableSchema) -> TableSchema:
        self.accumulate(other.columns(), other.types())
        return self

    def columns(self) -> list[str]:
        return list(self.columns_and_types)

    def types(self) -> list[str]:
        return list(self.columns_and_types.values())

    def pairs(self) -> list[tuple[str, str]]:
        return list(self.columns_and_types.items())

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, spark_type(t)) for c, t in self.pairs()])

    def __contains__(self, column: str) -> bool:
        return column in self.columns_and_types

    def __getitem__(self, column: str) -> str:
        return self.columns_and_types[column]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TableSchema) and self.pairs() == other.pairs()

    def __repr__(self) -> str:
        return f"TableSchema({self.columns_and_types})"
