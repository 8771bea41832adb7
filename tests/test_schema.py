import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from moraine.functions.schema import SIMPLE, SchemaConflict, TableSchema, spark_type, type_name


def test_accumulate_and_conflict():
    s = TableSchema()
    assert s.accumulate(["col_a", "col_b"], ["VARCHAR", "BIGINT"])
    assert not s.accumulate(["col_b", "col_c"], ["BIGINT", "DOUBLE"])
    with pytest.raises(SchemaConflict) as e:
        s.accumulate(["col_b"], ["VARCHAR"])
    assert (e.value.column, e.value.current, e.value.new) == ("col_b", "BIGINT", "VARCHAR")
    assert s.columns() == ["col_a", "col_b", "col_c"] and "col_c" in s and s["col_a"] == "VARCHAR"
    assert TableSchema.from_json(s.to_json()) == s


@pytest.mark.parametrize("name", ["STRUCT(k BIGINT, m STRUCT(z VARCHAR))", "STRUCT(a BIGINT)[]", "VARCHAR[]", "DECIMAL(3,2)", "MAP(VARCHAR, BIGINT[])", 'STRUCT("a ""b" BIGINT)', "TIMESTAMP WITH TIME ZONE", "INTERVAL"])
def test_names_round_trip(name):
    assert type_name(spark_type(name)) == name


def test_unknown_types():
    for bad in ("TIME", "BIGINT junk", "STRUCT(a)"):
        with pytest.raises(ValueError):
            spark_type(bad)
    assert spark_type("HUGEINT") == T.DoubleType()


types = st.recursive(
    st.sampled_from([t for t in SIMPLE.values()]),
    lambda t: st.one_of(t.map(T.ArrayType), st.dictionaries(st.text("abcXY z\"", min_size=1, max_size=5), t, min_size=1, max_size=3).map(lambda d: T.StructType([T.StructField(k, v) for k, v in d.items()]))),
    max_leaves=6,
)


@settings(deadline=None, max_examples=100)
@given(types)
def test_any_type_round_trips(t):
    assert spark_type(type_name(t)) == t


def test_void_is_left_out():
    assert TableSchema.of(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.NullType())])).pairs() == [("a", "BIGINT")]
