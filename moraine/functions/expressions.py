"""Functions that queries over tables use, with the results users of in-process SQL engines expect of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_text(c: Column | str, key: str) -> Column:
    """Text of a key of JSON kept as a string (or of to_json(struct)); null if it is missing."""
    return F.get_json_object(_col(c), f"$.{key}")


def json_int(c: Column | str, key: str, default: int | None = None) -> Column:
    """Whole number of a key; `default` if missing or no number."""
    out = json_text(c, key).try_cast("bigint")
    return out if default is None else F.coalesce(out, F.lit(default).cast("bigint"))


def to_bigint(c: Column | str) -> Column:
    """Rounds half to even, where a plain cast would cut off."""
    return F.bround(_col(c)).cast("bigint")


def arg_max(value: Column | str, by: Column | str) -> Column:
    """The value at the largest `by`; rows whose value is null do not count."""
    return F.max_by(_col(value), F.when(_col(value).isNotNull(), _col(by)))


def arg_min(value: Column | str, by: Column | str) -> Column:
    return F.min_by(_col(value), F.when(_col(value).isNotNull(), _col(by)))


def any_value(c: Column | str) -> Column:
    """Some value that is not null."""
    return F.any_value(_col(c), F.lit(True))


def median(c: Column | str) -> Column:
    """Exact; an even number of values gives the mean of the middle two."""
    return F.percentile(_col(c), F.lit(0.5))


def uniq(c: Column | str) -> Column:
    """Approximate number of distinct values, in bounded memory."""
    return F.approx_count_distinct(_col(c))


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_ms(c: Column | str) -> Column:
    """Timestamp of milliseconds since 1970, UTC, without zone, whatever the session's zone."""
    return F.timestamp_add("MILLISECOND", _col(c), F.expr(_EPOCH))


def to_epoch_ms(c: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), _col(c).cast("timestamp_ntz"))


def day(c: Column | str) -> Column:
    """yyyy-MM-dd of a date or timestamp; one without zone has the same day in every session."""
    return _col(c).cast("date").cast("string")


def day_of_ms(c: Column | str) -> Column:
    """The UTC day of milliseconds since 1970."""
    return day(epoch_ms(c))


def day_of_ms_sql(name: str) -> str:
    """day_of_ms as SQL text, for partitionings that are named before there is a session."""
    return f"cast(cast(timestampadd(MILLISECOND, {name}, {_EPOCH}) AS date) AS string)"


def month(c: Column | str) -> Column:
    """yyyy-MM of a date or timestamp."""
    return F.substring(day(c), 1, 7)


def month_start(c: Column | str) -> Column:
    """date_trunc('month') without zone."""
    return F.trunc(_col(c).cast("date"), "month").cast("timestamp_ntz")


def parse_month(c: Column | str) -> Column:
    """First day of a month written as yyyy-MM."""
    return F.to_date(_col(c), "yyyy-MM")


def parse_timestamp(c: Column | str) -> Column:
    """Either `2023-01-31 13:00:00 UTC` or `01/31/2023 01:00:00 PM`; null if neither."""
    c = _col(c)
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss z")), F.try_to_timestamp(c, F.lit("MM/dd/yyyy hh:mm:ss a")))


def from_path(c: Column | str, key: str) -> Column:
    """Value of `key=` in a path."""
    return F.regexp_extract(_col(c), rf"(?:^|/){key}=([^/]+)", 1)
