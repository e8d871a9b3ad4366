"""Metrics as one line of JSON, and back, without rounding counters.

Two forms: of a dict on the driver (integers of any length Python converts), and of columns (DECIMAL(38,0), or digit
strings beyond that). Keys are sorted, nothing is spaced, null stays null.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALARS = (bool, int, float, str, type(None))


def render_metrics(metrics: dict) -> str:
    """One line of JSON. Nested values, keys that aren't strings, NaN and infinities raise."""
    for k, v in metrics.items():
        if not isinstance(k, str):
            raise TypeError(f"keys must be strings, found {k!r}")
        if not isinstance(v, _SCALARS):
            raise TypeError(f"{k!r} holds a {type(v).__name__}")
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"{k!r} isn't finite")
    return json.dumps(metrics, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _once(members: list[tuple]) -> dict:
    found = dict(members)
    if len(found) < len(members):
        raise ValueError("a name occurs twice")
    return found


def _rejected(name: str):
    raise ValueError(f"{name} isn't a number of JSON")


def parse_metrics(line: str) -> dict:
    """What render_metrics() was given. Names that occur twice, NaN, infinities and nested values raise."""
    found = json.loads(line, object_pairs_hook=_once, parse_constant=_rejected)
    if not isinstance(found, dict):
        raise ValueError("not a line of metrics")
    for k, v in found.items():
        if not isinstance(v, _SCALARS) or isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"{k!r} doesn't hold a metric")
    return found


def render_columns(*columns: str) -> Column:
    """The named columns of a row as one line; nulls are kept. A NaN or an infinity raises when the row is read."""

    def finite(name: str) -> Column:
        c = F.col(name)
        number = c.try_cast("double")
        bad = F.typeof(c).isin("double", "float") & (F.isnan(number) | (F.abs(number) == float("inf")))
        return F.when(bad, F.raise_error(F.lit(f"{name} isn't finite"))).otherwise(c).alias(name)

    return F.to_json(F.struct(*map(finite, sorted(columns))), {"ignoreNullFields": "false"})


def render_rows(df: DataFrame, *group: str) -> DataFrame:
    """A line for each group of (name, value) rows. A name that occurs twice in a group raises.
    A value must be an exact kind: whole decimals or integers, or digit strings of any length."""
    value = F.col("value").cast("string")
    checked = F.when(value.isNull() | value.rlike(r"\A-?(0|[1-9][0-9]*)\z"), F.coalesce(value, F.lit("null"))).otherwise(F.raise_error(F.concat(F.lit("not a counter: "), value)))
    quoted = F.to_json(F.array("name"))
    member = F.struct(F.col("name").alias("name"), F.concat(F.expr("substring({0}, 2, length({0}) - 2)".format("q")), F.lit(":"), F.col("v")).alias("text"))
    members = F.array_sort(F.collect_list(member))
    held = df.withColumn("q", quoted).withColumn("v", checked).groupBy(*group).agg(members.alias("m"))
    unique = F.when(F.size("m") == F.size(F.array_distinct(F.col("m.name"))), F.array_join(F.col("m.text"), ",")).otherwise(F.raise_error(F.lit("a name occurs twice")))
    return held.select(*group, F.concat(F.lit("{"), unique, F.lit("}")).alias("line"))


def parse_rows(df: DataFrame, line: str = "line", kind: str = "decimal(38,0)") -> DataFrame:
    """(other columns, name, value) for each member of each line; `kind` is 'string' for counters over 38 digits.
    A malformed line, a name that occurs twice or a counter that doesn't fit raises."""
    names = F.json_object_keys(F.col(line))
    held = F.from_json(F.col(line), "map<string,string>", {"mode": "FAILFAST"})
    held = F.when(F.size(names) != F.size(F.array_distinct(names)), F.raise_error(F.lit("a name occurs twice"))).otherwise(held)
    others = [c for c in df.columns if c != line]
    return df.select(*others, F.explode(held).alias("name", "value")).withColumn("value", F.col("value").cast(kind))
