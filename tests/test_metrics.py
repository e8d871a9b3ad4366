from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave import parse_metrics, render_metrics
from tallyweave.operators import parse_rows, render_columns, render_rows

BIG = [0, -1, 2**53 + 1, 2**63, int("9" * 38), int("9" * 39), int("7" * 60), 10**4299]


@given(st.dictionaries(st.text(), st.integers() | st.booleans() | st.none() | st.text() | st.floats(allow_nan=False, allow_infinity=False)))
def test_round_trip(metrics):
    line = render_metrics(metrics)
    assert "\n" not in line and parse_metrics(line) == metrics


@pytest.mark.parametrize("value", BIG, ids=range(len(BIG)))
def test_large_counters(value):
    assert parse_metrics(render_metrics({"n": value})) == {"n": value}


@pytest.mark.parametrize("metrics", [{1: 2}, {"a": [1]}, {"a": {}}])
def test_rejected_kinds(metrics):
    with pytest.raises(TypeError):
        render_metrics(metrics)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 10**4300], ids=("nan", "inf", "long"))
def test_rejected_values(value):
    with pytest.raises(ValueError):
        render_metrics({"a": value})


def test_malformed_line():
    for line in ("{", "[1]", "", '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', '{"a":[1]}'):
        with pytest.raises(ValueError):
            parse_metrics(line)


def test_rows_round_trip(spark):
    rows = [("g", 'a "q"\n', Decimal(10**37)), ("g", "é", Decimal(-5)), ("h", "a", None)]
    df = spark.createDataFrame(rows, "g string, name string, value decimal(38,0)")
    lines = render_rows(df, "g")
    assert all("\n" not in r.line for r in lines.collect())
    assert sorted((r.g, r.name, r.value) for r in parse_rows(lines).collect() if r.value is not None) == sorted(rows[:2])
    assert parse_metrics(lines.where("g = 'g'").first().line) == {'a "q"\n': 10**37, "é": -5}


def test_digit_strings_beyond_decimals(spark):
    df = spark.createDataFrame([("n", "9" * 60)], "name string, value string")
    line = render_rows(df).first().line
    assert parse_metrics(line) == {"n": int("9" * 60)}
    back = parse_rows(spark.createDataFrame([(line,)], "line string"), kind="string").first()
    assert back.value == "9" * 60


def test_wide_columns_keep_nulls(spark):
    df = spark.createDataFrame([(Decimal(2**64), None)], "b decimal(38,0), a long")
    assert df.select(render_columns("b", "a").alias("l")).first().l == '{"a":null,"b":18446744073709551616}'


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_wide_columns_raise_on_what_is_not_finite(spark, value, kind):
    df = spark.createDataFrame([(value, "NaN")], f"a {kind}, b string")
    assert df.select(render_columns("b").alias("l")).first().l == '{"b":"NaN"}'
    with pytest.raises(PySparkException):
        df.select(render_columns("a")).collect()


@pytest.mark.parametrize("value", ["5\n", "007", "", "-", "+1", "1.0"])
def test_digit_strings_are_strict(spark, value):
    with pytest.raises(PySparkException):
        render_rows(spark.createDataFrame([("a", value)], "name string, value string")).collect()


def test_rows_raise(spark):
    with pytest.raises(PySparkException):
        parse_rows(spark.createDataFrame([('{"a":1,"a":2}',)], "line string")).collect()
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "name string, value long")
    with pytest.raises(PySparkException):
        render_rows(twice).collect()
    with pytest.raises(PySparkException):
        render_rows(twice.limit(1).withColumn("value", F.lit("1.5"))).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        parse_rows(spark.createDataFrame([('{"a":',)], "line string")).collect()
