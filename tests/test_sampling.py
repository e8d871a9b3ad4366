import hashlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from tallyweave import Sampler
from tallyweave.operators import sample_with_replacement, sample_without_replacement, sampling


def frame(spark, weights, kind="long"):
    return spark.createDataFrame(list(enumerate(weights)), f"idx long, weight {kind}")


def draws(df):
    return [r.idx for r in df.orderBy("draw").collect()]


def brute(weights, n, seed):
    total, out = sum(weights), []
    for d in range(n):
        at = int(hashlib.md5(f"{seed}|replace|{d}".encode()).hexdigest()[:13], 16) * total >> 52
        for k, w in enumerate(weights):
            if at < w:
                out.append(k)
                break
            at -= w
    return out


@pytest.mark.parametrize("part", [1 << 16, 40, 1])
@pytest.mark.parametrize("weights", [[3, 0, 5, 1], [1], [0, 0, 7], list(range(1, 100)), [10**12, 1, 1, 1], [1, 1, 1, 10**12], [2**62] * 30])
def test_replacement_equals_brute_force(spark, weights, part, monkeypatch):
    monkeypatch.setattr(sampling, "PART_ROWS", part)
    monkeypatch.setattr(sampling, "DRAWS", 30)
    assert draws(sample_with_replacement(frame(spark, weights), 200, 9)) == brute(weights, 200, 9)


def test_draws_do_not_depend_on_partitions(spark):
    rows = frame(spark, range(1, 200))
    want = draws(sample_with_replacement(rows, 100, 3))
    once = draws(sample_without_replacement(rows, 50, 3))
    for n in (1, 3, 8):
        assert draws(sample_with_replacement(rows.repartition(n), 100, 3)) == want
        assert draws(sample_without_replacement(rows.repartition(n), 50, 3)) == once


def test_without_replacement_repeats_nothing(spark):
    got = draws(sample_without_replacement(frame(spark, range(50)), 49, 1))
    assert sorted(got) == list(range(1, 50))


def test_frequencies_follow_weights(spark):
    weights = [1, 2, 3, 4]
    found = Counter(draws(sample_with_replacement(frame(spark, weights), 20_000, 11)))
    chi = sum((found[k] - 2000 * w) ** 2 / (2000 * w) for k, w in enumerate(weights))
    assert chi < 16.3  # 0.999 quantile, 3 degrees of freedom


def test_calls_continue(spark):
    a, b = Sampler([1, 2, 3], seed=5, spark=spark), Sampler([1, 2, 3], seed=5, spark=spark)
    assert a.sample(3) + a.sample(3) == b.sample(6)


def test_fractional_weights(spark):
    assert draws(sample_with_replacement(frame(spark, [0.5, 0.25, 0.25], "double"), 64, 2)) == draws(sample_with_replacement(frame(spark, [2, 1, 1]), 64, 2))
    odd = draws(sample_with_replacement(frame(spark, [1 / 3, 2 / 3], "double"), 3000, 2))
    assert 850 < odd.count(0) < 1150


@pytest.mark.parametrize("count", [3_000, 100_000, 3_000_000])
def test_many_fractional_weights(spark, count):
    rows = spark.range(count).select(F.col("id").alias("idx"), ((F.col("id") % 7 + 1) / 3).alias("weight"))
    got = draws(sample_with_replacement(rows, 500, 2))
    grid = [max(1, int((k + 1) / 3 / (7 / 3) * 2.0**52)) for k in range(7)]
    total = sum(grid[k] * (count // 7 + (k < count % 7)) for k in range(7))
    for d in (0, 1, 250, 499):
        at = int(hashlib.md5(f"2|replace|{d}".encode()).hexdigest()[:13], 16) * total >> 52
        turns, at = divmod(at, sum(grid))
        k = next(k for k in range(7) if at < sum(grid[: k + 1]))
        assert got[d] == 7 * turns + k


def test_many_draws_without_replacement(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("idx"), (F.col("id") % 9).alias("weight"))
    want = draws(sample_without_replacement(rows, 900, 3))
    monkeypatch.setattr(sampling, "TOP", 10)
    monkeypatch.setattr(sampling, "PART_ROWS", 100)
    assert draws(sample_without_replacement(rows, 900, 3)) == want
    assert sorted(draws(sample_without_replacement(rows, 4444, 3))) == [k for k in range(5000) if k % 9]


@pytest.mark.parametrize("rows", [[(None, 1), (1, 2)], [(1, 1), (1, 1), (2, 5)]])
def test_null_and_repeated_indices_raise(spark, rows):
    df = spark.createDataFrame(rows, "idx long, weight long")
    with pytest.raises(PySparkException):
        sample_with_replacement(df, 5, 1).collect()
    with pytest.raises(PySparkException):
        sample_without_replacement(df, len(rows), 1).collect()


def test_weights_as_supplied(spark):
    assert Sampler([1, 2.5, 0], spark=spark).weights == [1.0, 2.5, 0.0]
    assert Sampler(frame(spark, [4, 5])).weights == [4.0, 5.0]


@pytest.mark.parametrize("weights", [[-1.0, 2.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]])
def test_bad_weights_raise(spark, weights):
    with pytest.raises(PySparkException):
        sample_with_replacement(frame(spark, weights, "double"), 3, 1).collect()
    with pytest.raises(ValueError):
        Sampler(weights, spark=spark)


def test_bad_calls_raise(spark):
    rows = frame(spark, [1, 0, 2])
    for n in (-1,):
        with pytest.raises(ValueError):
            sample_with_replacement(rows, n, 1)
        with pytest.raises(ValueError):
            sample_without_replacement(rows, n, 1)
    with pytest.raises(ValueError):
        sample_without_replacement(rows, 3, 1)
    with pytest.raises(ValueError):
        sample_with_replacement(frame(spark, [0, 0]), 1, 1)
    with pytest.raises(ValueError):
        Sampler([], spark=spark)
    assert draws(sample_with_replacement(rows, 0, 1)) == []
