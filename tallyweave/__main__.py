"""python -m tallyweave --selftest: four contracts on small inputs. Exit 0 if all hold."""

import sys

from pyspark.sql import SparkSession

from . import Sampler, parse_metrics, render_metrics
from .operators import sample_with_replacement


def selftest() -> int:
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    weights, counters = [3, 0, 5.5, 1], {"a": 2**63, "b": -1, "c": 10**60}
    rows = spark.createDataFrame([(k, w) for k, w in enumerate([3, 0, 5, 1])], "idx long, weight long")
    draws = [sorted(map(tuple, sample_with_replacement(rows.repartition(n), 50, 7).collect())) for n in (1, 3)]
    held = {
        "draws don't depend on partitions": draws[0] == draws[1],
        "weights read back as supplied": Sampler(weights, seed=1, spark=spark).weights == weights,
        "counters survive": parse_metrics(render_metrics(counters)) == counters,
        "a line has no newline": "\n" not in render_metrics({"a\nb": "c\nd"}),
    }
    for what, ok in held.items():
        print("ok" if ok else "FAILED", what)
    return int(not all(held.values()))


if __name__ == "__main__":
    sys.exit(selftest() if sys.argv[1:] == ["--selftest"] else __doc__)
