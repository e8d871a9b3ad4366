"""Weighted draws from a population (idx BIGINT, weight), with or without replacement.

With replacement, draw number d falls on the integer position hash(seed, d) * total div 2^52, and takes the index whose
half-open stretch of the running weight sum holds it.

1. The population is dealt into parts by ranges of idx, of about PART_ROWS rows each, and written once. Running sums are made within parts,
   whose offsets come from one row a part.
2. A draw finds its part by a grid over the whole line: each part is listed under the cells it reaches into, at most PARTS parts
   and twice as many cells, so this table is broadcast.
3. Within a part, draws and starts of stretches are put in order of position, and a draw takes the last start before it. A
   part that holds most of the total weight gets most of the draws: they are dealt out over as many copies of the part as
   keep the expected draws of each under DRAWS.

Without replacement, indices are ordered by -ln(1 - u) / weight (Efraimidis and Spirakis, 2006) and the first n taken.
Over TOP rows, they are numbered by ranges of the key with offsets instead of in one task.

A null idx raises, as does a repeated one: with replacement anywhere, without it if it would be drawn twice.
"""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.uniform import BITS, hash_bits, uniform
from ..sources.shared import written

#: Rows that a part of the population is meant to hold.
PART_ROWS = 1 << 16
#: Parts at most; beyond PARTS * PART_ROWS rows parts grow.
PARTS = 20_000
#: Draws that are expected in one copy of a part.
DRAWS = 1 << 18
#: Draws without replacement that are ordered and numbered in one task.
TOP = 1 << 20
_WHOLE = "decimal(38,0)"
#: Positions must fit DECIMAL(38,0).
_MOST = 10**37


def checked(population: DataFrame) -> DataFrame:
    """The population without zero weights. A null idx, or a null, negative, NaN or infinite weight, raises when the rows are read."""
    w = F.col("weight")
    bad = w.isNull() | (w < 0)
    if dict(population.dtypes)["weight"] in ("double", "float"):
        bad = bad | F.isnan(w) | (F.abs(w) == F.lit(float("inf")))
    checked_weight = (
        F.when(F.col("idx").isNull(), F.raise_error(F.lit("idx must not be null")))
        .when(bad, F.raise_error(F.concat(F.lit("weights must be finite and not negative, found "), F.coalesce(w.cast("string"), F.lit("NULL")))))
        .otherwise(w)
    )
    return population.select("idx", checked_weight.alias("weight")).where(F.col("weight") > 0)


def whole_weights(population: DataFrame) -> DataFrame:
    """Weights as whole numbers in the same proportions.

    Integers stay; decimals are scaled by their power of ten. Doubles are scaled by 10^4 where that is exact for all;
    otherwise they are cut to a grid of 2^-52 of the largest, at least one step each."""
    kind = dict(population.dtypes)["weight"]
    w = F.col("weight")
    if kind in ("double", "float"):
        w = w.cast("double")
        exact, most = population.agg(F.min((w < 1e13) & (F.round(w * 10_000) / 10_000 == w)), F.max(w)).first()
        scaled = F.round(w * 10_000) if exact or most is None else F.greatest(F.floor(w / F.lit(most) * float(1 << 52)), F.lit(1))
        return population.select("idx", scaled.cast(_WHOLE).alias("weight"))
    if kind.startswith("decimal"):
        places = int(kind[8:-1].split(",")[1])
        return population.select("idx", (w.cast(f"decimal(38,{places})") * F.lit(10**places)).cast(_WHOLE).alias("weight"))
    return population.select("idx", w.cast(_WHOLE).alias("weight"))


@dataclass
class Line:
    """A population laid out on the line of its summed weights."""

    total: int
    parts: DataFrame  # (part, lo, hi), one row a part
    stretches: DataFrame  # (part, idx, lo)
    count: int  # of parts


def lay_out(population: DataFrame) -> Line:
    """Writes the drawable population in parts; what is returned serves any number of draws."""
    drawable = whole_weights(checked(population))
    count, total = drawable.agg(F.count("*"), F.sum("weight").cast(_WHOLE)).first()
    if not count:
        raise ValueError("no weight is above zero")
    if total >= _MOST:
        raise ValueError("the weights' sum, in whole steps, is over 10^37")
    wanted = min(PARTS, -(-count // PART_ROWS))
    # The bounds of ranges are sampled, so the parts are written: whatever reads them must see the same.
    held = written(drawable.repartitionByRange(wanted, "idx").select("idx", "weight", F.spark_partition_id().alias("part")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = held.groupBy("part").agg(F.sum("weight").cast(_WHOLE).alias("sum"))
    parts = sums.select("part", "sum", F.sum("sum").over(before).cast(_WHOLE).alias("hi")).select("part", (F.col("hi") - F.col("sum")).cast(_WHOLE).alias("lo"), "hi")
    order = Window.partitionBy("part").orderBy("idx")
    inner = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(_WHOLE)
    same = F.lag("idx").over(order).eqNullSafe(F.col("idx"))
    inner = F.when(same, F.raise_error(F.concat(F.lit("idx occurs twice: "), F.col("idx").cast("string")))).otherwise(inner)
    within = held.select("part", "idx", inner.alias("inner"))
    stretches = within.join(F.broadcast(parts), "part").select("part", "idx", (F.col("lo") + F.col("inner")).cast(_WHOLE).alias("lo"))
    return Line(int(total), parts, stretches, wanted)


def draw(line: Line, n: int, seed: int, start: int = 0) -> DataFrame:
    """(draw, idx) for draws start to start + n - 1."""
    spark = line.parts.sparkSession
    high, low = divmod(line.total, 1 << BITS)
    h = F.col("h").cast("decimal(16,0)")
    # hash * total div 2^52 in two steps, as the product may not fit.
    rest = F.expr(f"cast(h as decimal(16,0)) * cast({low} as decimal(16,0)) div cast({1 << BITS} as decimal(16,0))")
    at = (h * F.lit(Decimal(high)).cast("decimal(22,0)") + rest).cast(_WHOLE)
    draws = spark.range(n).select((F.col("id") + F.lit(start)).alias("draw")).withColumn("h", hash_bits(seed, "replace", F.col("draw"))).select("draw", at.alias("at"))
    width = -(-line.total // (2 * line.count))
    cell = lambda x: F.expr(f"{x} div cast({width} as decimal(38,0))")
    copies = F.ceil(F.lit(float(n)) * (F.col("hi") - F.col("lo")).cast("double") / F.lit(float(line.total)) / F.lit(float(DRAWS))).cast("int")
    parts = line.parts.select("part", "lo", "hi", F.greatest(F.lit(1), copies).alias("copies"))
    grid = parts.withColumn("last", F.col("hi") - 1).withColumn("cell", F.explode(F.sequence(cell("lo"), cell("last"))))
    # At most PARTS parts in twice as many cells: three rows a part.
    placed = draws.withColumn("cell", cell("at")).join(F.broadcast(grid), "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    placed = placed.select("part", F.pmod(F.xxhash64("draw"), F.col("copies")).cast("int").alias("copy"), "at", "draw", F.lit(None).cast("long").alias("idx"))
    starts = line.stretches.join(F.broadcast(parts.select("part", "copies")), "part")
    starts = starts.select("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("lo").alias("at"), F.lit(None).cast("long").alias("draw"), "idx")
    order = Window.partitionBy("part", "copy").orderBy("at", F.col("idx").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(placed).withColumn("found", F.last("idx", ignorenulls=True).over(order)).where(F.col("draw").isNotNull()).select("draw", F.col("found").alias("idx"))


def _counted(population: DataFrame, n: int) -> DataFrame | None:
    if n < 0:
        raise ValueError("n must not be negative")
    return population.sparkSession.createDataFrame([], "draw long, idx long") if n == 0 else None


def sample_with_replacement(population: DataFrame, n: int, seed: int, start: int = 0) -> DataFrame:
    """(draw, idx) for draws start to start + n - 1, so draws 0-299 and 300-599 together equal one call of 600."""
    none = _counted(population, n)
    return draw(lay_out(population), n, seed, start) if none is None else none


def sample_without_replacement(population: DataFrame, n: int, seed: int, call: int = 0) -> DataFrame:
    """(draw, idx): successive draws by weight among the indices that are left."""
    none = _counted(population, n)
    if none is not None:
        return none
    drawable = checked(population)
    count = drawable.count()
    if count < n:
        raise ValueError("n is over the number of indices with a weight above zero")
    u = uniform(seed, f"once{call}", F.col("idx"))
    keyed = drawable.select("idx", (-F.log(1 - u) / F.col("weight").cast("double")).alias("key"))
    order = Window.orderBy("key", "idx")
    if n <= TOP:
        first = keyed.orderBy("key", "idx").limit(n).select((F.row_number().over(order) - 1).cast("long").alias("draw"), "idx")
    else:
        # A bound that about n keys lie below; if fewer do, all rows are ordered.
        bound = keyed.agg(F.percentile_approx("key", min(1.0, 1.02 * n / count), 10_000)).first()[0]
        below = keyed.where(F.col("key") <= F.lit(bound))
        if below.count() >= n:
            keyed = below
        held = written(keyed.repartitionByRange(min(PARTS, -(-n // PART_ROWS)), "key", "idx").select("key", "idx", F.spark_partition_id().alias("part")))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = held.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
        place = F.row_number().over(Window.partitionBy("part").orderBy("key", "idx")) - 1
        first = held.withColumn("place", place).join(F.broadcast(offsets), "part").select((F.col("place") + F.col("offset")).cast("long").alias("draw"), "idx").where(F.col("draw") < n)
    # Among n drawn indices, so no more than n rows move.
    times = F.count("*").over(Window.partitionBy("idx"))
    return first.withColumn("times", times).select("draw", F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("idx occurs twice: "), F.col("idx").cast("string")))).otherwise(F.col("idx")).alias("idx"))


class Sampler:
    """Draws from a list of weights, or from a DataFrame (idx, weight).

    seed=None picks a random seed once; `seed` tells it. With replacement, calls continue one sequence; without it each
    call is a new drawing, told apart by its number."""

    def __init__(self, weights, replacement: bool = True, seed: int | None = None, spark: SparkSession | None = None):
        self.replacement, self.seed = replacement, secrets.randbits(63) if seed is None else seed
        self._given = None if isinstance(weights, DataFrame) else list(weights)
        self._at, self._line = 0, None
        if self._given is None:
            self.population = weights.select("idx", "weight")
        else:
            if not self._given:
                raise ValueError("weights must not be empty")
            if any(w is None or not w >= 0 or w == math.inf for w in self._given) or not any(self._given):
                raise ValueError("weights must be finite, not negative and not all zero")
            spark = spark or SparkSession.builder.getOrCreate()
            whole = all(isinstance(w, int) for w in self._given)
            rows = [(k, w if whole else float(w)) for k, w in enumerate(self._given)]
            self.population = spark.createDataFrame(rows, f"idx long, weight {'long' if whole else 'double'}")

    @property
    def weights_frame(self) -> DataFrame:
        """(idx, weight) as supplied, with the kind of weight that was given."""
        return self.population

    @property
    def weights(self) -> list[float]:
        """As supplied."""
        if self._given is not None:
            return [float(w) for w in self._given]
        return [float(r.weight) for r in self.weights_frame.orderBy("idx").collect()]

    def sample_frame(self, n: int) -> DataFrame:
        """(draw, idx); with replacement `draw` goes on from the call before, and the population is laid out once."""
        at = self._at
        none = _counted(self.population, n)
        self._at += n if self.replacement else 1
        if none is not None:
            return none
        if not self.replacement:
            return sample_without_replacement(self.population, n, self.seed, at)
        self._line = self._line or lay_out(self.population)
        return draw(self._line, n, self.seed, at)

    def sample(self, n: int) -> list[int]:
        return [r.idx for r in self.sample_frame(n).orderBy("draw").collect()]
