"""The registered queries on sampling and metrics, and the same in DuckDB's SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import parse_rows, render_columns, render_rows
from ..operators.sampling import Sampler, sample_with_replacement, sample_without_replacement
from ..sources.tables import population, table

SEED = 42


def sample_replace_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_with_replacement(population(spark, sf_dir, "part", "p_partkey", "p_size"), 1000, SEED)


def sample_replace_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_with_replacement(population(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "decimal(18,4)"), 2000, SEED)


def sample_replace_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that aren't whole at any power of ten."""
    orders = population(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return sample_with_replacement(orders.withColumn("weight", F.col("weight") / 7), 2000, SEED)


def sample_noreplace_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_without_replacement(population(spark, sf_dir, "part", "p_partkey", "p_size"), 100, SEED)


def sample_noreplace_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_without_replacement(population(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 1000, SEED)


def sample_continues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampler = Sampler(population(spark, sf_dir, "part", "p_partkey", "p_size"), seed=SEED)
    return sampler.sample_frame(300).unionByName(sampler.sample_frame(300))


def sample_zero_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = population(spark, sf_dir, "part", "p_partkey", "p_size")
    return sample_with_replacement(part.withColumn("weight", F.when(F.col("weight") > 10, F.col("weight")).otherwise(0)), 1000, SEED)


def weights_as_supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sampler(population(spark, sf_dir, "part", "p_partkey", "p_size"), seed=SEED).weights_frame


def render_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = (F.sum(F.col("l_orderkey").cast("decimal(20,0)")) * F.lit(Decimal(10**20))).cast("decimal(38,0)")
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"), big.alias("big")).select(render_columns("rows", "big").alias("line"))


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))
    return counts.selectExpr("event_type", "stack(2, 'rows', cast(rows as decimal(38,0)), 'ids', cast(ids as decimal(38,0))) as (name, value)")


def render_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_rows(_by_type(spark, sf_dir), "event_type")


def parse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rows(render_by_group(spark, sf_dir)).withColumn("value", F.col("value").cast("string"))


QUERIES = {f.__name__: f for f in (sample_replace_int, sample_replace_decimal, sample_replace_double, sample_noreplace_int, sample_noreplace_double, sample_continues, sample_zero_weights, weights_as_supplied, render_global, render_by_group, parse_round_trip)}


def _hash(mode: str, key: str) -> str:
    return f"cast(('0x' || substr(md5('{SEED}|{mode}|' || cast({key} as varchar)), 1, 13)) as bigint)"


def _replace(source: str, key: str, weight: str, n: int, where: str = "true") -> str:
    return f"""
with w as (select cast({key} as bigint) as idx, cast({weight} as hugeint) as weight from {source} where {where}),
s as (select idx, cast(sum(weight) over (order by idx) as hugeint) as hi, weight from w where weight > 0),
d as (select cast(range as bigint) as draw, (cast({_hash("replace", "range")} as hugeint) * (select max(hi) from s)) // {1 << 52} as at from range({n}))
select d.draw, s.idx from d join s on d.at >= s.hi - s.weight and d.at < s.hi"""


def _once(source: str, key: str, weight: str, n: int) -> str:
    return f"""
with k as (select cast({key} as bigint) as idx, -ln(1 - {_hash("once0", key)} / {float(1 << 52)}) / {weight} as key from {source} where {weight} > 0)
select cast(row_number() over (order by key, idx) - 1 as bigint) as draw, idx from k order by key, idx limit {n}"""


_LINES = """select event_type, '{"ids":' || cast(sum(event_id) as varchar) || ',"rows":' || cast(count(*) as varchar) || '}' as line from events group by event_type"""
ORACLE_SQL = {
    "sample_replace_int": _replace("part", "p_partkey", "p_size", 1000),
    "sample_replace_decimal": _replace("orders", "o_orderkey", "cast(o_totalprice as decimal(18,4)) * 10000", 2000),
    "sample_replace_double": _replace("(select o_orderkey, o_totalprice / cast(7 as double) as w, max(o_totalprice / cast(7 as double)) over () as most from orders)", "o_orderkey", f"greatest(floor(w / most * {float(1 << 52)}), 1)", 2000),
    "sample_noreplace_int": _once("part", "p_partkey", "p_size", 100),
    "sample_noreplace_double": _once("orders", "o_orderkey", "o_totalprice", 1000),
    "sample_continues": _replace("part", "p_partkey", "p_size", 600),
    "sample_zero_weights": _replace("part", "p_partkey", "p_size", 1000, "p_size > 10"),
    "weights_as_supplied": "select cast(p_partkey as bigint) as idx, p_size as weight from part",
    "render_global": """select '{"big":' || cast(sum(cast(l_orderkey as hugeint)) * 100000000000000000000 as varchar) || ',"rows":' || cast(count(*) as varchar) || '}' as line from lineitem""",
    "render_by_group": _LINES,
    "parse_round_trip": "select event_type, 'ids' as name, cast(sum(event_id) as varchar) as value from events group by event_type union all select event_type, 'rows', cast(count(*) as varchar) from events group by event_type",
}
