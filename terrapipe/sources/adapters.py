"""Views of the driver's tables as observations, teleconnections and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows, each the start of much work, dealt out by their key to all tasks of a shuffle: a file of them may be a single task.

    The number is given, as Spark would merge partitions of few bytes again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the first and the last day of the orders."""
    return days_of(read(spark, sf_dir, "orders"))


def days_of(orders: DataFrame) -> DataFrame:
    day = F.to_date("o_orderdate")
    return orders.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations of each nation, from its orders: some days absent, some values missing."""
    return observed(spark, sf_dir)[0]


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The observations and the one row of their bounds, over the same reading of the orders."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    first_last = days_of(orders)
    # The narrow customer side is small next to orders; its size decides how they are joined.
    prices = (
        orders.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))
        .join(customer.select("c_custkey", F.col("c_nationkey").alias("block_id")), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("block_id", "date")
        .agg(F.min_by("o_totalprice", "o_orderkey").alias("price"))
    )
    days = F.explode(F.sequence("first", "last", F.expr("interval 1 day")))
    blocks = customer.select(F.col("c_nationkey").alias("block_id")).distinct()
    grid = blocks.crossJoin(F.broadcast(first_last)).select("block_id", days.alias("date"))  # one row
    b, doy = F.col("block_id"), F.dayofyear("date")
    gap = ((F.floor(doy / 5) + b) % 11 == 0) | ((F.floor(doy / 9) + b) % 13 == 0)
    tmin = 10.0 + (b % 5) + 0.03 * doy
    found = (
        grid.join(prices, ["block_id", "date"], "left")
        .where((b * 31 + doy) % 53 != 0)
        .select(
            "block_id",
            "date",
            F.coalesce(F.greatest(F.lit(0.0), (F.col("price") - 200000.0) / 10000.0), F.lit(0.0)).alias("rain_mm"),
            F.when(~gap, tmin).alias("tmin_c"),
            F.when(~gap, tmin + 8.0 + b % 3).alias("tmax_c"),
            (((b * 7 + doy * 13) % 100) / 100.0).alias("ens_dry_fraction"),
        )
    )
    return found, first_last


OBSERVATIONS_SQL = """
prices AS (
  SELECT c_nationkey AS block_id, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
cal AS (
  SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT CAST(min(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS a, CAST(max(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS b FROM orders)),
obs0 AS (
  SELECT b.block_id, c.date, p.price, dayofyear(c.date) AS doy
  FROM (SELECT DISTINCT c_nationkey AS block_id FROM customer) b CROSS JOIN cal c
  LEFT JOIN prices p ON p.block_id = b.block_id AND p.date = c.date),
obs AS (
  SELECT block_id, date,
    coalesce(greatest(0::DOUBLE, (price - 200000::DOUBLE) / 10000::DOUBLE), 0::DOUBLE) AS rain_mm,
    CASE WHEN NOT gap THEN tmin END AS tmin_c,
    CASE WHEN NOT gap THEN tmin + 8::DOUBLE + block_id % 3 END AS tmax_c,
    ((block_id * 7 + doy * 13) % 100) / 100::DOUBLE AS ens_dry_fraction
  FROM (SELECT *, (doy // 5 + block_id) % 11 = 0 OR (doy // 9 + block_id) % 13 = 0 AS gap,
          10::DOUBLE + block_id % 5 + 0.03::DOUBLE * doy AS tmin FROM obs0)
  WHERE (block_id * 31 + doy) % 53 <> 0)"""


def teleconnections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slow and a faster wave over the days of the orders."""
    day = F.datediff("date", F.lit("1995-01-01").cast("date"))
    days = F.explode(F.sequence("first", "last", F.expr("interval 1 day")))
    return bounds(spark, sf_dir).select(days.alias("date")).select(
        "date", F.sin(day / 200.0).alias("oni"), F.abs(F.sin(day / 7.0)).alias("mjo_amplitude")
    )


TELECONNECTIONS_SQL = """
tele AS (
  SELECT date, sin(d / 200::DOUBLE) AS oni, abs(sin(d / 7::DOUBLE)) AS mjo_amplitude
  FROM (SELECT date, date_diff('day', DATE '1995-01-01', date) AS d FROM cal))"""
