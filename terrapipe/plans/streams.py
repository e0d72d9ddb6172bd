"""Streams over the events and the evaluations, replayed in batches that come late, twice and out of order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import read
from ..storage import folder
from ..streaming import sinks
from . import rules
from .registry import query, r, rounded, sql


def fed(rows: DataFrame, slices: list[Column], start: Callable[[DataFrame, str], object]) -> str:
    """Feed the rows of each slice in turn, and again where slices overlap; each is taken by one run with the same checkpoint.

    ``start`` turns (stream, folder) into a started or startable writer. Returns the folder.
    """
    spark = rows.sparkSession
    base = folder(spark, "stream")
    rows.write.parquet(f"{base}/all")
    whole = spark.read.schema(rows.schema).parquet(f"{base}/all")
    for own in slices:
        whole.where(own).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        start(stream, base).trigger(availableNow=True).start().awaitTermination()
    return base


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation of every request as an event: its id, day, place, action and first reason."""
    found = rules.emitted(spark, sf_dir)
    return found.select(
        F.col("request_id").alias("event_id"),
        F.col("as_of").cast("timestamp").alias("detected_at"),
        "state",
        "district",
        "action",
        F.get("reasons", F.lit(0)).alias("reason"),
    )


@query(
    "audit_stream",
    sql(
        """SELECT e.request_id AS event_id, e.action, e.reasons[1] AS reason, CASE WHEN e.action <> 'abstain' THEN q.state END AS state,
        CASE WHEN e.action <> 'abstain' THEN q.district END AS district
        FROM emitted e JOIN requests q ON q.request_id = e.request_id""",
        "emitted",
    ),
)
def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit after batches that come out of order and twice: each evaluation once, each advisory once, with the place of its event."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    return audited(evaluations(spark, sf_dir), [part == 1, part == 0, part == 1, F.lit(True)])


def audited(rows: DataFrame, slices: list[Column]) -> DataFrame:
    """Each evaluation of the slices with the place of its advisory; where all are silent there is no advisory to read."""
    spark = rows.sparkSession
    base = fed(rows, slices, lambda s, at: sinks.audit_with_parent(s, f"{at}/events", f"{at}/advisories", f"{at}/checkpoint"))
    events = sinks.table(spark, f"{base}/events", "event_id long, action string, reason string")
    said = sinks.table(spark, f"{base}/advisories", "event_id long, state string, district string")
    return events.join(said, "event_id", "left").select("event_id", "action", "reason", "state", "district")


_END = "2100-01-01 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of time with ``part``: 0, 1, 2 as they come, 3 for those that come late; and a last one that ends all windows."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))  # one row
    third = F.least(F.lit(2), F.expr("cast((unix_micros(ts) - unix_micros(a)) * 3 div (unix_micros(b) - unix_micros(a)) as int)"))
    late = F.col("event_id") % 97 == 0
    out = rows.crossJoin(F.broadcast(span)).withColumn("part", F.when(late, 3).otherwise(third)).drop("a", "b")
    last = spark.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(_END).cast("timestamp").alias("ts"),
        F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(4).alias("part"),
    )
    return out.unionByName(last)


def _appended(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], object]:
    return lambda s, at: make(s).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")


_SPAN = """
span AS (SELECT min(ts) AS a, max(ts) AS b FROM events),
parted AS (
  SELECT e.*, CASE WHEN event_id % 97 = 0 THEN 3 ELSE least(2, (epoch_us(ts) - epoch_us(a)) * 3 // (epoch_us(b) - epoch_us(a))) END AS part FROM events e, span),
mark AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM parted WHERE part < 3)"""


@query(
    "stream_sliding_windows",
    f"""WITH {_SPAN}, windows AS (
      SELECT event_type, part, value, make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000) AS start FROM parted, range(4) t(k))
    SELECT event_type, start, count(*)::BIGINT AS n, round(sum(value), 4) + 0::DOUBLE AS total FROM windows, mark
    WHERE part < 3 OR start + INTERVAL 1 DAY > mark GROUP BY 1, 2""",
)
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of a day that start every six hours; a late event counts where its window is still open."""
    rows = _events(spark, sf_dir)
    make = lambda s: sinks.sliding(s, ["event_type"], "1 day", "6 hours", "2 days")
    base = fed(rows, [F.col("part") == k for k in range(5)], _appended(make))
    out = sinks.table(spark, f"{base}/out", "event_type string, start timestamp, n long, total double")
    return rounded(out.where("event_type <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query(
    "stream_sessions",
    """WITH apart AS (
      SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM apart)
    SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n, round(sum(value), 4) + 0::DOUBLE AS total FROM numbered GROUP BY user_id, k""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by twelve quiet hours; the events come in two interleaved halves, within the watermark."""
    rows = _events(spark, sf_dir)
    half = F.col("event_id") % 2
    make = lambda s: sinks.sessions(s, ["user_id"], "12 hours", "40 days")
    base = fed(rows, [(F.col("part") < 4) & (half == 1), (F.col("part") < 4) & (half == 0), F.col("part") == 4], _appended(make))
    out = sinks.table(spark, f"{base}/out", "user_id long, start timestamp, n long, total double")
    return rounded(out.where("user_id >= 0").withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query(
    "stream_late_rows",
    f"""WITH {_SPAN} SELECT part::INT AS part, count(*)::BIGINT AS rows, count(*) FILTER (part = 3 AND ts < mark)::BIGINT AS late
    FROM parted, mark GROUP BY 1""",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each batch lay behind the watermark of those before."""
    rows = _events(spark, sf_dir).where("part < 4")
    start = lambda s, at: sinks.count_late(s, f"{at}/late", f"{at}/checkpoint", F.expr("interval 2 days"))
    base = fed(rows, [F.col("part") == k for k in range(4)], start)
    return spark.read.parquet(f"{base}/late").select(F.col("epoch").cast("int").alias("part"), "rows", "late")


@query(
    "stream_newest_file",
    """SELECT source, file_id, modified FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS source, page_id AS file_id, page_id * 37 % 101 AS modified,
      row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id * 37 % 101 DESC, page_id) AS k FROM pages) WHERE k = 1""",
)
def stream_newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of each host as the state of a stream that gets the pages out of order, some of them twice."""
    rows = read(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"),
        F.col("page_id").cast("long").alias("file_id"),
        (F.col("page_id") * 37 % 101).cast("long").alias("modified"),
    )
    part = F.pmod(F.xxhash64("file_id"), F.lit(3))
    start = lambda s, at: sinks.log_changes(sinks.newest_of_source(s), f"{at}/log", f"{at}/checkpoint")
    base = fed(rows, [part == 2, part == 0, part == 2, part == 1], start)
    return sinks.standing(sinks.table(spark, f"{base}/log", "source string, file_id long, modified long, change string"))
