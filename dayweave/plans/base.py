"""Daily series, device pairs, samples and intervals taken from the given tables.

Each loader has a twin CTE text for the oracle.  Money is summed in whole
cents, so both engines start from identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.operators import calendar as cal


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    local = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero (``round`` in both engines)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


# --- daily series from orders ----------------------------------------------------

def order_days(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entity and day that has orders."""
    orders = table(spark, sf, "orders")
    return (
        orders.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )
    )


ORDER_DAYS = """order_days AS (
  SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, day, a, b, pain): gap-free, empty days are 0."""
    base = order_days(spark, sf).select(
        "entity",
        "day",
        F.col("n").cast("double").alias("a"),
        (F.col("cents") / F.lit(131071.0)).alias("b"),
        (F.col("cents").cast("double") / F.col("n") / F.lit(131071.0)).alias("pain"),
    )
    return cal.fill_calendar(base, ["entity"], "day", {"a": 0.0, "b": 0.0, "pain": 0.0})


DAILY = (
    ORDER_DAYS
    + """,
span AS (SELECT min(day) AS lo, max(day) AS hi FROM order_days),
spine AS (
  SELECT entity, CAST(lo + CAST(i AS INTEGER) AS DATE) AS day, i AS pos
  FROM (SELECT DISTINCT entity FROM order_days) e, span,
       (SELECT unnest(range(0, 4000)) AS i) g
  WHERE lo + CAST(i AS INTEGER) <= hi),
daily AS (
  SELECT s.entity, s.day, s.pos,
         CAST(coalesce(n, 0) AS DOUBLE) AS a,
         coalesce(cents, 0) / 131071.0 AS b,
         coalesce(CAST(cents AS DOUBLE) / n / 131071.0, 0) AS pain
  FROM spine s LEFT JOIN order_days o ON s.entity = o.entity AND s.day = o.day)"""
)


def sparse_daily(spark: SparkSession, sf: str) -> DataFrame:
    """As ``daily`` but days without orders stay NULL."""
    base = order_days(spark, sf).select(
        "entity",
        "day",
        F.col("n").cast("double").alias("a"),
        (F.col("cents").cast("double") / F.col("n") / F.lit(131071.0)).alias("pain"),
    )
    return cal.fill_calendar(base, ["entity"], "day")


SPARSE = (
    DAILY
    + """,
sparse AS (
  SELECT s.entity, s.day, s.pos, CAST(n AS DOUBLE) AS a, CAST(cents AS DOUBLE) / n / 131071.0 AS pain
  FROM spine s LEFT JOIN order_days o ON s.entity = o.entity AND s.day = o.day)"""
)


# --- two devices from lineitem ---------------------------------------------------

def devices(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, day, main, other) per ship day; main is 0 on low days."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("main"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(131071.0)).alias("other"),
        F.count(F.lit(1)).alias("lines"),
    )


DEVICES = """devices AS (
  SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS main,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 131071.0 AS other,
         count(*) AS lines
  FROM lineitem GROUP BY 1, 2)"""


# --- samples and intervals from events ---------------------------------------------

def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, ts, value, sample_id) of every event."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("entity"), "ts", "value", F.col("event_id").alias("sample_id")
    )


SAMPLES = """samples AS (
  SELECT user_id AS entity, ts, value, event_id AS sample_id FROM events)"""


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, interval_id, start_ts, end_ts, label): a signup until the next event."""
    from dayweave.operators import intervals as iv

    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("entity"), "ts", "event_type", F.col("event_id").alias("interval_id")
    )
    log = iv.intervals_from_events(ev, ["entity"], "ts", "interval_id", ["event_type"])
    return log.where((F.col("event_type") == "signup") & F.col("end_ts").isNotNull()).select(
        "entity", "interval_id", "start_ts", "end_ts", F.col("event_type_next").alias("label")
    )


STAYS = """stays AS (
  SELECT entity, interval_id, start_ts, end_ts, label FROM (
    SELECT user_id AS entity, event_id AS interval_id, event_type, ts AS start_ts,
           lead(ts) OVER w AS end_ts, lead(event_type) OVER w AS label
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE event_type = 'signup' AND end_ts IS NOT NULL)"""


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, interval_id, start_ts, end_ts): each purchase opens a 6-hour interval."""
    ev = table(spark, sf, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        F.col("user_id").alias("entity"),
        F.col("event_id").alias("interval_id"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("interval 6 hours")).alias("end_ts"),
        F.col("value").alias("weight"),
    )


VISITS = """visits AS (
  SELECT user_id AS entity, event_id AS interval_id, ts AS start_ts,
         ts + INTERVAL 6 HOUR AS end_ts, value AS weight
  FROM events WHERE event_type = 'purchase')"""


# --- oracle tails ---------------------------------------------------------------

def sql_normal_p(z):
    """Two-sided normal tail by Simpson's rule on 400 steps."""
    terms = f"list_sum([ (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(abs({z}) * i / 400.0::DOUBLE, 2)) for i in range(0, 401)])"
    return f"(1 - 2 * abs({z}) / 400.0::DOUBLE / 3 * {terms} / sqrt(2 * pi()))"


def sql_t_p(t, n):
    """Two-sided Student tail by Simpson's rule on 2000 steps of the density."""
    terms = f"list_sum([ (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs({t}) * i / 2000.0::DOUBLE, 2) / ({n}), -(({n}) + 1) / 2.0::DOUBLE) for i in range(0, 2001)])"
    front = f"exp(lgamma((({n}) + 1) / 2.0::DOUBLE) - lgamma(({n}) / 2.0::DOUBLE)) / sqrt(pi() * ({n}))"
    return f"(1 - 2 * abs({t}) / 2000.0::DOUBLE / 3 * {terms} * {front})"
