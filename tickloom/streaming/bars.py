"""Streaming bars and the tier state machine, and batch twins that check them."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.bars import event_bars
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under one of our own where that is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not top and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top or 'file://' + tempfile.mkdtemp(prefix='tickloom-stream-')}/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLC by key and window from a stream; state of a window goes once the watermark has passed it."""
    return event_bars(events.withWatermark("ts", late), width)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is available now, into a table of the shared folder, and reads that.

    Sinks and offsets are in the shared folder, so a restarted driver goes on where the last one stopped.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    state: dict[str, str] = {}
    stream_schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        state["path"] = f"{folder}/batch-{number}"
        batch.write.mode("overwrite").parquet(state["path"])

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    if "path" not in state:  # nothing was available
        return spark.createDataFrame([], stream_schema)
    return spark.read.parquet(state["path"])


def stream_hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from the event stream, all windows in the last batch."""
    out = drained(stream_bars(event_stream(spark, sf_dir)))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.round("amount", 4).alias("amount"), "n")


QUERIES["stream_hourly_bars"] = stream_hourly_bars
SQL["stream_hourly_bars"] = """SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS amount, count(*) AS n FROM events GROUP BY ALL"""


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user: user_id, start, n, total; works on streams with a watermark too."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


QUERIES["event_sessions"] = event_sessions
SQL["event_sessions"] = """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
 SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k"""

# Probabilities at which a tier is entered or left, and days below the lowest before a symbol goes dormant
ACTIVE, OBSERVE, DORMANT_DAYS = 0.60, 0.40, 5


def next_tier(tier: str, low_days: int, probability: float) -> tuple[str, int]:
    """The tier after one more observation, and the days in a row below OBSERVE."""
    low_days = low_days + 1 if probability < OBSERVE else 0
    if probability >= ACTIVE:
        return "active", 0
    if low_days >= DORMANT_DAYS:
        return "dormant", low_days
    if tier == "dormant" and probability < OBSERVE:
        return "dormant", low_days
    return ("active" if tier == "active" and probability >= OBSERVE else "observe"), low_days


def tier_stream(stream: DataFrame) -> DataFrame:
    """symbol, tier, low_days after each micro-batch of (symbol, ts, probability): state is one row a symbol."""

    def update(key: tuple, frames, state: GroupState):
        tier, low = state.get if state.exists else ("observe", 0)
        rows = pd.concat(list(frames)).sort_values("ts")
        for p in rows["probability"]:
            tier, low = next_tier(tier, int(low), float(p))
        state.update((tier, low))
        yield pd.DataFrame({"symbol": [key[0]], "tier": [tier], "low_days": [low]})

    return stream.groupBy("symbol").applyInPandasWithState(update, "symbol string, tier string, low_days int", "tier string, low_days int", "update", GroupStateTimeout.NoTimeout)


def tiers(rows: DataFrame) -> DataFrame:
    """The same state machine over a table (symbol, d, probability); one row for each of a symbol's days."""
    from tickloom.functions.recursive import grouped

    def run(days: pd.DataFrame) -> pd.DataFrame:
        state, found = ("observe", 0), []
        for p in days["probability"].tolist():
            state = next_tier(*state, p)
            found.append(state)
        days["tier"], days["low_days"] = zip(*found)
        return days

    return grouped(rows.select("symbol", "d", "probability"), run, "tier string, low_days int").drop("probability")


def pool_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of event types by the share of high values a day."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d")).agg(F.avg((F.col("value") > 50).cast("double")).alias("probability"))
    return tiers(rows)


QUERIES["pool_tiers"] = pool_tiers
SQL["pool_tiers"] = """WITH RECURSIVE r AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS d, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM events GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS rn FROM r),
 s AS (SELECT symbol, rn, d, CASE WHEN p >= 0.6::DOUBLE THEN 'active' ELSE 'observe' END AS tier, CASE WHEN p < 0.4::DOUBLE THEN 1 ELSE 0 END AS low FROM x WHERE rn = 1 UNION ALL
 SELECT x.symbol, x.rn, x.d, CASE WHEN x.p >= 0.6::DOUBLE THEN 'active' WHEN x.p < 0.4::DOUBLE AND s.low + 1 >= 5 THEN 'dormant' WHEN s.tier = 'dormant' AND x.p < 0.4::DOUBLE THEN 'dormant' WHEN s.tier = 'active' AND x.p >= 0.4::DOUBLE THEN 'active' ELSE 'observe' END,
 CASE WHEN x.p < 0.4::DOUBLE THEN s.low + 1 ELSE 0 END FROM s JOIN x ON x.symbol = s.symbol AND x.rn = s.rn + 1) SELECT symbol, d, tier, low AS low_days FROM s"""
