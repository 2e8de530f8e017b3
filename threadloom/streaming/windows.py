"""Event streams: windows with watermarks, duplicates and stream-static joins, drained into a table.

``drained`` runs a stream over the files there are and returns what its sink holds;
the sink and its checkpoint lie in the shared folder, so a restart goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.streaming import state
from threadloom.streaming.folders import new_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, at: str | None = None) -> DataFrame:
    """What the sink under ``at`` (a new folder by default) holds after all there is; the same folder again goes on where it stopped."""
    spark = df.sparkSession
    at = at or new_folder(spark, "stream")
    df.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{at}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def win_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type, as far as the watermark has closed the days."""
    day = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(day.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct event ids."""
    return drained(event_stream(spark, sf_dir).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))


def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their customer's segment."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return drained(event_stream(spark, sf_dir).where("event_type = 'purchase'").join(customers, "user_id").select("event_id", "c_mktsegment"))


def win_stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that have closed by the watermark."""
    closed = state.sessions(event_stream(spark, sf_dir), "user_id", "ts", "6 hours", "1 hour")
    return drained(closed.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"))


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the clicks of the same user up to two hours before."""
    e = event_stream(spark, sf_dir)
    clicks, bought = (e.where(F.col("event_type") == t).select("event_id", "user_id", "ts") for t in ("click", "purchase"))
    found = state.within(clicks, bought, "user_id", "ts", "2 hours", "1 hour", "3 hours")
    return drained(found.select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("purchase")))


def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, their events as heartbeats: signing up ends one, ten hours without an event stop one."""
    e = event_stream(spark, sf_dir).select("user_id", "ts", F.when(F.col("event_type") == "signup", "done").otherwise("running").alias("status"))
    ended = state.followed(e, "user_id", "ts", "status", 10 * 3_600_000)
    with state.kept_in_rocksdb(spark):
        return drained(ended.select(F.col("job").alias("user_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "status", "detail"))


QUERIES = {f.__name__: f for f in (win_stream_tumbling, stream_dedup, stream_static_join, win_stream_session, stream_interval_join, stream_heartbeats)}
ORACLE_SQL = {
    "win_stream_session": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, nth HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_interval_join": "SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR",
    "stream_heartbeats": """WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'signup' DESC, event_id) AS next FROM events)
        SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'done' AS status, NULL::VARCHAR AS detail FROM n WHERE event_type = 'signup'
        UNION ALL SELECT user_id, strftime(ts + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S'), 'stopped', 'stale — process gone' FROM n WHERE event_type <> 'signup' AND (next - ts > INTERVAL 10 HOUR OR (next IS NULL AND ts + INTERVAL 10 HOUR <= (SELECT max(ts) FROM events)))""",

    "win_stream_tumbling": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_dedup": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_static_join": "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'",
}
