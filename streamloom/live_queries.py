"""Registered queries of live streams, of sinks and sources, and of added computations, with their SQL.

A live query reads the events table as a stream until its end; what the
watermark has closed by then is its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Session
from .model import as_json
from .operators.aggregates import AGGREGATES, register_aggregate
from .operators.ordered import deduplicate_stream
from .operators.routing import subscribers_of
from .plans.compiler import COMPUTATIONS, register_computation
from .sinks import log_stream, write_json_lines
from .sources.readers import events, json_line_stream, json_lines, replay_log, text_lines
from .streaming.finish import finished, shared_folder
from .streaming.stateful import linearize_stream

Query = Callable[[SparkSession, str], DataFrame]


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    Session.prepare(spark)
    return events(spark, f"{sf_dir}/events.parquet", streaming=True)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return events(spark, f"{sf_dir}/events.parquet")


def _values(records: DataFrame, *keys: str) -> DataFrame:
    return records.select("ts_ns", *keys, F.round("num", 6).alias("value"))


def _ids(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").cast("long").alias("id"), "ts_ns")


def live(text: str, watermark: str, *keys: str, fired: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = finished(Session(_live(spark, sf_dir)).query(text, watermark=watermark))
        return made.select("ts_ns", *keys) if fired else _values(made, *keys)

    return run


def _live_foo(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = finished(Session(_live(spark, sf_dir)).query("foo(value{event_type=purchase})"))
    return made.select("ts_ns", F.regexp_extract("data", r"state: (\d+)$", 1).cast("long").alias("n"))


def _live_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(finished(linearize_stream(_live(spark, sf_dir).withWatermark("ts", "1 hour"), ["topic"])))


def _live_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _live(spark, sf_dir).unionByName(_live(spark, sf_dir))
    return _ids(finished(deduplicate_stream(twice, "1 hour")))


def _log(spark: SparkSession, sf_dir: str, start_ns: int, stop_ns: int) -> DataFrame:
    """Live records into the log, and a range of the log."""
    folder = shared_folder(spark)
    log_stream(_live(spark, sf_dir), f"{folder}/log", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return _ids(replay_log(spark, f"{folder}/log", start_ns, stop_ns))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read again as a live stream."""
    folder = f"{shared_folder(spark)}/published"
    write_json_lines(_stored(spark, sf_dir), folder)
    Session.prepare(spark)
    back = finished(json_line_stream(spark, folder, fresh=False))
    return back.select(
        F.col("id").cast("long").alias("id"), "ts_ns", F.col("tags")["event_type"].alias("event_type"), F.round("num", 6).alias("value")
    )


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published records get ids and a watermark of their own; one without stream id or time is refused."""
    source = _stored(spark, sf_dir)
    folder = f"{shared_folder(spark)}/submitted"
    n = F.col("id").cast("long")
    odd = source.select(
        F.when(n % 10 == 0, F.regexp_replace(as_json(source), '"stream_id":"[^"]*"', '"stream_id":""'))
        .when(n % 10 == 1, F.regexp_replace(as_json(source), '"timestamp":[0-9]+', '"timestamp":0'))
        .when(n % 10 == 2, F.regexp_replace(as_json(source), r"value\{", "avg(value){"))
        .otherwise(as_json(source))
        .alias("value")
    )
    odd.write.text(folder)
    got = json_lines(spark, folder)
    return got.groupBy("topic").agg(
        F.countDistinct("id").alias("n"),
        F.min("ts_ns").alias("first_ns"),
        F.max((F.col("lwm_ns") < F.col("ts_ns")).cast("int")).alias("behind"),
        F.max(F.length("id")).cast("long").alias("id_length"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed text lines as payloads of raw records."""
    folder = f"{shared_folder(spark)}/lines"
    _stored(spark, sf_dir).select(F.concat(F.lit("  "), F.col("tags")["event_type"], F.lit("\t ")).alias("value")).write.text(folder)
    return text_lines(spark, folder, "typed{by=hand}").groupBy("stream_id", "topic", "data").agg(F.count(F.lit(1)).alias("n"))


def _relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A computation's records bear its own stream id."""
    session = Session(_stored(spark, sf_dir))
    made = [session.query(x).select("stream_id", "topic") for x in ("avg(value, 1h)", "bar(value{event_type=click})")]
    return made[0].unionAll(made[1]).groupBy("stream_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def _subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscribers that hear each of two publishers."""
    source = _stored(spark, sf_dir)
    tags = F.col("tags")
    asked = F.explode(
        F.array(
            F.lit("value"),
            F.lit("other"),
            F.concat(F.lit("value{user_id="), tags["user_id"], F.lit("}")),
            F.concat(F.lit("value{event_type="), tags["event_type"], F.lit(",absent=}")),
        )
    )
    subscribers = source.select(asked.alias("stream_id")).distinct()
    heard = [
        subscribers_of(subscribers, F.lit(p)).withColumn("publisher", F.lit(p))
        for p in ("value{event_type=error,user_id=7}", "value{event_type=view}")
    ]
    return heard[0].unionByName(heard[1])


def _added_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    if "spread" not in AGGREGATES:
        register_aggregate("spread", lambda v: F.max(v) - F.min(v))
    return _values(Session(_stored(spark, sf_dir)).query("match(value by event_type in spread(%s, 6h))"), "by_event_type")


def _added_computation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scaled(records: DataFrame, args: tuple[str, ...], keys: list[str]) -> DataFrame:
        num = F.col("num") * float(args[0])
        return records.withColumn("num", num).withColumn("data", num.cast("string"))

    if "scaled" not in COMPUTATIONS:
        register_computation("scaled", scaled)
    return _values(Session(_stored(spark, sf_dir)).query("sum(scaled(value, 3), 24h)"))


def catalog(bucket_sql: Callable[[str, str], str], agg_sql: Callable[..., str], start_us: int) -> dict[str, tuple[Query, str]]:
    """Each query with its SQL; the arguments spell buckets in SQL."""
    us, hour = "epoch_us(ts)", 3_600_000_000
    newest = "(SELECT max(epoch_us(ts)) // 1000 FROM events)"
    low, high = start_us + 48 * hour, start_us + 96 * hour

    def closed(sql: str, half_us: int, delay_ms: int) -> str:
        """Buckets whose end the watermark has reached; it counts whole milliseconds."""
        return f"SELECT * FROM ({sql}) WHERE ts_ns // 1000 + {half_us} <= ({newest} - {delay_ms}) * 1000"

    return {
        "live_avg": (live("avg(value, 1h)", "30 minutes"), closed(agg_sql("avg(value)", "1h"), hour // 2, 1_800_000)),
        "live_count": (live("count(value{event_type=click}, 7s)", "10 seconds"), f"""
            SELECT * FROM ({agg_sql("count(*)", "7s", "event_type = 'click'")})
            WHERE ts_ns // 1000 + 3500000 <= ((SELECT max({us}) // 1000 FROM events WHERE event_type = 'click') - 10000) * 1000"""),
        "live_nested": (
            live("max(avg(value, 1h), 24h)", "0 seconds"),
            closed(
                f"""WITH h AS (SELECT {bucket_sql(us, "1h")} AS b, avg(value) AS v FROM events GROUP BY 1)
                SELECT {bucket_sql("b", "24h")} * 1000 AS ts_ns, round(max(v), 6) AS value FROM h GROUP BY 1""",
                12 * hour + hour // 2 - 1,
                0,
            ),
        ),
        "live_match": (
            live("match(value by event_type in sum(%s, 24h))", "12 hours", "by_event_type"),
            closed(agg_sql("sum(value)", "24h", keys="event_type AS by_event_type"), 12 * hour, 12 * 3_600_000),
        ),
        "live_alarm": (
            live("alarm(value{event_type=error} > 20 times 2)", "0 seconds", fired=True),
            f"""SELECT ts_ns FROM (
              SELECT {us} * 1000 AS ts_ns, value, lag(value) OVER w AS p, max({us} // 1000) OVER () AS newest
              FROM events WHERE event_type = 'error' WINDOW w AS (ORDER BY ts, event_id::VARCHAR))
            WHERE value > 20 AND p > 20 AND ts_ns // 1000000 + 1 <= newest""",
        ),
        "live_match_alarm": (
            live("match(value by user_id in alarm(%s > 20 times 2))", "0 seconds", "by_user_id", fired=True),
            f"""SELECT ts_ns, by_user_id FROM (
              SELECT {us} * 1000 AS ts_ns, user_id::VARCHAR AS by_user_id, value,
                     lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS p FROM events)
            WHERE value > 20 AND p > 20 AND ts_ns // 1000000 + 1 <= {newest}""",
        ),
        "live_foo": (
            _live_foo,
            f"SELECT {us} * 1000 AS ts_ns, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS n "
            "FROM events WHERE event_type = 'purchase'",
        ),
        "live_linearize": (
            _live_linearize,
            f"SELECT event_id AS id, {us} * 1000 AS ts_ns FROM events WHERE {us} // 1000 + 1 <= {newest} - 3600000",
        ),
        "live_dedup": (_live_dedup, f"SELECT event_id AS id, {us} * 1000 AS ts_ns FROM events"),
        "log_replay": (
            lambda spark, sf_dir: _log(spark, sf_dir, low * 1000, high * 1000),
            f"SELECT event_id AS id, {us} * 1000 AS ts_ns FROM events WHERE {us} >= {low} AND {us} < {high}",
        ),
        "live_json_lines": (
            _published,
            f"SELECT event_id AS id, {us} * 1000 AS ts_ns, event_type, round(value, 6) AS value FROM events",
        ),
        "submitted_records": (
            _fresh,
            f"SELECT 'value' AS topic, count(*) AS n, min({us}) * 1000 AS first_ns, 0 AS behind, 36::BIGINT AS id_length "
            "FROM events WHERE event_id % 10 > 2",
        ),
        "text_lines": (
            _lines,
            "SELECT 'typed{by=hand}' AS stream_id, 'typed' AS topic, event_type AS data, count(*) AS n FROM events GROUP BY ALL",
        ),
        "relabel": (
            _relabel,
            f"""SELECT 'avg(value, 1h)' AS stream_id, 'avg(value, 1h)' AS topic, count(DISTINCT {bucket_sql(us, "1h")}) AS n FROM events
            UNION ALL SELECT 'bar(value{{event_type=click}})', 'bar(value{{event_type=click}})', count(*)
            FROM events WHERE event_type = 'click'""",
        ),
        "subscribers": (
            _subscribers,
            """SELECT * FROM (VALUES
              ('value', 'value{event_type=error,user_id=7}'), ('value{user_id=7}', 'value{event_type=error,user_id=7}'),
              ('value{event_type=error,absent=}', 'value{event_type=error,user_id=7}'),
              ('value', 'value{event_type=view}'), ('value{event_type=view,absent=}', 'value{event_type=view}')
            ) AS t(stream_id, publisher)""",
        ),
        "alarm_match_by": (
            lambda spark, sf_dir: Session(_stored(spark, sf_dir))
            .query("alarm(value{event_type=error} > 20 times 2, user_id)")
            .select("ts_ns", "by_user_id"),
            f"""SELECT ts_ns, by_user_id FROM (
              SELECT {us} * 1000 AS ts_ns, user_id::VARCHAR AS by_user_id, value,
                     lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS p
              FROM events WHERE event_type = 'error') WHERE value > 20 AND p > 20""",
        ),
        "added_aggregate": (
            _added_aggregate,
            agg_sql("max(value) - min(value)", "6h", keys="event_type AS by_event_type"),
        ),
        "added_computation": (_added_computation, agg_sql("sum(value * 3)", "24h")),
    }
