"""Registered queries: one for each operator, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Session
from .functions.buckets import ORIGIN_NS
from .functions.durations import parse_duration
from .functions.tags import printed, tags_of
from .live_queries import catalog
from .model import as_json, records_from_json
from .operators.late import drop_late
from .operators.ordered import deduplicate, numbered
from .operators.routing import combinations, publishers
from .plans.expr import Raw
from .sinks import render
from .sources.readers import events, in_range, order_prices

Query = Callable[[SparkSession, str], DataFrame]

START_US = 1_704_067_200_000_000  # 2024-01-01
HOUR_US = 3_600_000_000


def _session(spark: SparkSession, sf_dir: str) -> Session:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Session(events(spark, f"{sf_dir}/events.parquet"))


def _numbers(records: DataFrame, *keys: str) -> DataFrame:
    return records.select("ts_ns", *keys, F.round("num", 6).alias("value"))


def _expression(text: str, *keys: str, **options) -> Query:
    return lambda spark, sf_dir: _numbers(_session(spark, sf_dir).query(text, **options), *keys)


def _bucket_sql(ts: str, period: str) -> str:
    d = parse_duration(period) // 1000
    r = f"(({ts} + {ORIGIN_NS // 1000}) % {d})"
    return f"(CASE WHEN 2 * {r} < {d} THEN {ts} - {r} ELSE {ts} + {d} - {r} END)"


def _agg_sql(agg: str, period: str, where: str = "true", keys: str = "") -> str:
    b = _bucket_sql("epoch_us(ts)", period)
    cols = f", {keys}" if keys else ""
    return (
        f"SELECT {b} * 1000 AS ts_ns{cols}, round({agg}::DOUBLE, 6) AS value FROM events WHERE {where} "
        f"GROUP BY {b}{', ' + keys.split(' AS ')[0] if keys else ''}"
    )


def _bad_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third payload is no number and counts as zero."""
    session = _session(spark, sf_dir)
    bad = F.pmod(F.col("id").cast("long"), F.lit(3)) == 0
    broken = session.source.withColumn("data", F.when(bad, F.lit("n/a")).otherwise(F.col("data"))).withColumn(
        "num", F.lit(None).cast("double")
    )
    return _numbers(Session(broken).query("avg(value, 1h)"))


def _ids(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").cast("long").alias("id"), "ts_ns")


def _tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(_session(spark, sf_dir).query("value{event_type=click}"))


def _tag_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(_session(spark, sf_dir).query("value{user_id=7,event_type=view}"))


def _tag_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream ids parsed to tags and printed again, with record counts."""
    source = _session(spark, sf_dir).source
    again = printed(F.col("topic"), tags_of(F.col("stream_id")))
    return source.groupBy(again.alias("stream_id")).agg(F.count(F.lit(1)).alias("n"))


def _publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishers(_session(spark, sf_dir).source, Raw("value", (("event_type", "error"),)))


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, stop = (START_US + 48 * HOUR_US) * 1000, (START_US + 96 * HOUR_US) * 1000
    return _ids(in_range(_session(spark, sf_dir).source, start, stop))


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records published twice, less those of the first day as already seen."""
    source = _session(spark, sf_dir).source
    seen = in_range(source, None, (START_US + 24 * HOUR_US) * 1000)
    return _ids(deduplicate(source.unionByName(source), seen))


def _linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each record in the time order of its event type."""
    source = _session(spark, sf_dir).source.withColumn("event_type", F.col("tags")["event_type"])
    return numbered(source, ["event_type"], "place").select(
        F.col("id").cast("long").alias("id"), "event_type", F.col("place").cast("long").alias("place")
    )


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth record arrives 50 records too late and is dropped."""
    source = _session(spark, sf_dir).source.withColumn("n", F.col("id").cast("long"))
    arrival = F.when(F.col("n") % 10 == 0, F.col("n") * 100 + 5000 + 1).otherwise(F.col("n") * 100)
    return _ids(drop_late(source.withColumn("arrival", arrival), "arrival", []))


def _foo(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _session(spark, sf_dir).query("foo(value{event_type=purchase})")
    return made.select("ts_ns", F.regexp_extract("data", r"state: (\d+)$", 1).cast("long").alias("n"))


def _bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _session(spark, sf_dir).source.withColumn("data", F.col("tags")["event_type"])
    return Session(source).query("bar(value)").select(F.col("id").cast("long").alias("id"), "data")


def _fired(text: str, *keys: str) -> Query:
    return lambda spark, sf_dir: _session(spark, sf_dir).query(text).select("ts_ns", *keys)


def _alarm_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _session(spark, sf_dir).query("alarm(value{event_type=error} > 20 times 2)")
    told = F.transform(F.element_at("values", "value{event_type=error}"), lambda v: F.round(v, 6).cast("string"))
    return made.select("ts_ns", F.array_join(told, " ").alias("told"))


def _alarm_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics from two tables under one condition."""
    session = _session(spark, sf_dir).publish(order_prices(spark, f"{sf_dir}/orders.parquet"))
    return session.query("alarm(value{event_type=error} > 60 and price{status=F} > 200000)").select("ts_ns")


def _match_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of two topics for each user."""
    text = (
        "match(value{event_type=click}, value{event_type=view} by user_id in "
        "alarm(count(%s, 7d) > 2 and sum(%s, 7d) > 60))"
    )
    return _session(spark, sf_dir).query(text).select("ts_ns", "by_user_id")


def _combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinations(_session(spark, sf_dir).source, [Raw("value")], ["event_type", "user_id"])


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to their published form and back."""
    source = _session(spark, sf_dir).source
    back = records_from_json(source.select(as_json(source).alias("j")), F.col("j"), fresh=False)
    return back.select(
        F.col("id").cast("long").alias("id"),
        "ts_ns",
        "topic",
        F.col("tags")["event_type"].alias("event_type"),
        F.round("num", 6).alias("value"),
    )


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _session(spark, sf_dir).source.withColumn("data", F.col("tags")["event_type"])
    return render(source, data_only=True).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


_US = "epoch_us(ts)"
_HOURLY = f"SELECT {_bucket_sql(_US, '1h')} AS b, event_type, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL"


def _queries() -> dict[str, tuple[Query, str | None]]:
    error_avg = "avg(value{event_type=error}, 1h)"
    return {
        "bucket_avg": (_expression("avg(value, 1h)"), _agg_sql("avg(value)", "1h")),
        "bucket_sum": (_expression("sum(value, 5min)"), _agg_sql("sum(value)", "5m")),
        "bucket_min": (_expression("min(value, 1h30m)"), _agg_sql("min(value)", "1h30m")),
        "bucket_max": (_expression("max(value, 10sec)"), _agg_sql("max(value)", "10s")),
        "bucket_count": (_expression("count(value, 7s)"), _agg_sql("count(*)", "7s")),
        "bucket_week": (_expression("avg(value, 168h)"), _agg_sql("avg(value)", "168h")),
        "bucket_avg_bad_payload": (
            _bad_payload,
            _agg_sql("avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END)", "1h"),
        ),
        "closed_buckets": (
            _expression("sum(value, 24h)", closed_only=True),
            f"SELECT * FROM ({_agg_sql('sum(value)', '24h')}) "
            "WHERE ts_ns + 86400000000000 < (SELECT max(epoch_us(ts)) * 1000 FROM events)",
        ),
        "nested_max_avg": (
            _expression("max(avg(value, 1h), 24h)"),
            f"""WITH a AS (SELECT b, avg(v * n) / avg(n) AS v FROM ({_HOURLY}) GROUP BY b),
            h AS (SELECT {_bucket_sql(_US, "1h")} AS b, avg(value) AS v FROM events GROUP BY 1)
            SELECT {_bucket_sql("b", "24h")} * 1000 AS ts_ns, round(max(v), 6) AS value FROM h GROUP BY 1""",
        ),
        "tag_filter": (
            _tag_filter,
            f"SELECT event_id AS id, {_US} * 1000 AS ts_ns FROM events WHERE event_type = 'click'",
        ),
        "tag_subset": (
            _tag_subset,
            f"SELECT event_id AS id, {_US} * 1000 AS ts_ns FROM events WHERE event_type = 'view' AND user_id = 7",
        ),
        "tag_print": (
            _tag_print,
            "SELECT 'value{event_type=' || event_type || ',user_id=' || user_id || '}' AS stream_id, "
            "count(*) AS n FROM events GROUP BY 1",
        ),
        "publishers": (
            _publishers,
            "SELECT DISTINCT 'value{event_type=error,user_id=' || user_id || '}' AS stream_id FROM events "
            "WHERE event_type = 'error'",
        ),
        "combinations": (
            _combinations,
            "SELECT DISTINCT event_type AS by_event_type, user_id::VARCHAR AS by_user_id FROM events",
        ),
        "replay_range": (
            _replay,
            f"SELECT event_id AS id, {_US} * 1000 AS ts_ns FROM events "
            f"WHERE {_US} >= {START_US + 48 * HOUR_US} AND {_US} < {START_US + 96 * HOUR_US}",
        ),
        "dedup_id": (
            _dedup,
            f"SELECT event_id AS id, {_US} * 1000 AS ts_ns FROM events WHERE {_US} >= {START_US + 24 * HOUR_US}",
        ),
        "linearize": (
            _linearize,
            "SELECT event_id AS id, event_type, row_number() OVER (PARTITION BY event_type "
            "ORDER BY ts, event_id::VARCHAR) AS place FROM events",
        ),
        "late_records": (
            _late,
            f"""WITH a AS (SELECT event_id AS id, {_US} * 1000 AS ts_ns,
              CASE WHEN event_id % 10 = 0 THEN event_id * 100 + 5001 ELSE event_id * 100 END AS arrival FROM events)
            SELECT id, ts_ns FROM (SELECT *, max(ts_ns) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING) AS mark FROM a) WHERE mark IS NULL OR ts_ns >= mark""",
        ),
        "foo_map": (
            _foo,
            f"SELECT {_US} * 1000 AS ts_ns, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS n "
            "FROM events WHERE event_type = 'purchase'",
        ),
        "bar_map": (_bar, "SELECT event_id AS id, 'barized: ' || event_type AS data FROM events"),
        "json_round_trip": (
            _json,
            f"SELECT event_id AS id, {_US} * 1000 AS ts_ns, 'value' AS topic, event_type, round(value, 6) AS value "
            "FROM events",
        ),
        "printer": (_printed, "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1"),
        "alarm_single": (
            _fired("alarm(value{event_type=error} > 60)"),
            f"SELECT {_US} * 1000 AS ts_ns FROM events WHERE event_type = 'error' AND value > 60",
        ),
        "alarm_times": (
            _alarm_values,
            f"""SELECT ts_ns, round(p, 6)::VARCHAR || ' ' || round(value, 6)::VARCHAR AS told FROM (
              SELECT {_US} * 1000 AS ts_ns, value, lag(value) OVER (ORDER BY ts, event_id::VARCHAR) AS p
              FROM events WHERE event_type = 'error') WHERE value > 20 AND p > 20""",
        ),
        "alarm_and_or": (
            _fired(
                "alarm(value{event_type=error} > 60 or value{event_type=click} <= 5 times 2 "
                "and value{event_type=view} < 3)"
            ),
            f"""WITH e AS (
              SELECT {_US} * 1000 AS ts_ns, ts, event_id, event_type, value,
                     lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR) AS p
              FROM events WHERE event_type IN ('error', 'click', 'view')
            ), s AS (
              SELECT ts_ns,
                last_value(CASE WHEN event_type = 'error' THEN value > 60 END IGNORE NULLS) OVER w AS a,
                last_value(CASE WHEN event_type = 'click' THEN coalesce(value <= 5 AND p <= 5, false) END IGNORE NULLS)
                  OVER w AS b,
                last_value(CASE WHEN event_type = 'view' THEN value < 3 END IGNORE NULLS) OVER w AS c
              FROM e WINDOW w AS (ORDER BY ts, event_id::VARCHAR ROWS UNBOUNDED PRECEDING)
            ) SELECT ts_ns FROM s WHERE coalesce(a, false) OR (coalesce(b, false) AND coalesce(c, false))""",
        ),
        "alarm_over_avg": (
            _fired(f"alarm({error_avg} > 20 times 2 and count(value{{event_type=error}}, 1h) >= 3)"),
            f"""WITH h AS (SELECT b, v, n, lag(v) OVER (ORDER BY b) AS p FROM ({_HOURLY}) WHERE event_type = 'error'),
            u AS (
              SELECT b, 0 AS k, v > 20 AND coalesce(p > 20, false) AS a, NULL::BOOLEAN AS c FROM h
              UNION ALL SELECT b, 1, NULL, n >= 3 FROM h
            ), s AS (
              SELECT b, last_value(a IGNORE NULLS) OVER w AS a, last_value(c IGNORE NULLS) OVER w AS c
              FROM u WINDOW w AS (ORDER BY b, k ROWS UNBOUNDED PRECEDING)
            ) SELECT b * 1000 AS ts_ns FROM s WHERE coalesce(a, false) AND coalesce(c, false)""",
        ),
        "alarm_two_topics": (
            _alarm_topics,
            f"""WITH u AS (
              SELECT {_US} AS t, event_id::VARCHAR AS id, 1 AS k, value > 60 AS a, NULL::BOOLEAN AS c
              FROM events WHERE event_type = 'error'
              UNION ALL SELECT epoch_us(o_orderdate), o_orderkey::VARCHAR, 0, NULL, o_totalprice > 200000
              FROM orders WHERE o_orderstatus = 'F'
            ), s AS (
              SELECT t, last_value(a IGNORE NULLS) OVER w AS a, last_value(c IGNORE NULLS) OVER w AS c
              FROM u WINDOW w AS (ORDER BY t, id, k ROWS UNBOUNDED PRECEDING)
            ) SELECT t * 1000 AS ts_ns FROM s WHERE coalesce(a, false) AND coalesce(c, false)""",
        ),
        "match_avg": (
            _expression("match(value by event_type in avg(%s, 1h))", "by_event_type"),
            _agg_sql("avg(value)", "1h", keys="event_type AS by_event_type"),
        ),
        "match_alarm": (
            _fired("match(value by user_id in alarm(%s > 20 times 2))", "by_user_id"),
            f"""SELECT ts_ns, by_user_id FROM (
              SELECT {_US} * 1000 AS ts_ns, user_id::VARCHAR AS by_user_id, value,
                     lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS p FROM events)
            WHERE value > 20 AND p > 20""",
        ),
        "match_two_topics": (
            _match_topics,
            f"""WITH g AS (
              SELECT {_bucket_sql(_US, "7d")} AS b, user_id::VARCHAR AS u, event_type, count(*) AS n, sum(value) AS v
              FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL
            ), m AS (
              SELECT b, u, 0 AS k, n > 2 AS a, NULL::BOOLEAN AS c FROM g WHERE event_type = 'click'
              UNION ALL SELECT b, u, 1, NULL, v > 60 FROM g WHERE event_type = 'view'
            ), s AS (
              SELECT b, u, last_value(a IGNORE NULLS) OVER w AS a, last_value(c IGNORE NULLS) OVER w AS c
              FROM m WINDOW w AS (PARTITION BY u ORDER BY b, k ROWS UNBOUNDED PRECEDING)
            ) SELECT b * 1000 AS ts_ns, u AS by_user_id FROM s WHERE coalesce(a, false) AND coalesce(c, false)""",
        ),
        **catalog(_bucket_sql, _agg_sql, START_US),
    }


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _queries().items() if sql}
