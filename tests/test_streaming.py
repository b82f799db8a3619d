import io
import json
import os
import random
import subprocess
import sys
import time
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamloom import Session
from streamloom.model import HEARTBEAT, JSON_SCHEMA, RECORD_COLUMNS
from streamloom.operators.ordered import deduplicate, deduplicate_stream
from streamloom.sinks import fan_out, log_stream
from streamloom.sources import (
    Publisher,
    events,
    json_line_stream,
    json_lines,
    produced,
    rate,
    register_producer,
    replay_log,
    with_heartbeat,
)
from streamloom.streaming.manager import LateRecord, Manager, Metrics
from streamloom.streaming import stateful
from streamloom.streaming.ordering import in_order
from streamloom.streaming.stateful import linearize_stream

from .helpers import NS, START, seconds
from .test_batch import SERIES

assert JSON_SCHEMA


def feed(path, n, rows):
    """One file of published records: (stream id, second, value)."""
    path.mkdir(exist_ok=True)
    lines = [
        json.dumps({"id": f"{n}-{i}", "stream_id": s, "timestamp": (START + t) * NS, "lwm": (START + t) * NS, "data": v})
        for i, (s, t, v) in enumerate(rows)
    ]
    file = path / f"{n:03d}.json"
    file.write_text("\n".join(lines))
    os.utime(file, (START + n, START + n))  # the file source reads in the order of these times


def live(spark, path):
    rows = spark.readStream.option("maxFilesPerTrigger", 1).text(str(path))
    from streamloom.model import records_from_json

    return records_from_json(rows, F.col("value"), fresh=False)


def drain(records, tmp_path, name):
    """Run a live query over all that is there; its records in the order of release."""
    got = []

    def take(batch, _):
        got.extend(batch.select([c for c in RECORD_COLUMNS if c != "tags"]).collect())

    query = fan_out(records, [take], str(tmp_path / f"cp-{name}"), availableNow=True)
    query.awaitTermination()
    return got


def test_windows_close_with_the_watermark(spark, tmp_path):
    for n, (t, v) in enumerate(SERIES):
        feed(tmp_path / "in", n, [("s", t, v)])
    records = Session(live(spark, tmp_path / "in")).query("avg(s, 10s)", watermark="5 seconds")
    got = sorted((seconds(r.ts_ns), r.num) for r in drain(records, tmp_path, "avg"))
    assert [t for t, _ in got] == [0, 10, 30]
    assert [v for _, v in got] == pytest.approx([2.0, 35 / 3, 7.0])


def test_stream_equals_batch_on_closed_buckets_nested(spark, tmp_path):
    rows = [("s", t, t % 17) for t in range(0, 400, 3)]
    for n in range(0, len(rows), 20):
        feed(tmp_path / "in", n, rows[n : n + 20])
    expression = "max(sum(s, 10s), 60s)"
    records = Session(live(spark, tmp_path / "in")).query(expression, watermark="0 seconds")
    got = {seconds(r.ts_ns): r.num for r in drain(records, tmp_path, "nest")}
    static = spark.read.text(str(tmp_path / "in"))
    from streamloom.model import records_from_json

    whole = Session(records_from_json(static, F.col("value"), fresh=False)).query(expression)
    want = {seconds(r.ts_ns): r.num for r in whole.collect()}
    assert len(got) >= 5
    assert all(want[t] == v for t, v in got.items())


def test_foo_counts_on_after_a_restart(spark, tmp_path):
    feed(tmp_path / "in", 0, [("t", i, str(i)) for i in (1, 2, 3)])
    session = Session(live(spark, tmp_path / "in"))
    first = drain(session.query("foo(t)"), tmp_path, "foo")
    feed(tmp_path / "in", 1, [("t", i, str(i)) for i in (4, 5)])
    again = drain(Session(live(spark, tmp_path / "in")).query("foo(t)"), tmp_path, "foo")
    assert [r.data for r in first + again] == [f"fooized: {n}, state: {n}" for n in range(1, 6)]


def test_linearizer_releases_in_order(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", 3, 1), ("s", 1, 2), ("s", 2, 3)])
    feed(tmp_path / "in", 1, [("s", 9, 4)])
    feed(tmp_path / "in", 2, [("s", 12, 5)])
    rows = live(spark, tmp_path / "in").withWatermark("ts", "1 second")
    got = [seconds(r.ts_ns) for r in drain(linearize_stream(rows), tmp_path, "lin")]
    assert got[:3] == [1, 2, 3]
    assert got == sorted(got)


def test_sorted_runs_lose_nothing():
    """Runs and pieces far smaller than the rows, equal keys and nulls."""
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "é", "\U0001f600"]), n) for n in range(3000)]
    tables = [pa.table({"t": [r[0] for r in x], "id": [r[1] for r in x], "n": [r[2] for r in x]}) for x in (rows[:900], [], rows[900:])]
    tables = [t.cast(tables[0].schema) for t in tables]
    want = sorted(rows, key=lambda r: [(v is None, v) for v in r])
    for run_bytes in (1, 10_000, 1 << 20):
        got = list(in_order(tables, ["t", "id", "n"], run_bytes, 500))
        assert [tuple(r.values()) for t in got for r in t.to_pylist()] == want
    assert list(in_order([], ["t"])) == []


def test_foo_hands_on_frames_in_order(spark, tmp_path):
    """The counter's output leaves it in parts, over runs on disk; null times stay null and exact beside whole ones."""
    frames = [pd.DataFrame({"ts_ns": [str(n * 7919 % 500) for n in range(k, k + 100)], "id": [str(n) for n in range(k, k + 100)], "data": "x"}) for k in range(0, 30_000, 100)]

    class State:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, kept):
            self.kept = kept

    counter = stateful._Counter(["ts_ns", "id", "data"], None)
    counter.n = State()
    out = list(counter.handleInputRows(("",), iter(frames), None))
    assert max(map(len, out)) <= stateful.FRAME_ROWS and counter.n.kept == (30_000,)
    whole = pd.concat(out)
    want = sorted((n * 7919 % 500, str(n)) for n in range(30_000))
    assert list(whole["id"]) == [f"foo:{i}" for _, i in want]
    assert list(whole["data"]) == [f"fooized: x, state: {n}" for n in range(1, 30_001)]
    feed(tmp_path / "in", 0, [("s", t, t) for t in (2, 3, 1)])
    rows = live(spark, tmp_path / "in").withColumn("ts_ns", F.when(F.col("num") != 2, F.col("ts_ns") + 1))
    got = drain(Session(rows).query("foo(s)"), tmp_path, "null")
    assert [(r.ts_ns, r.data, r.num) for r in got] == [
        ((START + 1) * NS + 1, "fooized: 1, state: 1", None),
        ((START + 3) * NS + 1, "fooized: 3, state: 2", None),
        (None, "fooized: 2, state: 3", None),
    ]


def test_linearizer_spreads_one_stream(spark, tmp_path):
    """A single stream waits in the state of many tasks; a record without time waits for nothing and breaks nothing."""
    feed(tmp_path / "in", 0, [("s", (t * 7919) % 5000, t) for t in range(5000)])
    rows = live(spark, tmp_path / "in").withColumn("id", F.concat("id", F.lit("é")))
    rows = rows.withColumn("ts_ns", F.when(F.col("num") != 3, F.col("ts_ns"))).withWatermark("ts", "1 second")
    held = linearize_stream(rows)
    got = []
    query = fan_out(held, [lambda b, _: got.extend(b.drop("tags").collect())], str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    assert len(got) == 4997 and [r.ts_ns for r in got] == sorted(r.ts_ns for r in got)
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(state) > 4000  # no value of the state holds more than a few records


def test_alarm_over_live_streams(spark, tmp_path):
    rows = [("a", 0, 20), ("b", 1, 1), ("b", 2, 1), ("a", 3, 1), ("b", 4, 1), ("a", 60, 1)]
    for n, r in enumerate(rows):
        feed(tmp_path / "in", n, [r])
    records = Session(live(spark, tmp_path / "in")).query("alarm(a > 15 and b < 2)", watermark="0 seconds")
    got = drain(records, tmp_path, "alarm")
    assert sorted(seconds(r.ts_ns) for r in got) == [1, 2]
    assert got[0].data.endswith("fired with values map[a:[20.0] b:[1.0]]")


@pytest.mark.parametrize("expression", ["alarm(s > 5 times 2)", "match(s by k in alarm(%s > 5 times 2))"])
def test_alarm_inputs_wait_in_many_states(spark, tmp_path, expression):
    """Records of one key wait spread out, each alone; one without time is passed over."""
    feed(tmp_path / "in", 0, [("s{k=a}", (t * 7919) % 3000, t % 10) for t in range(3000)] + [("s{k=a}", 1, 77)])
    rows = live(spark, tmp_path / "in").withColumn("ts_ns", F.when(F.col("num") != 77, F.col("ts_ns")))
    records = Session(rows).query(expression, watermark="0 seconds")
    got = []
    query = fan_out(records, [lambda b, _: got.extend(b.drop("tags").collect())], str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    values = dict(((t * 7919) % 3000, t % 10) for t in range(3000))
    assert sorted(seconds(r.ts_ns) for r in got) == [t for t in range(1, 2999) if values[t] > 5 and values[t - 1] > 5]
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(state) > 2500


def test_dedup_live(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", 1, 1), ("s", 2, 1)])
    rows = live(spark, tmp_path / "in").withWatermark("ts", "1 minute")
    twice = rows.union(rows)
    got = drain(twice.dropDuplicatesWithinWatermark(["id"]), tmp_path, "dedup")
    assert len(got) == 2
    assert deduplicate(spark.read.text(str(tmp_path / "in")).withColumn("id", F.lit(1))).count() == 1


def test_dedup_within_the_watermark(spark, tmp_path):
    rows = [("s", 1, 1), ("s", 2, 1), ("s", 3, 1)]
    for n in range(3):
        feed(tmp_path / "in", 0, rows[: n + 1])
        os.rename(tmp_path / "in" / "000.json", tmp_path / "in" / f"{n}.json")
    assert json_lines(spark, str(tmp_path / "in"), fresh=False).count() == 6
    got = drain(deduplicate_stream(live(spark, tmp_path / "in"), "1 minute"), tmp_path, "within")
    assert sorted(r.id for r in got) == ["0-0", "0-1", "0-2"]


def static(spark, path):
    return json_lines(spark, str(path), fresh=False)


@pytest.mark.parametrize(
    "expression",
    [
        "match(value by user_id in alarm(%s > 20 times 2))",
        "match(value by user_id in max(foo(%s), 1m))",
        "match(value by user_id in avg(bar(%s), 1m))",
        "match(value by user_id in foo(avg(%s, 10s)))",
        "max(foo(avg(value, 10s)), 1m)",
        "avg(bar(avg(value,10s)),1m)",
        "avg(bar(value{user_id=1}), 30s)",
        "alarm(avg(value, 10s) > 15 and value > 25)",
        "alarm(value{user_id=1} > 20 and value{user_id=2} < 30 times 2)",
    ],
)
def test_live_equals_batch(spark, tmp_path, expression):
    """Live records, keys and times are those of the batch, as far as the watermark has come."""
    rng = random.Random(expression)
    rows = [(f"value{{user_id={rng.randrange(3)}}}", t, float(rng.randrange(40))) for t in range(600)]
    for n in range(0, 600, 75):
        feed(tmp_path / "in", n, rows[n : n + 75])
    keys = ["by_user_id"] if expression.startswith("match") else []
    records = Session(live(spark, tmp_path / "in")).query(expression, watermark="2 seconds")
    assert [c for c in records.columns if c not in RECORD_COLUMNS] == keys
    got = []
    query = fan_out(records, [lambda b, _: got.extend(b.drop("tags").collect())], str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    batch = Session(static(spark, tmp_path / "in")).query(expression).collect()

    def rows_of(found):
        return Counter((*[r[k] for k in keys], r.ts_ns, r.data, r.num) for r in found)

    seen, want = rows_of(got), rows_of(batch)
    assert len(seen) > 3 and seen <= want
    last = min(max(r.ts_ns for r in got if all(r[k] == v for k in keys)) for v in ("0", "1", "2"))
    assert all(n == seen[x] for x, n in want.items() if x[len(keys)] < last)


def test_alarm_goes_on_after_a_restart(spark, tmp_path):
    text = "alarm(a > 15 times 3 and b < 2)"
    rows = [("a", 0, 20), ("b", 1, 1), ("a", 2, 20), ("a", 3, 20), ("a", 9, 30), ("a", 10, 1), ("a", 20, 50), ("a", 21, 50)]
    rows += [("a", 22, 50), ("b", 23, 5), ("b", 24, 0), ("a", 60, 0), ("b", 61, 5), ("a", 62, 0)]
    got = []
    for n, r in enumerate(rows):
        feed(tmp_path / "in", n, [r])
        if n in (3, 6, 8, 13):  # a new query over the same checkpoint
            got += drain(Session(live(spark, tmp_path / "in")).query(text, watermark="0 seconds"), tmp_path, "restart")
    batch = Session(static(spark, tmp_path / "in")).query(text).collect()
    assert sorted((r.ts_ns, r.data) for r in got) == sorted((r.ts_ns, r.data) for r in batch)
    assert [seconds(r.ts_ns) for r in sorted(got, key=lambda r: r.ts_ns)] == [3, 9, 22, 24]


def test_heartbeats_close_a_silent_stream(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", 1, 4), ("s", 2, 6)])
    quiet = drain(Session(live(spark, tmp_path / "in")).query("avg(s, 10s)", watermark="0 seconds"), tmp_path, "quiet")
    assert quiet == []
    feed(tmp_path / "in", 1, [(HEARTBEAT, 60, 0)])
    for expression in ("avg(s, 10s)", "alarm(s > 5)"):
        records = Session(live(spark, tmp_path / "in")).query(expression, watermark="0 seconds")
        got = drain(records, tmp_path, f"beat-{expression[:3]}")
        assert [(seconds(r.ts_ns), r.num) for r in got] == ([(0, 5.0)] if "avg" in expression else [(2, None)])
    assert with_heartbeat(live(spark, tmp_path / "in")).isStreaming


def test_heartbeats_of_the_clock(spark, tmp_path):
    now = int(time.time())
    lines = [json.dumps({"id": str(k), "stream_id": "s", "timestamp": (now - 30 + k) * NS, "data": k}) for k in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(lines))
    source = with_heartbeat(live(spark, tmp_path / "in"), behind="1 second")
    got = []
    manager = Manager(source, str(tmp_path / "cps"))
    manager.subscribe("alarm(s >= 0)", lambda b, n: got.extend(b.collect()))
    stop = time.time() + 60
    while len(got) < 3 and time.time() < stop:
        time.sleep(0.5)
    manager.stop()
    assert sorted(r.ts_ns // NS - now for r in got) == [-30, -29, -28]


def test_strict_queries_fail(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", 100, 1)])
    strict, lax = (Manager(live(spark, tmp_path / "in"), str(tmp_path / f"cps{k}"), strict=k) for k in (True, False))
    try:
        for manager in (strict, lax):
            manager.subscribe("sum(s, 10s)", lambda b, n: b.count())
            manager.await_batches()
        for n in (1, 2, 3):
            feed(tmp_path / "in", n, [("s", 10 - n, 1)])  # behind the watermark
        lax.await_batches()
        stop = time.time() + 60
        while not strict.failures and time.time() < stop:
            time.sleep(0.2)
        assert isinstance(strict.failures["sum(s, 10s)"], LateRecord) and strict.active() == {}
        assert lax.failures == {} and lax.active() == {"sum(s, 10s)": 1}
    finally:
        strict.stop()
        lax.stop()
    feed(tmp_path / "odd", 0, [("s", 1, "no number")])
    records = Session(live(spark, tmp_path / "odd")).query("alarm(s > 1)", strict=True, watermark="0 seconds")
    with pytest.raises(Exception, match="no number"):
        drain(records, tmp_path, "strict")


def test_subscribe_from_a_time(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", t, t) for t in range(5)])
    manager = Manager(live(spark, tmp_path / "in"), str(tmp_path / "cps"))
    late, whole = [], []
    try:
        token = manager.subscribe("bar(s)", lambda b, n: late.extend(b.collect()), start_ns=(START + 3) * NS)
        manager.subscribe("bar(s)", lambda b, n: whole.extend(b.collect()))
        assert len(manager.active()) == 2
        manager.await_batches()
        manager.unsubscribe(token)
        assert list(manager.active()) == ["bar(s)"]
    finally:
        manager.stop()
    assert sorted(seconds(r.ts_ns) for r in late) == [3, 4] and len(whole) == 5


def test_listener_lines_and_disconnect(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", 1, 1), ("s", 2, "two")])
    manager = Manager(live(spark, tmp_path / "in"), str(tmp_path / "cps"))
    with pytest.raises(ValueError):
        manager.listen(" ", io.StringIO())
    whole, data = io.StringIO(), io.StringIO()
    try:
        manager.listen("s", whole)
        manager.await_batches()
        manager.listen("s", data, data_only=True)
        lines = [json.loads(x) for x in whole.getvalue().splitlines()]
        assert [(x["stream_id"], x["timestamp"], x["data"]) for x in lines] == [("s", (START + 1) * NS, "1"), ("s", (START + 2) * NS, "two")]
        data.close()
        feed(tmp_path / "in", 1, [("s", 3, 3)])
        manager.await_batches()
        stop = time.time() + 30
        while manager.active()["s"] > 1 and time.time() < stop:
            time.sleep(0.1)
        assert manager.active() == {"s": 1} and len(whole.getvalue().splitlines()) == 3
        whole.close()
        feed(tmp_path / "in", 2, [("s", 4, 4)])
        while manager.active() and time.time() < stop:
            time.sleep(0.1)
        assert manager.active() == {}
    finally:
        manager.stop()


def test_publisher(spark, tmp_path):
    folder = str(tmp_path / "pub")
    with Publisher(folder) as out:
        out.submit({"stream_id": "s{a=b}", "timestamp": 5 * NS, "data": 2.5, "id": "own"})
        out.submit(json.dumps({"stream_id": "s", "timestamp": 6 * NS, "data": "x"}))
        for bad in ({"timestamp": 1}, {"stream_id": "", "timestamp": 1}, {"stream_id": "a(b)", "timestamp": 1}, {"stream_id": "s"}, "no json"):
            with pytest.raises(ValueError):
                out.submit(bad)
        with pytest.raises(ValueError):
            out.submit_raw("", "x")
        out.submit_raw("raw", "payload")
    env = os.environ | {"PYTHONPATH": os.getcwd()}
    command = [sys.executable, "-m", "streamloom.sources.publish", "typed", folder]
    subprocess.run(command, input="one \n two\n", text=True, check=True, env=env, timeout=120)
    got = {(r.stream_id, r.data): r for r in drain(json_line_stream(spark, folder, fresh=False), tmp_path, "pub")}
    assert set(got) == {("s{a=b}", "2.5"), ("s", "x"), ("raw", "payload"), ("typed", "one"), ("typed", "two")}
    assert got["s{a=b}", "2.5"].num == 2.5 and got["s{a=b}", "2.5"].ts_ns == 5 * NS
    assert "own" not in {r.id for r in got.values()} and len({r.id for r in got.values()}) == 5


def test_registered_producer(spark, tmp_path):
    def count(n):
        return [json.dumps({"id": str(k), "stream_id": "test", "timestamp": (START + k) * NS, "data": k}) for k in range(n, min(n + 4, 10))]

    register_producer(spark, "counting", count)
    got = []
    manager = Manager(produced(spark, "counting"), str(tmp_path / "cps"))
    manager.subscribe("test", lambda b, n: got.extend(b.collect()))
    stop = time.time() + 60
    while len(got) < 10 and time.time() < stop:
        time.sleep(0.2)
    manager.stop()
    assert [(r.id, r.data) for r in got] == [(str(k), str(k)) for k in range(10)]


def test_log_and_replay(spark, tmp_path):
    feed(tmp_path / "in", 0, [("a", 1, 1), ("b", 2, 2), ("a", 3, 3)])
    query = log_stream(live(spark, tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    again = replay_log(spark, str(tmp_path / "log"), start_ns=(START + 2) * NS)
    assert sorted(seconds(r.ts_ns) for r in again.collect()) == [2, 3]
    moving = replay_log(spark, str(tmp_path / "log"), stop_ns=(START + 2) * NS, inclusive=True, streaming=True)
    assert sorted(seconds(r.ts_ns) for r in drain(moving, tmp_path, "moving")) == [1, 2]


def test_manager_shares_and_stops(spark, tmp_path):
    feed(tmp_path / "in", 0, [("s", 1, 1), ("s", 2, 2)])
    metrics = Metrics()
    spark.streams.addListener(metrics)
    manager = Manager(live(spark, tmp_path / "in"), str(tmp_path / "cps"))
    one, two = [], []
    try:
        first = manager.subscribe("bar(s)", lambda b, n: one.extend(b.collect()))
        second = manager.subscribe(" bar( s )", lambda b, n: two.extend(b.collect()))
        assert manager.active() == {"bar(s)": 2}
        manager.await_batches()
        feed(tmp_path / "in", 1, [("s", 3, 3)])
        manager.await_batches()
        assert len(one) == 3 and len(two) >= 1
        stop = time.time() + 30
        while metrics.processed < 3 and time.time() < stop:
            time.sleep(0.1)
        assert (metrics.processed, metrics.late) == (3, 0)
        manager.unsubscribe(first)
        assert manager.active() == {"bar(s)": 1}
        manager.unsubscribe(second)
        assert manager.active() == {}
    finally:
        manager.stop()
        spark.streams.removeListener(metrics)


def test_other_live_sources(spark, tmp_path):
    assert rate(spark).isStreaming
    assert json_line_stream(spark, str(tmp_path)).isStreaming
    assert events(spark, str(tmp_path), streaming=True, files_per_trigger=1).isStreaming
