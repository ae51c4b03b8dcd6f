"""The rolling rate as a stream against a count over all events."""

import datetime as dt
import os
import random

import pytest

from keelson.streaming import limiter

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.set(*limiter.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def by_hand(events, seconds):
    return {i: sum(1 for k2, t2, _ in events if k2 == k and t - dt.timedelta(seconds=seconds) <= t2 <= t) for k, t, i in events}


def test_rolling_counts_with_late_rows(session, tmp_path):
    rng = random.Random(1)
    folder = tmp_path / "in"
    events = [(rng.choice("abc"), START + dt.timedelta(milliseconds=250 * i, microseconds=rng.randint(0, 999)), i) for i in range(240)]
    events += [("a", events[7][1], 500), ("a", events[7][1], 501)]  # ties
    # each file's events lie within ten seconds of the watermark; the last file has one row that comes too late, and one that ends everything
    mixed = sorted(events, key=lambda e: (e[1] + dt.timedelta(seconds=rng.uniform(0, 8))))
    files = [mixed[i : i + 60] for i in range(0, len(mixed), 60)]
    late, last = ("a", START + dt.timedelta(seconds=3), 900), ("z", START + dt.timedelta(days=1), 901)
    schema = "k string, ts timestamp, id long"
    got: dict = {}

    def run(rows, number):
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = session.readStream.schema(schema).parquet(str(folder))
        out = limiter.rolling_counts(stream, "k", "id", "ts", 5, "10 seconds")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    for number, rows in enumerate([*files, [late, last]]):
        run(rows, number)  # each call is a restart from the state of the last
    for r in session.read.parquet(str(tmp_path / "out")).collect():
        assert r["id"] not in got
        got[r["id"]] = r["recent"]
    assert got == by_hand(events, 5)
    assert os.path.isdir(tmp_path / "state" / "state")


def test_whole_table_equals_the_window(spark):
    from keelson.plans import registry

    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("no test tables")
    stream, batch = (registry.QUERIES[q](spark, where).collect() for q in ("stream_rolling_counts", "stream_rate_limit"))
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch))


def test_calls_to_the_state_dont_grow_with_the_rows():
    """Each call is a message to the JVM: a key's batch takes as many for a thousand rows as for one."""
    from types import SimpleNamespace

    calls = []

    class State:
        def __init__(self):
            self.now = None

        def __getattr__(self, name):
            calls.append(name)
            return {"get": self._get, "clear": lambda: self._set(None), "update": self._set, "put": self._set, "appendValue": lambda x: self._set([*(self.now or []), x]), "appendList": lambda x: self._set([*(self.now or []), *x])}[name]

        def _get(self):
            return self.now if not isinstance(self.now, list) else iter(self.now)

        def _set(self, x):
            self.now = x

    class Listed(State):
        def _get(self):
            return iter(self.now or [])

    timer = lambda name: lambda at: calls.append(name)
    counts = {}
    for n in (1, 1000):
        calls.clear()
        p = limiter._Rolling(5_000_000)
        p.init(SimpleNamespace(getListState=lambda *a: Listed(), getValueState=lambda *a: State(), registerTimer=timer("register"), deleteTimer=timer("delete")))
        rows = [limiter.Row(key="a", id=i, time=None, at=i * 1_000_000) for i in range(n)]
        assert list(p.handleInputRows(("a",), iter(rows), None)) == []
        mark = SimpleNamespace(getCurrentWatermarkInMs=lambda n=n: n * 1000 + 86_400_000)
        got = [tuple(r) for r in p.handleExpiredTimer(("a",), mark, None)]
        assert got == [("a", i, min(i + 1, 6)) for i in range(n)]
        counts[n] = len(calls)
    assert counts[1] == counts[1000] < 10
