"""A source with offsets: dropped connections, restarts, replays, acknowledgement."""

import pytest
from pyspark.sql import functions as F

from quire.sources import shared
from quire.sources.store import Log
from quire.streaming import source
from quire.streaming.events import Subscription

OUT = "offset long, value string"


def events_of(spark, begin, end):
    return spark.range(begin, end).filter("id % 7 != 3").select(F.col("id").alias("offset"), F.concat(F.lit("é "), "id").alias("value"))


def taken(spark, path, log, checkpoint, connect=None, each=None, **how):
    def sink(rows, number):
        log.insert(rows, ("s", number))
        if each:
            each(number)

    stream = source.stream(spark, "quire_test_events", connect or (lambda: source.Journal(path)), a_task=40, waits=(0.01,), **how)
    Subscription(stream, sink, checkpoint, waits=(0.05,)).run()
    return sorted(map(tuple, log.rows().collect()))


def test_dropped_connections_lose_and_repeat_nothing(spark, tmp_path):
    path = source.journal(events_of(spark, 0, 300), 64)
    got = taken(spark, path, Log(spark, OUT), str(tmp_path / "c"), lambda: source.Dropping(path, 11))
    assert got == sorted(map(tuple, events_of(spark, 0, 300).collect()))


def test_goes_on_where_it_was(spark, tmp_path):
    path, log, killed = source.journal(events_of(spark, 0, 100), 64), Log(spark, OUT), []

    def each(number):
        if not killed:
            killed.append(number)
            raise ValueError("killed")

    assert len(taken(spark, path, log, str(tmp_path / "c"), each=each)) == events_of(spark, 0, 100).count() and killed == [0]
    more = source.journal(events_of(spark, 128, 200), 64)
    fs, base = shared.file_system(path)
    _, other = shared.file_system(more)
    for _, _, f in source.Journal(more)._segments():
        fs.copy_file(f, f.replace(other, base))
    got = taken(spark, path, log, str(tmp_path / "c"))
    want = events_of(spark, 0, 100).union(events_of(spark, 128, 200)).collect()
    assert got == sorted(map(tuple, want)) and source.Journal(path).taken() >= 100


def test_a_log_that_can_not_be_reached(spark, tmp_path):
    def connect():
        raise ConnectionError("nobody there")

    steady = source.Steady(connect, (0.0,), 3)
    with pytest.raises(ConnectionError):
        steady.do(lambda c: c.last())
    with pytest.raises(ConnectionError):
        list(steady.read(0, 5))
    assert source.Journal(str(tmp_path / "none")).last() == 0
