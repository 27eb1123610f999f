"""Answers as streams: order, ends, gaps, silence, and a stream that is killed and started again."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.sources.store import Log
from quire.streaming import events, live

rng = random.Random(9)


def pieces_of(streams):
    """Per stream: its tokens and how it ends (end, error, None)."""
    out = []
    for i, (tokens, end) in streams.items():
        rows = [(i, n, "token", t, 1_000_000 * n) for n, t in enumerate(tokens)]
        out += rows + ([(i, len(tokens), end, "", 1_000_000 * len(tokens))] if end else [])
    return out


STREAMS = {i: ([rng.choice(["a", "{b", "c{d", "", "é}", "xyz"]) for _ in range(rng.choice([0, 1, 5, 20]))], rng.choice(["end", "end", "error"])) for i in range(40)}


def answer(tokens):
    whole = "".join(tokens)
    return whole[whole.index("{") :] if "{" in whole else ""


def streamed(spark, rows, tmp, files=1, parts=5):
    """Each part is a micro-batch."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], live.PIECES).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    return spark.readStream.schema(live.PIECES).option("maxFilesPerTrigger", files).parquet(f"{tmp}/in")


def test_any_order_gives_the_same_answers(spark, tmp_path):
    rows = pieces_of(STREAMS)
    rng.shuffle(rows)
    rows += rng.sample(rows, 30)  # some come twice
    log = live.kept(streamed(spark, rows, tmp_path), Log(spark, live.OUT, str(tmp_path / "log")), str(tmp_path / "c"), patience=3600)
    got = {r["stream_id"]: (r["answer"], r["failed"]) for r in live.messages(log).collect()}
    assert got == {i: (answer(t), end == "error") for i, (t, end) in STREAMS.items()} and live.messages(log).count() == len(STREAMS)
    tokens = log.rows().filter("kind = 'token'").orderBy("stream_id", "seq").collect()
    for i, (t, _) in STREAMS.items():
        assert "".join(r["content"] for r in tokens if r["stream_id"] == i) == answer(t)
    times = {r["stream_id"]: (r["asked_us"], r["answered_us"]) for r in log.rows().filter("kind = 'message'").collect()}
    assert times == {i: (0, 1_000_000 * len(t)) for i, (t, _) in STREAMS.items()}


def test_killed_and_started_again(spark, tmp_path):
    rows = pieces_of(STREAMS)
    rng.shuffle(rows)
    killed = []

    def each(batch, number):
        if number in (1, 2) and number not in killed:
            killed.append(number)
            raise ValueError("killed after its rows were written")

    log = live.kept(streamed(spark, rows, tmp_path), Log(spark, live.OUT, str(tmp_path / "log")), str(tmp_path / "c"), patience=3600, each=each, waits=(0.1,))
    assert killed == [1, 2]
    assert sorted((r["stream_id"], r["answer"]) for r in live.messages(log).collect()) == sorted((i, answer(t)) for i, (t, _) in STREAMS.items())
    log.compact()
    assert live.messages(log).count() == len(STREAMS) and len(log.manifest.last()[1]["data"]) == 1


def test_gaps_and_silence(spark, tmp_path):
    """A piece that never comes is passed over, and an answer without an end fails, once their time is over."""
    rows = [r for r in pieces_of({1: (["{a", "b", "c"], "end"), 2: (["{x", "y"], None), 3: (["{z"], "end")}) if r[:2] != (1, 1)]
    base = str(tmp_path)
    log = Log(spark, live.OUT, f"{base}/log")
    stream = streamed(spark, rows, tmp_path, files=10, parts=1)
    live.kept(stream, log, f"{base}/c", patience=0.001, silence=0.001)
    assert {r["stream_id"] for r in live.messages(log).collect()} >= {3}
    for n in range(4):  # time goes by in later micro-batches
        spark.createDataFrame([(100 + n, 0, "end", "", 0)], live.PIECES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        live.kept(spark.readStream.schema(live.PIECES).parquet(f"{base}/in"), log, f"{base}/c", patience=0.001, silence=0.001)
    got = {r["stream_id"]: (r["answer"], r["failed"]) for r in live.messages(log).filter("stream_id < 100").collect()}
    assert got == {1: ("{ac", False), 2: ("{xy", True), 3: ("{z", False)}


def test_log_takes_a_batch_once(spark):
    log = Log(spark, "id long")
    assert log.rows().count() == 0
    assert log.insert(spark.range(3), ("s", 0)) and not log.insert(spark.range(3), ("s", 0)) and log.insert(spark.range(2), ("t", 0)) and log.insert(spark.range(1))
    assert log.rows().count() == 6


@pytest.mark.parametrize("waits", [(0.0,), (0.05, 0.1)])
def test_a_subscription_that_is_stopped_ends(spark, tmp_path, waits):
    spark.createDataFrame([("x",)], "value string").write.text(str(tmp_path / "in"))
    s = events.Subscription(spark.readStream.schema("value string").text(str(tmp_path / "in")), lambda b, n: s.stop() if n else None, str(tmp_path / "c"), waits=waits)
    s.run()
    s.stop()
    s.run()
    assert s.ended.is_set() and s.stream.isStreaming and spark.range(1).select(F.lit(1)).count() == 1


class Counted:
    """State in memory, of which calls are counted."""

    def __init__(self):
        self.calls, self.value, self.map, self.list, self.timers = 0, None, {}, [], []

    def getValueState(self, name, schema):
        return self if name == "head" else Counted()

    def getMapState(self, name, *schemas):
        self.waiting = Counted()
        return self.waiting

    def getListState(self, name, schema):
        return Counted()

    def exists(self):
        return self.value is not None or bool(self.list)

    def get(self):
        return self.value if self.value is not None else iter(self.list)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.map, self.list = None, {}, []

    def appendList(self, rows):
        self.list += rows

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.map.pop(key, None)

    def keys(self):
        self.calls += 1
        return iter(list(self.map))

    def listTimers(self):
        return self.timers

    def deleteTimer(self, t):
        pass

    def registerTimer(self, t):
        pass


def test_pieces_wait_in_blocks():
    """The calls of the state are by blocks of pieces, not by pieces, whatever order these come in."""
    n = 3000
    pieces = [Row(stream_id=1, seq=i, kind="token" if i < n else "end", token=f"{{{i}" if i % 7 else "", at_us=i, now_ms=5) for i in range(n + 1)]
    random.Random(1).shuffle(pieces)
    p, state = live.Ordered(60, 600), Counted()
    p.init(state)
    out = [r for half in (pieces[: n // 2], pieces[n // 2 :]) for r in p.handleInputRows((1,), iter(half), None)]
    assert out[-1].kind == "message" and out[-1].content == "".join(f"{{{i}" for i in range(n) if i % 7) and [r.seq for r in out] == [i for i in range(n) if i % 7] + [n]
    assert state.waiting.calls < 8 * (n // live.BLOCK + 1) and not state.waiting.map
