"""Answers as they are streamed: tokens put in order, their end, their failure, and a sink that takes each micro-batch once.

Pieces (stream_id, seq, kind, token, at_us) may come in any order and in any micro-batch; ``seq`` counts the pieces of a stream from 0, ``kind`` is token, end or
error, ``at_us`` its time in microseconds. State is kept by stream: pieces wait in a map, in blocks of
``BLOCK`` numbers, until their predecessor has come, what came out is a list, and timers end waiting: a gap is passed over after ``patience`` seconds, an answer that falls silent has failed after ``silence``. Time is
that of arrival, which goes on as micro-batches come; so no piece is ever late, and a micro-batch that is run again does the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.sources.store import Log
from quire.streaming.events import Subscription

PIECES = "stream_id long, seq int, kind string, token string, at_us long"
OUT = "stream_id long, kind string, seq int, content string, failed boolean, asked_us long, answered_us long"
#: Seconds for which an answer that has ended is remembered, so that pieces that come twice don't begin it anew.
MEMORY = 24 * 3600
#: Numbers of a stream's pieces that wait as one value: a call of the state for each block, and not for each piece.
BLOCK = 256


class Ordered(StatefulProcessor):
    """Of each stream: tokens in order from the first "{" on, without empty ones, and the whole answer at its end."""

    def __init__(self, patience: float, silence: float):
        self.patience, self.silence = patience, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next int, begun boolean, asked_us long, answered_us long")
        self.waiting = handle.getMapState("waiting", "block int", "pieces string")
        self.text = handle.getListState("text", "token string")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.ended.exists():
            return
        at, begun, asked, answered = self.head.get() if self.head.exists() else (0, False, None, None)
        came, now = {}, 0
        for r in rows:
            now = max(now, r.now_ms)
            if r.seq >= at:  # else it has come before
                came[r.seq] = (r.kind, r.token)
            asked = r.at_us if asked is None else min(asked, r.at_us)
            answered = r.at_us if answered is None else max(answered, r.at_us)
        yield from self._on(key, came, (at, begun, asked, answered), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.ended.exists():
            self.ended.clear()
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        at, begun, asked, answered = self.head.get()
        blocks = [k[0] for k in self.waiting.keys()]
        if blocks:  # what is missing has been waited for
            yield from self._on(key, {}, (min(self._block(min(blocks))), begun, asked, answered), now)
        else:
            yield from self._over(key, at, True, asked, answered, now, [])

    def _block(self, number: int) -> dict[int, tuple[str, str]]:
        """The pieces of a block that wait."""
        found = self.waiting.getValue((number,))
        return {seq: (kind, token) for seq, kind, token in json.loads(found[0])} if found is not None else {}

    def _on(self, key, came: dict, head: tuple, now: int) -> Iterator[Row]:
        """Gives what is next, as far as it is there; the rest waits."""
        at, begun, asked, answered = head
        fresh, new = [], {}
        for seq, piece in came.items():
            new.setdefault(seq // BLOCK, {})[seq] = piece
        waits = False
        while True:
            number = at // BLOCK
            had = self._block(number)
            here = had | new.pop(number, {})
            while (piece := here.pop(at, None)) is not None:
                kind, token = piece
                if kind != "token":
                    yield from self._over(key, at, kind == "error", asked, answered, now, fresh)
                    return
                if token and not begun and "{" in token:
                    begun, token = True, token[token.index("{") :]
                if token and begun:
                    fresh.append(token)
                    yield Row(stream_id=key[0], kind="token", seq=at, content=token, failed=False, asked_us=None, answered_us=None)
                at += 1
            if here:
                waits = True
                if here != had:
                    self._wait(number, here)
            elif had:
                self.waiting.removeKey((number,))
            if at // BLOCK == number:
                break
        if fresh:
            self.text.appendList([(t,) for t in fresh])
        for number, pieces in new.items():
            self._wait(number, self._block(number) | pieces)
        self.head.update((at, begun, asked, answered))
        waits = waits or bool(new) or next(iter(self.waiting.keys()), None) is not None
        self._wake(now, self.patience if waits else self.silence)

    def _wait(self, number: int, pieces: dict) -> None:
        self.waiting.updateValue((number,), (json.dumps([(seq, *piece) for seq, piece in pieces.items()]),))

    def _wake(self, now: int, seconds: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + max(1, int(1000 * seconds)))

    def _over(self, key, at: int, failed: bool, asked: int, answered: int, now: int, fresh: list[str]) -> Iterator[Row]:
        """The whole answer; fresh: its last tokens, which are not in the state."""
        whole = "".join([*(t[0] for t in self.text.get()), *fresh]) if self.text.exists() else "".join(fresh)
        self._wake(now, MEMORY)
        for state in (self.head, self.waiting, self.text):
            state.clear()
        self.ended.update((True,))
        yield Row(stream_id=key[0], kind="message", seq=at, content=whole, failed=failed, asked_us=asked, answered_us=answered)


def ordered(pieces: DataFrame, patience: float = 60.0, silence: float = 600.0) -> DataFrame:
    """A stream of ``PIECES`` as a stream of ``OUT``."""
    p = pieces.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds").withColumn("now_ms", F.unix_millis("arrived"))
    return p.groupBy("stream_id").transformWithState(Ordered(patience, silence), OUT, "append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """For streams with lists, maps and timers of state, which are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def kept(pieces: DataFrame, log: Log, checkpoint: str, patience: float = 60.0, silence: float = 600.0, each=None, **life) -> Log:
    """Runs the stream until all that is there has been taken, into ``log``: each micro-batch once, also where the stream is started again."""

    def sink(rows: DataFrame, number: int) -> None:
        if not log.insert(rows, (checkpoint, number)):
            rows.write.format("noop").mode("overwrite").save()  # its rows are there, but its state has to be made again
        if each:
            each(rows, number)

    with keyed_state(pieces.sparkSession):
        Subscription(ordered(pieces, patience, silence), sink, checkpoint, **life).run()
    return log


def messages(log: Log) -> DataFrame:
    """(stream_id, answer, asked_at, answered_at, failed) of the answers that have ended."""
    m = log.rows().filter("kind = 'message'")
    return m.select("stream_id", F.col("content").alias("answer"), F.timestamp_micros("asked_us").alias("asked_at"), F.timestamp_micros("answered_us").alias("answered_at"), "failed")
