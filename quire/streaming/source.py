"""A streaming source over any log of events that can be read from an offset on, as a subscription that goes on where it was.

``source`` makes a data source of a function that connects to such a log. The offsets of a micro-batch are in the stream's checkpoint, so one that is run
again reads the same events; its range is dealt to tasks of ``a_task`` offsets. A connection that breaks is made anew after a wait, and a task
goes on behind the last event that it gave. What a stream has done with is acknowledged to the log.

``Journal`` is such a log in a shared folder: segments of lines, each an offset and a JSON text.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quire.sources import shared


class Connection(Protocol):
    def last(self) -> int:
        """One more than the greatest offset."""

    def read(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        """(offset, value) in order of offsets; not all offsets need be there."""

    def acknowledge(self, offset: int) -> None:
        """All below ``offset`` has been taken."""

    def close(self) -> None: ...


class Steady:
    """A connection that is made again where it breaks, after ``waits`` seconds, of which the last holds on, ``tries`` times in a row at most."""

    def __init__(self, connect: Callable[[], Connection], waits: tuple[float, ...], tries: int):
        self.connect, self.waits, self.tries, self.now = connect, waits, tries, None

    def _again(self, failures: int, error: Exception) -> None:
        self.close()
        if failures > self.tries:
            raise error
        time.sleep(self.waits[min(failures, len(self.waits)) - 1])

    def do(self, what: Callable[[Connection], Any]) -> Any:
        failures = 0
        while True:
            try:
                self.now = self.now or self.connect()
                return what(self.now)
            except (ConnectionError, TimeoutError) as e:
                failures += 1
                self._again(failures, e)

    def read(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        failures = 0
        while begin < end:
            try:
                self.now = self.now or self.connect()
                for offset, value in self.now.read(begin, end):
                    yield offset, value
                    begin, failures = offset + 1, 0
                return
            except (ConnectionError, TimeoutError) as e:
                failures += 1
                self._again(failures, e)

    def close(self) -> None:
        if self.now is not None:
            self.now.close()
        self.now = None


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def source(name: str, connect: Callable[[], Connection], a_task: int = 10_000, waits: tuple[float, ...] = (2.0, 5.0), tries: int = 10) -> type[DataSource]:
    """A data source (offset, value), to be registered and read by ``name``."""

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.connection = Steady(connect, waits, tries)

        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            return {"at": self.connection.do(lambda c: c.last())}

        def partitions(self, start: dict, end: dict) -> list[Range]:
            return [Range(i, min(i + a_task, end["at"])) for i in range(start["at"], end["at"], a_task)]

        def read(self, partition: Range) -> Iterator[tuple[int, str]]:
            own = Steady(connect, waits, tries)
            try:
                yield from own.read(partition.begin, partition.end)
            finally:
                own.close()

        def commit(self, end: dict) -> None:
            self.connection.do(lambda c: c.acknowledge(end["at"]))

        def stop(self) -> None:
            self.connection.close()

    class Events(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "offset long, value string"

        def streamReader(self, schema) -> Reader:
            return Reader()

    return Events


def stream(spark: SparkSession, name: str, connect: Callable[[], Connection], **how) -> DataFrame:
    """The events (offset, value) of a log as a stream."""
    spark.dataSource.register(source(name, connect, **how))
    return spark.readStream.format(name).load()


class Journal:
    """Segments of a shared folder; what has been taken is noted beside them."""

    def __init__(self, path: str):
        self.fs, self.base = shared.file_system(path)

    def _segments(self) -> list[tuple[int, int, str]]:
        """(first offset, one past the last, file)"""
        from pyarrow.fs import FileSelector

        files = [f for f in self.fs.get_file_info(FileSelector(self.base, allow_not_found=True)) if f.base_name.endswith(".jsonl")]
        return sorted((*map(int, f.base_name.split(".")[0].split("-")), f.path) for f in files)

    def last(self) -> int:
        return max((end for _, end, _ in self._segments()), default=0)

    def read(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        for first, past, path in self._segments():
            if first < end and past > begin:
                with self.fs.open_input_stream(path) as f:
                    for line in f.read().decode().splitlines():
                        offset, value = json.loads(line)
                        if begin <= offset < end:
                            yield offset, value

    def acknowledge(self, offset: int) -> None:
        with self.fs.open_output_stream(f"{self.base}/taken") as f:
            f.write(str(offset).encode())

    def taken(self) -> int:
        with self.fs.open_input_stream(f"{self.base}/taken") as f:
            return int(f.read())

    def close(self) -> None:
        pass


def journal(events: DataFrame, a_segment: int = 2000) -> str:
    """Writes events (offset, value) as a journal; its folder. A segment is written by one task."""
    path = shared.new_path(events.sparkSession, "journal")

    def segment(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        fs, base = shared.file_system(path)
        fs.create_dir(base)
        offsets = t.column("offset").to_pylist()
        with fs.open_output_stream(f"{base}/{offsets[0]:015d}-{offsets[-1] + 1:015d}.jsonl") as f:
            f.write("".join(json.dumps(x) + "\n" for x in zip(offsets, t.column("value").to_pylist())).encode())
        return t.select(["offset"]).slice(0, 1)

    numbered = events.select("offset", "value", F.expr(f"offset div {a_segment}").alias("segment"))
    numbered.groupBy("segment").applyInArrow(segment, "offset long").write.format("noop").mode("overwrite").save()
    return path


class Dropping(Journal):
    """A journal whose connection breaks once in each range that is read, after ``after`` events: to try subscriptions with."""

    broken: set = set()

    def __init__(self, path: str, after: int):
        super().__init__(path)
        self.after = after

    def read(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        breaks = (self.base, end) not in self.broken
        for n, event in enumerate(super().read(begin, end)):
            if breaks and n == self.after:
                self.broken.add((self.base, end))
                raise ConnectionError("the connection was dropped")
            yield event
