"""What a store consists of, as numbered versions of one small file.

A version is never changed. A writer makes the next one from the last, and writes it only if no other writer has: the file is created under
a name that must not be there yet. Who comes second takes the other's version and makes the next from that. A reader holds one version, and so
sees a store as it was then, whatever is written meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from quire.sources import shared

#: Versions after which the place of the last one is noted anew; a reader tries at most about as many names.
NOTE = 16


class Manifest:
    """``state`` is any value that JSON has; a new manifest begins with ``first``."""

    def __init__(self, spark: SparkSession, path: str, first: Any):
        self.spark, self.path, self.first = spark, path, first

    def _at(self, version: int) -> str:
        return f"{self.path}/{version:012d}.json"

    def last(self) -> tuple[int, Any]:
        """(number, state) of the last version; 0 and ``first`` if there is none."""
        note = shared.read_text(self.spark, f"{self.path}/last")
        version = int(note) if note and note.isdigit() else 0  # only says where to begin
        found = shared.read_text(self.spark, self._at(version)) if version else None
        while (text := shared.read_text(self.spark, self._at(version + 1))) is not None:
            version, found = version + 1, text
        return version, json.loads(found) if found else json.loads(json.dumps(self.first))

    def commit(self, change: Callable[[Any], Any]) -> Any:
        """Changes the state and gives what ``change`` returns, which gets the state and may be called again if another writer came first."""
        while True:
            version, state = self.last()
            out = change(state)
            if shared.create_text(self.spark, self._at(version + 1), json.dumps(state)):
                if (version + 1) % NOTE == 0:
                    shared.write_text(self.spark, f"{self.path}/last", str(version + 1))
                return out
