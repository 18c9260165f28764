"""Tables that grow by batches: sorted runs, merged in levels."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .log import Log


class Runs:
    """Rows that came in batches, of which a merge keeps what holds for each key.

    A batch is merged by itself and written as a run of level 0, sorted by key. When a level has `fanout` runs they become one run of the next
    level, so a row is written again as often as the logarithm of all batches, and a reader meets fewer than fanout runs a level. merge
    must give the same whatever the order and the grouping in which it sees rows, and however often: then late rows change
    nothing that is newer, and repeated ones nothing at all. What a reader has open stays until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], fanout: int = 4):
        self.spark, self.path, self.merge, self.keys, self.fanout = spark, path, merge, keys, fanout
        self.log = Log(spark, f"{path}/_log")

    def _state(self) -> tuple[int, dict]:
        version, state = self.log.read()
        return version, state or {"runs": [], "batches": {}, "schema": None}

    def runs(self) -> list[dict]:
        """The runs that hold now: their ids and levels, the oldest first."""
        return self._state()[1]["runs"]

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        self.merge(rows).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{name}")
        return name

    def _open(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))

    def add(self, rows: DataFrame, source: str, batch: int) -> bool:
        """Adds a batch of a source, whose batches have rising numbers; one that was added before changes nothing and gives False."""
        version, state = self._state()
        if batch <= state["batches"].get(source, -1):
            return False
        merged = self.merge(rows)
        state["schema"] = state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
        state["runs"].append({"id": self._write(rows), "level": 0})
        state["batches"][source] = batch
        version = self.log.commit(version, state)
        level = 0
        while len(full := [r for r in state["runs"] if r["level"] == level]) >= self.fanout:
            one = {"id": self._write(self._open([r["id"] for r in full], state["schema"])), "level": level + 1}
            state["runs"] = [r for r in state["runs"] if r["level"] != level] + [one]
            version = self.log.commit(version, state)
            level += 1
        return True

    def read(self) -> DataFrame | None:
        """What holds for each key over all batches so far; None before the first one. One run is read as it stands."""
        _, state = self._state()
        names = [r["id"] for r in state["runs"]]
        if not names:
            return None
        rows = self._open(names, state["schema"])
        return rows if len(names) == 1 else self.merge(rows)

    def vacuum(self) -> int:
        """Removes runs that hold no more, and those of writers that were lost; none of them may be read any more. Gives their number."""
        held = {r["id"] for r in self.runs()}
        gone = [n for n in self.log.folders(self.path) if n.startswith("run-") and n not in held]
        for n in gone:
            self.log.remove(f"{self.path}/{n}")
        return len(gone)
