"""Places and postal codes that are added while queries run, and queries that come as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..finder import Finder
from ..operators.names import exact
from ..operators.postal import by_postal_code


def answer_names(stream: DataFrame, names: DataFrame) -> DataFrame:
    """A stream of queries (qid, name, country) against a table; no state and no watermark are needed."""
    return exact(stream, names)


def answer_postal(stream: DataFrame, table: DataFrame) -> DataFrame:
    return by_postal_code(stream, table)


def add_each_batch(stream: DataFrame, add: Callable[[DataFrame, str, int], bool], checkpoint: str, source: str) -> StreamingQuery:
    """Hands each micro-batch to add(rows, source, batch), such as Finder.add_places or Finder.add_postal, whose runs are the stream's state.

    The batch's number goes along, so one that is repeated, after a failure between the addition and the checkpoint, isn't added twice; a query
    that starts again from its checkpoint goes on with the next number. Stops when all that is there has been read.
    """

    def write(rows: DataFrame, batch: int) -> None:
        add(rows, source, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_places(stream: DataFrame, finder: Finder, checkpoint: str, source: str = "places") -> StreamingQuery:
    """Places of a stream as additions; the next lookup of the finder sees them."""
    return add_each_batch(stream, finder.add_places, checkpoint, source)


def stream_postal(stream: DataFrame, finder: Finder, checkpoint: str, source: str = "postal") -> StreamingQuery:
    """Postal rows of a stream as additions: the last row of each key holds, and late ones change nothing."""
    return add_each_batch(stream, finder.add_postal, checkpoint, source)
