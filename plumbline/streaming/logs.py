"""The result log as a stream: the last row of each key, and scoring of what is new, with their state in a state store.

State is kept by key in RocksDB and only its changes are written to the checkpoint, so a micro-batch costs what its own
keys cost, however many keys there are. A query that is started again on its checkpoint goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from plumbline.sources.schemas import schema

#: Where state is kept, and that a batch writes its changes and not all of it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_log_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of a growing log folder; unreadable lines and rows without key are left out. files_per_trigger bounds a micro-batch."""
    reader = spark.readStream.schema(schema("result"))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).filter("key IS NOT NULL")


def corpus_prefix(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows of a corpus in its order: each task passes on `limit` rows at most."""
    return rows.orderBy(order).limit(limit)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started here keep their state as STORE says; the session's settings come back."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class _Ordered(StatefulProcessor):
    def __init__(self, order: str) -> None:
        self.order = order

    def place(self, row) -> tuple:
        """Rows without a place come before all others."""
        return row[self.order] is not None, row[self.order]

    def last(self, rows: Iterator[Row]) -> Row:
        best = next(rows)
        for row in rows:
            if self.place(row) > self.place(best):
                best = row
        return best

    def close(self) -> None:
        pass


class NewestRow(_Ordered):
    """Of each key the row that is last by a column. Gives a key's row whenever that changes; rows that come late change nothing, of equal places the first stays."""

    def __init__(self, order: str, fields: StructType) -> None:
        super().__init__(order)
        self.fields = fields

    def init(self, handle) -> None:
        self.row = handle.getValueState("row", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, held = self.last(rows), self.row.get()
        if held is None or self.place(best) > self.place(dict(zip(self.fields.names, held))):
            self.row.update(tuple(best[c] for c in self.fields.names))
            yield best


class FirstRow(_Ordered):
    """Of each key one row, once: of the micro-batch in which it comes first, the row that is last by a column. Keys of the initial state give none."""

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.done.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = self.last(rows)
        if not self.done.exists():
            self.done.update((True,))
            yield best


def last_state(stream: DataFrame, checkpoint: str, order: str = "line_no", changed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep, as the state under checkpoint, the last row of each key, so that a later success replaces an error and the reverse.

    What is last is said by the column order, not by when a row comes, so files may come in any order. `newest_state` reads the
    state; `changed` is given the rows that a micro-batch changed, with its number, as foreachBatch does.
    """
    fields = StructType([f for f in stream.schema if f.name != "key"])
    rows = stream.groupBy("key").transformWithState(NewestRow(order, fields), stream.schema, "Update", "None")
    out = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with state_store(stream.sparkSession):
        return (out.foreachBatch(changed) if changed else out.format("noop")).start()


def newest_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last row of every key, read from the state store."""
    with state_store(spark):
        return spark.read.format("statestore").option("stateVarName", "row").load(checkpoint).select("key.*", "value.*")


def score_new(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, order: str = "line_no", ready: Column | None = None, scored: DataFrame | None = None
) -> StreamingQuery:
    """Append to target, a folder of Parquet files, the scores of rows whose key isn't scored yet: each key is scored once.

    A micro-batch scores the row of a key that is last by the column order. Rows that aren't `ready`, such as errors, are left out, so that
    a later row of their key is scored. `scored`, with the column key, are keys that need no score; it is read once, when the
    query starts for the first time. score is applied to a stream. The file sink's log makes a repeated batch write nothing twice.
    """
    rows = stream.filter(F.coalesce(ready, F.lit(False))) if ready is not None else stream
    known = scored.select("key").groupBy("key") if scored is not None else None
    first = rows.groupBy("key").transformWithState(FirstRow(order), rows.schema, "Append", "None", known)
    with state_store(stream.sparkSession):
        return score(first).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
