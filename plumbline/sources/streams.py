"""A corpus of Parquet files as a stream, or a table, that stops at a limit.

    CorpusSource.register(spark)
    spark.readStream.format("corpus").schema("i long, text string").option("path", path).option("limit", 2000).load()

Rows come in the order of file names and of rows within a file, numbered from 0 in the column i. An offset is a number of rows, so a
stream that is started again neither repeats nor skips; when the limit is reached no further batch comes. Only footers
are read to plan, no further than to the limit, and each task reads one row group's rows. Workers read the files by
pyarrow, from local paths and the stores that it has a file system for; of other stores, `reachable` has Spark make a copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.sources.scratch import folder

NUMBER = "i"


@dataclass
class Piece(InputPartition):
    """Rows of one row group: how many to leave out, how many to take, the number of the first one taken, and how many rows of the file have been taken then."""

    file: str
    group: int
    skip: int
    take: int
    number: int
    of_file: int

    def offset(self) -> dict:
        return {"row": self.number + self.take, "file": self.file, "of_file": self.of_file}


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:", path):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


def reachable(spark: SparkSession, path: str) -> str:
    """The path, or that of a copy in a fresh folder where only Spark opens the store. The copy has the rows in the same order."""
    try:
        located(path)
        return path
    except (pa.ArrowInvalid, OSError):
        at = folder(spark, "copied-corpus")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    spark.read.parquet(path).select("*", *place).orderBy("_file", "_row").drop("_file", "_row").write.parquet(at)
    return at


def files_of(path: str) -> list[str]:
    """The Parquet files at a path in the order of their names; hidden ones aren't part of the corpus."""
    store, at = located(path)
    there = store.get_file_info(at)
    if there.type == pyarrow.fs.FileType.File:
        return [at]
    found = store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(x.path for x in found if x.type == pyarrow.fs.FileType.File and x.extension == "parquet" and not x.base_name.startswith(("_", ".")))


def pieces(path: str, first: int, stop: int) -> list[Piece]:
    """What covers the rows from first to stop, as far as there are any."""
    store, _ = located(path)
    out, at = [], 0
    for file in files_of(path):
        if at >= stop:
            break
        with store.open_input_file(file) as f:
            footer = pq.read_metadata(f)
        begin = at
        for g in range(footer.num_row_groups):
            n = footer.row_group(g).num_rows
            low, high = max(first, at), min(stop, at + n)
            if low < high:
                out.append(Piece(file, g, low - at, high - low, low, high - begin))
            at += n
    return out


def read_piece(path: str, piece: Piece, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    store, _ = located(path)
    with store.open_input_file(piece.file) as f:
        skip, left, number = piece.skip, piece.take, piece.number
        for batch in pq.ParquetFile(f).iter_batches(row_groups=[piece.group], columns=[n for n in names if n != NUMBER], batch_size=4096):
            passed = min(skip, batch.num_rows)
            skip -= passed
            batch = batch.slice(passed, left)
            if batch.num_rows:
                numbers = pa.array(range(number, number + batch.num_rows), pa.int64())
                columns = [numbers if n == NUMBER else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(n).type) for n, c in zip(names, columns)], schema=schema)
            number, left = number + batch.num_rows, left - batch.num_rows
            if not left:
                return


class _Corpus:
    def __init__(self, options: dict, schema: StructType) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.limit = options["path"], int(options["limit"])
        if self.limit < 0:
            raise ValueError("limit must not be negative")
        self.names, self.arrow = schema.names, to_arrow_schema(schema)

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        """Where there is no partition, Spark asks for None."""
        return read_piece(self.path, partition, self.names, self.arrow) if partition else iter(())


class CorpusTable(_Corpus, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return pieces(self.path, 0, self.limit)


class CorpusStream(_Corpus, DataSourceStreamReader):
    """Files that are added later continue the corpus: their names must sort after those that are there."""

    def initialOffset(self) -> dict:
        return {"row": 0, "file": "", "of_file": 0}

    def latestOffset(self) -> dict:
        last = next(reversed(pieces(self.path, 0, self.limit)), None)
        return last.offset() if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before = next(reversed(pieces(self.path, 0, start["row"])), None)
        if start["row"] and (before is None or before.offset() != start):
            raise ValueError(f"row {start['row']} no longer ends in {start['file']}: files were taken away, or added before it")
        return pieces(self.path, start["row"], end["row"])

    def commit(self, end: dict) -> None:
        pass


class CorpusSource(DataSource):
    """Options: path, a file or folder of Parquet files; limit, the number of rows of the prefix."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        store, _ = located(self.options["path"])
        with store.open_input_file(files_of(self.options["path"])[0]) as f:
            return StructType([StructField(NUMBER, LongType()), *from_arrow_schema(pq.read_schema(f)).fields])

    def reader(self, schema: StructType) -> CorpusTable:
        return CorpusTable(self.options, schema)

    def streamReader(self, schema: StructType) -> CorpusStream:
        return CorpusStream(self.options, schema)
