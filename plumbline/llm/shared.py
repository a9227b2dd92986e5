"""Storage and conventions that the operators of this subpackage have in common."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
BATCH_BYTES = 8 << 20
#: Bytes that an intermediate file should hold at least, if its table has that many.
FILE_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset: of one machine, as in tests, a temporary folder of this process; of a cluster, none, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="plumbline-"))


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost no recomputation of it."""
    return Scratch()(df, what)


class Scratch:
    """The intermediate tables of one call. They go when the session's JVM ends, or at once when they are dropped: those that the call's result doesn't read.

    A table is written by at most `files` tasks, so that small ones aren't scattered over a file for each shuffle partition;
    unset, by as many as there are partitions.
    """

    def __init__(self, files: int | None = None) -> None:
        self.files = files
        self._paths: dict[str, tuple[SparkSession, str]] = {}

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        spark = df.sparkSession
        path = new_path(spark, what)
        df = df.coalesce(self.files) if self.files else df
        df.write.parquet(path)
        self._paths[what] = spark, path
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, *what: str) -> None:
        for name in what:
            delete_path(*self._paths.pop(name))


def map_arrow(rows: DataFrame, f, schema) -> DataFrame:
    """rows.mapInArrow(f, schema) in batches of at most BATCH_BYTES (the session's limit is lowered, never raised), with Arrow's free memory given back after each task: workers live on from task to task, two or more beside an executor's heap."""
    conf = rows.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        import pyarrow as pa

        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fold(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text modulo the number of folds; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % folds


def chosen(share: float | Column, seed: int, doc_id: str = "doc_id") -> Column:
    """Whether a row is among a share of all, by all bits of a hash of its id: so many rows at any size of table, give or take chance."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.xxhash64(doc_id, F.lit(seed)).cast("double") <= share * 2.0**64 - 2.0**63


def finite_vector(vector: str | Column) -> Column:
    """Whether an array is there and holds neither NULL, NaN nor infinite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash with those an operator adds."""
    return df.select(*[df[c] for c in cols])
