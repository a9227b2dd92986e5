"""Where tables that a job writes for itself go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share, deleted when the session's JVM ends. Where that is unset: of one machine, as in tests, below a temporary folder of this process; of a cluster, none, and that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        root = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    path = f"{root.rstrip('/')}/plumbline/{what}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(rows: DataFrame, what: str) -> DataFrame:
    """The rows as a table of a fresh folder: what is read several times is made once, and lost executors cost no recomputation of it."""
    at = folder(rows.sparkSession, what)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def dealt(rows: DataFrame, by: str, what: str) -> DataFrame:
    """The rows as a table of a fresh folder, in a bucket of its own column `by` for each shuffle partition: joins and groups by that column read it where it is."""
    spark = rows.sparkSession
    n, at = int(spark.conf.get("spark.sql.shuffle.partitions")), folder(spark, what)
    name = at.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(n, by).write.bucketBy(n, by).option("path", at).format("parquet").saveAsTable(name)
    return spark.table(name)
