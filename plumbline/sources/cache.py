"""Model responses by key, as a store that a put changes in proportion to what is put.

Keys are dealt over buckets by hash. A put merges its rows with the newest generation of the buckets that they belong to and
writes a new generation of these alone (b=bucket/g=generation), sorted by key, with a Bloom filter on the key in each file; a
lookup reads the buckets of its keys, and a few keys are looked for by the filters. One writer at a time; readers see the
newest generation of each bucket, the one before stays for those that are under way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.ranking import last_wins
from plumbline.sources.schemas import schema

BUCKETS = 64


class Cache:
    """Rows of a schema with the columns key and order, by which the newest of a key stays."""

    def __init__(self, spark: SparkSession, path: str, fields: StructType | None = None, *, order: str = "created_at", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.order, self.buckets = spark, path, order, buckets
        self.fields = fields or schema("cache")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _listed(self, below: str, prefix: str) -> list[int]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}{below}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def generations(self, bucket: int) -> list[int]:
        return self._listed(f"/b={bucket}", "g=")

    def _newest(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/b={b}/g={own[-1]}" for b in buckets if (own := self.generations(b))]
        return self.spark.read.schema(self.fields).parquet(*paths) if paths else self.spark.createDataFrame([], self.fields)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most as many as buckets

    def read(self) -> DataFrame:
        return self._newest(self._listed("", "b="))

    def get(self, *keys: str) -> DataFrame:
        """The rows of a few keys: files whose Bloom filters rule them out aren't read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], "key string")
        return self._newest(self._touched(asked) if keys else []).filter(F.col("key").isin(*keys))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Requests (key, ...) with the cached columns beside them; hit tells which were found. Buckets that no request belongs to aren't read."""
        found = self._newest(self._touched(requests)).withColumn("hit", F.lit(True))
        return requests.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def put(self, fresh: DataFrame) -> list[int]:
        """Put responses in and give the buckets that were written; failed ones (error neither NULL nor empty) and rows without key are refused. Of a key the newest row stays."""
        ok = ~F.coalesce(F.col("error") != "", F.lit(False)) if "error" in fresh.columns else F.lit(True)
        rows = fresh.filter(ok & F.col("key").isNotNull()).select(*[F.col(f.name).cast(f.dataType) for f in self.fields])
        touched = self._touched(rows)
        if not touched:
            return []
        number = 1 + max([g for b in touched for g in self.generations(b)], default=0)
        merged = last_wins(self._newest(touched).unionByName(rows), ["key"], self.order)
        merged = merged.withColumns({"b": self._bucket(), "g": F.lit(number)}).repartition(len(touched), "b").sortWithinPartitions("b", "key")
        out = merged.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").option("parquet.bloom.filter.enabled#key", "true")
        out.partitionBy("b", "g").parquet(self.path)
        for b in touched:
            for g in self.generations(b)[:-2]:
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/b={b}/g={g}")
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return touched
