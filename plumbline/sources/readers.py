"""Readers and writers of cases, seeds, logs, labels and reports. Paths may be in any store that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.testbeds import checked
from plumbline.sources.artefacts import expand_env, resolve, write_vectors  # noqa: F401  read and written elsewhere, offered here
from plumbline.sources.schemas import schema


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cases(spark: SparkSession, path: str, *, validate: bool = True, missing_ok: bool = False) -> DataFrame:
    """JSON lines of cases. A malformed line is an error when it is read, and so, if asked for, is a broken invariant; a missing file is empty if allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema("case"))
    rows = spark.read.schema(schema("case")).json(path, mode="FAILFAST").filter("case_id IS NOT NULL")
    return checked(rows) if validate else rows


def read_cases_by_id(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a file, the last row of a repeated id in file order."""
    rows = read_cases(spark, path, validate=False).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("line"))
    keep = [c for c in rows.columns if c not in ("case_id", "line")]
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*keep), "line").alias("row")).select("case_id", "row.*")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document with an array of seeds; seeds of older files have no extra passages."""
    rows = spark.read.schema(schema("seed")).json(path, multiLine=True, mode="FAILFAST")
    return rows.withColumn("extra_passages", F.coalesce("extra_passages", F.array().cast(rows.schema["extra_passages"].dataType)))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of an append-only result log: lines that don't parse are kept apart, rows without key left out."""
    rows = spark.read.schema(schema("result").add("_corrupt_record", "string")).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    good = rows.filter(F.col("_corrupt_record").isNull() & F.col("key").isNotNull()).drop("_corrupt_record")
    return good, spark.read.text(path).filter((F.trim("value") != "") & F.from_json("value", "key string", {"mode": "PERMISSIVE"}).getField("key").isNull())


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored rows with the class taken from the configuration."""
    return spark.read.schema(schema("scored")).json(path).withColumn("pipeline_class", F.split("config_id", r"\|")[0])


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Label sheets as one table with answers in lower case; missing files are skipped and blank answers left out."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema("label_sheet"))
    rows = spark.read.schema(schema("label_sheet")).csv(there, header=True, multiLine=True, quote='"', escape='"')
    return rows.withColumn("answer_yes_no", F.lower(F.trim("answer_yes_no"))).filter(F.col("answer_yes_no").isin("yes", "no"))


def read_ratios(spark: SparkSession, path: str) -> DataFrame:
    """Proxy scores by instance; a missing file is empty, as the analysis goes on without them."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema("ratios"))
    return spark.read.schema(schema("ratios")).json(path)


def passage_texts(cases: DataFrame) -> DataFrame:
    """passage_id -> text over all cases, the first by case id and place."""
    rows = cases.select("case_id", F.posexplode("passages").alias("pos", "p"))
    return rows.groupBy(F.col("p.passage_id").alias("passage_id")).agg(F.min_by("p.text", F.struct("case_id", "pos")).alias("text"))


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").partitionBy("dimension").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append to the log; files appear whole or not at all."""
    results.write.mode("append").json(path)


def write_label_sheet(sample: DataFrame, checklist: DataFrame, path: str) -> None:
    """A blank sheet: each sampled case with its dimension's questions."""
    rows = sample.join(F.broadcast(checklist), "dimension").withColumns({"answer_yes_no": F.lit(""), "notes": F.lit("")})  # a handful of questions
    rows.select("case_id", "dimension", "question_no", "question", "answer_yes_no", "notes").write.mode("overwrite").csv(path, header=True)


def report(frames: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small result tables as one JSON document; more rows than `most` are an error."""
    out = {}
    for name, df in frames.items():
        rows = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [json.loads(r) for r in rows]
    return json.dumps(out, sort_keys=True)


def forbidden_families(roles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Families (role, family) that two roles of a forbidden pair (role_a, role_b) share. Repeated rows count once before roles meet, so they make no product."""
    roles, pairs = roles.select("role", "family").distinct(), pairs.select("role_a", "role_b").distinct()
    a, b = roles.select(F.col("role").alias("role_a"), "family"), roles.select(F.col("role").alias("role_b"), "family")
    return pairs.join(a, "role_a").join(b, ["role_b", "family"]).select("role_a", "role_b", "family")


def numbered_lines(rows: DataFrame, order: str, by: list[str]) -> DataFrame:
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
