"""Configuration, reports and other small documents on the driver; stores and sheets that are written from tables."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.schemas import schema

#: How far a stated number may be from the artefact's.
TOLERANCE = 5e-5
_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_CLAIM = re.compile(r"\b([A-Za-z]+|[0-9]+) of nine\b", re.I)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small document from any store that Spark reads."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _file_system(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON document, which must be a mapping."""
    text = read_text(spark, path)
    try:
        import yaml
    except ImportError:  # JSON is YAML, too
        made = json.loads(text)
    else:
        made = yaml.safe_load(text)
    if not isinstance(made, dict):
        raise ValueError(f"{path}: expected a mapping")
    return made


def read_optional(spark: SparkSession, path: str):
    """A JSON artefact, or None where it is missing or doesn't parse: the step that needs it is left out then."""
    p, fs = _file_system(spark, path)
    if not fs.exists(p):
        return None
    try:
        return json.loads(read_text(spark, path))
    except ValueError:
        return None


def expand_env(value: str, env: Mapping[str, str]) -> str:
    """${NAME} replaced by the environment's value; an unset name is an error."""

    def put(m: re.Match) -> str:
        if m[1] not in env:
            raise KeyError(f"{m[1]} is not set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", put, value)


def resolve(document, path: str):
    """The value at a dotted path; list places are numbers. A missing step is a KeyError."""
    value = json.loads(document) if isinstance(document, str) else document
    for step in path.split("."):
        try:
            value = value[int(step)] if isinstance(value, list) else value[step]
        except (IndexError, KeyError, TypeError, ValueError) as e:
            raise KeyError(path) from e
    return value


def ledger_mismatches(rows: Sequence[tuple[str, str, str, str]], artefacts: Mapping[str, object]) -> list[str]:
    """What is wrong with ledger rows (id, stated, artefact, path): missing artefacts and paths, and values that differ, numbers by TOLERANCE or more."""
    out = []
    for name, stated, artefact, path in rows:
        if artefact not in artefacts:
            out.append(f"{name}: {artefact} not found")
            continue
        try:
            actual = resolve(artefacts[artefact], path)
        except KeyError:
            out.append(f"{name}: no {path} in {artefact}")
            continue
        try:
            same = actual == stated if isinstance(actual, str) else abs(float(actual) - float(stated)) < TOLERANCE
        except (TypeError, ValueError):
            same = False
        if not same:
            out.append(f"{name}: stated {stated}, {artefact}:{path} has {actual}")
    return out


def claim_mismatches(text: str, comparisons: Sequence[Mapping]) -> list[str]:
    """Sentences `N of nine` that differ from the paired comparisons. A claim is about practical significance if that is named, within 200 characters, before statistical significance or an interval that excludes zero."""
    counts = {kind: sum(bool(c[f"{kind}_significant"]) for c in comparisons) for kind in ("statistically", "practically")}
    out = []
    for m in _CLAIM.finditer(text):
        word = m[1].lower()
        said = int(word) if word.isdigit() else 0 if word == "none" else _NUMBERS.index(word) if word in _NUMBERS else None
        if said is None:
            continue
        near = " ".join(text[m.start() : m.start() + 200].lower().split())
        first = lambda *marks: min([near.find(x) for x in marks if x in near], default=len(near))  # noqa: E731, B023
        kind = "practically" if first("practical", "threshold") < first("statistically significant", "exclude zero", "excluding zero") else "statistically"
        if said != counts[kind]:
            out.append(f"{m[0]!r}: {said} {kind} significant, the comparisons have {counts[kind]}")
    return out


# --- stores and sheets


def write_seeds(seeds: DataFrame, path: str) -> None:
    """Seeds as JSON lines, extra passages included."""
    names = ["seed_id", "source", "query", "answer", "passages", "extra_passages"]
    seeds.select(*names).write.mode("overwrite").json(path, ignoreNullFields=False)


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema("seed")).json(path, mode="FAILFAST")
    return rows.withColumn("extra_passages", F.coalesce("extra_passages", F.array().cast(rows.schema["extra_passages"].dataType)))


def write_scored(scored: DataFrame, path: str) -> None:
    """Scored rows as JSON lines, in order of configuration within and across files."""
    scored.repartitionByRange("config_id").sortWithinPartitions("config_id", "case_id").write.mode("overwrite").json(path, ignoreNullFields=False)


def write_rating_sheets(sample: DataFrame, folder: str) -> None:
    """The blind sheet and, apart from it, the judge's scores; one file each, as a sample is of a stated, small size."""
    from plumbline.operators.judging import judge_sheet, rating_sheet

    for name, sheet in (("ratings", rating_sheet(sample)), ("judge_scores", judge_sheet(sample))):
        sheet.orderBy("item").coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True, emptyValue="")


def read_sheet(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).csv(path, header=True, multiLine=True, escape='"')


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("passage_id", "vector").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, ids: str, vectors: str) -> DataFrame:
    """(passage_id, vector) from a file of ids and one of vectors (JSON arrays), a line each and in the same order; files of different length are an error."""
    line = lambda path, name: spark.read.text(path).select(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("at"), F.col("value").alias(name))
    place = F.row_number().over(Window.partitionBy("f").orderBy("at"))
    part = lambda path, name: line(path, name).withColumn("n", place).select(F.regexp_extract("f", r"(\d+)", 1).alias("part"), "n", name)
    both = part(ids, "passage_id").join(part(vectors, "v"), ["part", "n"], "full")
    short = F.col("passage_id").isNull() | F.col("v").isNull()
    pid = F.when(short, F.raise_error(F.lit("ids and vectors differ in number")).cast("string")).otherwise(F.col("passage_id"))
    return both.select(pid.alias("passage_id"), F.from_json("v", "array<float>").alias("vector"))


def record_results(rows: DataFrame, path: str) -> None:
    """Append rows to a result log; `result_index` tells afterwards which keys are done."""
    rows.write.mode("append").json(path, ignoreNullFields=False)


def result_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, done) of a log that record_results wrote to, which may not exist yet: done by a key's last row."""
    from plumbline.operators.runs import log_state

    p, fs = _file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], "key string, done boolean")
    rows = spark.read.schema("key string, line_no long, error string").json(path).filter("key IS NOT NULL")
    return log_state(rows).select("key", "done")
