"""Calls of model services as rounds of Spark jobs.

A round asks for every request that is still open, and is written down, so nothing is asked twice because something is computed
again. What failed in a way that may pass goes into the next round. Bounds hold for the whole job: a round has no
more tasks than calls may run at a time, and each task's share of them; what a day allows is taken from a ledger that all rounds and
jobs share before the calls are made. Clients are the caller's.
"""

from __future__ import annotations

import asyncio
import random
import time
from collections.abc import Awaitable, Callable, Iterator, Mapping

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from plumbline.sources.cache import Cache
from plumbline.sources.readers import exists
from plumbline.sources.scratch import folder, written

#: Statuses that may pass, rounds, the first and longest wait between rounds in seconds, and kinds of services.
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)
ROUNDS, BASE_S, CAP_S = 4, 0.5, 30.0
SERVICES = ("openai_compat", "google", "anthropic")
DAY_S = 86_400

Call = Callable[[dict], Awaitable[dict]]


def backoff(attempt: Column, base: float = BASE_S, cap: float = CAP_S, jitter: Column | None = None) -> Column:
    """Seconds before a retry after attempt number 1, 2 and so on: a share (jitter, from 0 up to 1; unset, all) of a doubling time. An attempt below 1 is an error."""
    wait = F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1)) * (F.lit(1.0) if jitter is None else jitter)
    return F.when(attempt >= 1, wait).otherwise(F.raise_error(F.lit("attempts are numbered from 1")).cast("double"))


def retryable(status: Column) -> Column:
    """Whether a call with this HTTP status may succeed later; NULL for success."""
    return F.when(~status.between(200, 299), status.isin(*RETRYABLE))


class CallFailed(Exception):
    """What a client raises for a call that failed with an HTTP status, which says whether another round may help."""

    def __init__(self, status: int, reason: str = "") -> None:
        super().__init__(status, reason)
        self.status, self.reason = status, reason

    def __str__(self) -> str:
        return f"status {self.status}" + (f", {self.reason}" if self.reason else "")


def may_pass(failure: Exception) -> bool:
    """By its status, or because nothing came back; other errors are the caller's and stay."""
    return failure.status in RETRYABLE if isinstance(failure, CallFailed) else isinstance(failure, (TimeoutError, ConnectionError))


class Ledger:
    """Calls of the last 24 hours of all jobs that name the same folder, and how many a day allows.

    An entry is written before its calls are made, and holds for them whether they are answered or not. Calls that a task makes
    again because its executor was lost aren't in it. Jobs that begin a round in the same second may both see what is left.
    """

    def __init__(self, spark: SparkSession, path: str, per_day: int, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.per_day, self.clock = spark, path, per_day, clock

    def used(self) -> int:
        if not exists(self.spark, self.path):
            return 0
        rows = self.spark.read.schema("at double, calls long").parquet(self.path)
        return rows.filter(F.col("at") > self.clock() - DAY_S).agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]

    def take(self, wanted: int) -> int:
        """How many of the wanted calls may be made; they count from now on."""
        granted = max(0, min(wanted, self.per_day - self.used()))
        if granted:
            self.spark.createDataFrame([(self.clock(), granted)], "at double, calls long").coalesce(1).write.mode("append").parquet(self.path)
        return granted


async def _asked(rows: Iterator[dict], call: Call, width: int) -> list[dict]:
    """Replies to all rows, by `width` callers who each take the next row."""
    out = []

    async def caller() -> None:
        for row in rows:
            try:
                out.append({"error": None, "again": False, **await call(row), "key": row["key"]})
            except Exception as e:  # noqa: BLE001  what a client raises is its own affair
                out.append({"key": row["key"], "error": f"{type(e).__name__}: {e}", "again": may_pass(e)})

    await asyncio.gather(*(caller() for _ in range(width)))
    return out


def with_model(
    requests: DataFrame,
    call: Call,
    schema: str,
    *,
    width: int = 8,
    rounds: int = ROUNDS,
    base: float = BASE_S,
    cap: float = CAP_S,
    ledger: Ledger | None = None,
    progress: Callable[[dict], None] | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """A reply of an asynchronous model call for each request, in columns of the schema, which has key and error.

    requests need a column key; call takes a row as a dict, with the number of the round as `round`, and gives a dict of the
    schema's columns. A call that fails for
    good, and one that fails in all rounds, gives its key and the error; so does one that the ledger's day doesn't allow any more.
    At most `width` calls of the job run at a time. progress is told after each round how many requests are answered, failed,
    refused by the ledger, and open.
    """
    if width < 1 or rounds < 1:
        raise ValueError("width and rounds must be positive")
    spark, at = requests.sparkSession, folder(requests.sparkSession, "calls")
    fields = StructType.fromDDL(schema)
    names, kind = fields.names, StructType([*fields.fields, StructField("again", BooleanType())])

    def kept(rows: DataFrame, what: str) -> DataFrame:
        rows.write.parquet(f"{at}/{what}")
        return spark.read.schema(rows.schema).parquet(f"{at}/{what}")

    none = kept(spark.createDataFrame([], fields), "none")
    ended, left = none, kept(requests, "open-0")
    counts = {"answered": 0, "failed": 0, "refused": 0}
    for k in range(1, rounds + 1):
        n = left.count()
        granted = n if ledger is None else ledger.take(n)
        asked = left if granted == n else kept(left.limit(granted), f"asked-{k}")
        if granted < n:
            refused = left.join(asked.select("key"), "key", "left_anti").select("key").withColumn("error", F.lit(f"the day's {ledger.per_day} calls are used up"))
            ended = ended.unionByName(refused.select(*[(F.col(c) if c in ("key", "error") else F.lit(None)).cast(fields[c].dataType).alias(c) for c in names]))
            counts["refused"] += n - granted
        if not granted:
            break
        tasks = min(width, granted)

        def run(frames: Iterator[pd.DataFrame], tasks: int = tasks, k: int = k) -> Iterator[pd.DataFrame]:
            place = TaskContext.get().partitionId()
            own = width // tasks + (place < width % tasks)
            for frame in frames:
                replies = asyncio.run(_asked(iter(frame.assign(round=k).to_dict("records")), call, own))
                yield pd.DataFrame([[r.get(c) for c in kind.names] for r in replies], columns=kind.names)

        replies = kept(asked.repartition(tasks).mapInPandas(run, kind), f"replies-{k}")
        again = replies.filter("again").select("key") if k < rounds else none.select("key")
        final = replies.filter(~F.col("again")) if k < rounds else replies
        ended = ended.unionByName(final.select(*names))
        done = final.agg(F.count_if(F.col("error").isNull()), F.count("error")).first()
        counts = {**counts, "answered": counts["answered"] + done[0], "failed": counts["failed"] + done[1]}
        left = kept(asked.join(again, "key", "left_semi"), f"open-{k}")
        still = left.count()
        if progress:
            progress({"round": k, **counts, "open": still})
        if not still:
            break
        sleep(random.random() * min(cap, base * 2 ** (k - 1)))
    return ended


def read_through(requests: DataFrame, cache: DataFrame | Cache, call: Call, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """(answers, fresh): cached answers, and those of a model for requests that aren't cached. fresh, without its errors, is what to append to the cache; a Cache has it already, under the time of the call where the schema has none."""
    names = StructType.fromDDL(schema).names
    if isinstance(cache, Cache):
        found = cache.lookup(requests.select("key"))
        known, missing = found.filter("hit"), requests.join(found.filter("NOT hit").select("key"), "key", "left_semi")
    else:
        known, missing = requests.select("key").join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti")
    fresh = with_model(missing, call, schema, **options)
    answers = known.select(*[F.col(c) if c in known.columns else F.lit(None).alias(c) for c in names]).unionByName(fresh)
    if isinstance(cache, Cache):
        answers = written(answers, "answers")  # before the put: what is known is read from what it replaces
        there = {cache.order: F.current_timestamp()} if cache.order not in names else {}
        cache.put(fresh.withColumns({**{f.name: F.lit(None).cast(f.dataType) for f in cache.fields if f.name not in names}, **there}))
    return answers, fresh.filter("error IS NULL")


def preflight(call: Call, prompt: str = "Say that you are ready.") -> str | None:
    """One short call before a job of many: None if it is answered, else why not."""
    [reply] = asyncio.run(_asked(iter([{"key": "preflight", "prompt": prompt, "max_tokens": 16}]), call, 1))
    return reply["error"]


def clients(spark: SparkSession, config: Mapping, env: Mapping[str, str]) -> DataFrame:
    """(role, service, kind, model, family, base_url, api_key_env, width, per_day, thinks, cot_prompt, error) of every role of a configuration.

    A role's own base_url goes before its service's; ${NAME} in it is the environment's. error says what keeps a role from being
    used: an unknown service or kind, an unset name, or no key where the kind needs one. Keys themselves stay in the environment.
    """
    named = [(r, s) for r, s in {**config, **(config.get("generators") or {})}.items() if isinstance(s, Mapping) and "provider" in s]
    own = spark.createDataFrame([(r, s["provider"], s.get("model"), s.get("family"), s.get("base_url"), s.get("supports_thinking"), s.get("cot_prompt")) for r, s in named], "role string, service string, model string, family string, own_url string, thinks boolean, cot_prompt boolean")
    services = [(n, s.get("kind"), s.get("base_url"), s.get("api_key_env"), s.get("max_concurrency"), s.get("requests_per_day")) for n, s in (config.get("providers") or {}).items()]
    of = spark.createDataFrame(services, "service string, kind string, url string, api_key_env string, width int, per_day long")
    known = F.array(*[F.lit(k) for k in env]).cast("array<string>")
    values = F.from_json(F.to_json(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in env.items()])), "array<struct<key:string,value:string>>")
    url = F.coalesce(F.nullif("own_url", F.lit("")), "url", F.lit(""))
    unset = F.array_except(F.regexp_extract_all("said", F.lit(r"\$\{(\w+)\}"), 1), known)
    error = (
        F.when(F.col("there").isNull(), F.concat(F.lit("unknown service "), "service"))
        .when(~F.coalesce(F.col("kind").isin(*SERVICES), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("none"))))
        .when((F.col("kind") != "openai_compat") & ~F.coalesce(F.array_contains(known, F.col("api_key_env")), F.lit(False)), F.concat(F.lit("no key in "), F.coalesce("api_key_env", F.lit("the configuration"))))
        .when(F.size(unset) > 0, F.concat(F.array_join(unset, ", "), F.lit(" not set")))
    )
    rows = own.join(of.withColumn("there", F.lit(True)), "service", "left").withColumn("said", url)
    filled = F.aggregate(values, F.col("said"), lambda u, e: F.replace(u, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"])) if env else F.col("said")
    no = F.lit(False)
    return rows.select("role", "service", "kind", "model", "family", filled.alias("base_url"), "api_key_env", F.coalesce("width", F.lit(4)).alias("width"), "per_day", F.coalesce("thinks", no).alias("thinks"), F.coalesce("cot_prompt", no).alias("cot_prompt"), error.alias("error"))
