"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A store is a folder: shards/ holds Parquet files that are never changed, manifests/ one JSON file per version: what the version
adds and takes away, and at every CHECKPOINT-th version all live shards, so that a commit writes little and a reader opens at
most CHECKPOINT files. A version is committed by renaming a finished file to the next version's name, which fails if that
exists: readers see all of a version or nothing, and of two writers one wins and the other starts again from the newer version.
This needs a file system whose rename is atomic and refuses an existing target, as HDFS and local disks do; object stores with
copying renames don't qualify.

Arrivals become small shards of tier 0. When a tier has FANOUT shards or more, its shards are merged, smallest first, into files
of at most about the target size, in one job that shuffles only the merged shards' rows, a task for each file to be made; merged
shards of the target size stay. Shards that were merged away stay, too, for readers of older versions, until `expire` forgets
those versions; `sweep` deletes what writers that failed or lost left behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.shared import new_path

FANOUT = 4
TARGET_BYTES = 64 << 20
#: Shards below so many bytes are of tier 0; each further tier is FANOUT times as large.
SMALLEST = 1 << 20
CHECKPOINT = 16
ATTEMPTS = 20
BROADCAST_SHARDS = 100_000


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def key(path: str) -> str:
    """A shard's path below the store, by which rows and manifest entries meet."""
    return path.rpartition("/shards/")[2]


def file_key() -> Column:
    return F.substring_index("_metadata.file_path", "/shards/", -1)


def by_shard(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of a row per shard, to be broadcast as long as there are at most BROADCAST_SHARDS."""
    table = spark.createDataFrame(rows, ddl)
    return F.broadcast(table) if len(rows) <= BROADCAST_SHARDS else table


class Expired(LookupError):
    """A version that is read after it has expired."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    # --- manifests

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self._path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def _name(self, version: int):
        return self._path(f"{self.root}/manifests/v{version:010d}.json")

    def _entry(self, version: int) -> dict:
        stream = self.fs.open(self._name(version))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def oldest(self) -> int:
        """The oldest version that hasn't expired: the greatest mark that an expiry has set."""
        folder = self._path(f"{self.root}/expired")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max([int(n[1:]) for n in names if n.startswith("v")], default=1)

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and live shards of a version, by default the newest; an expired version is an error (Expired)."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        if version < self.oldest():
            raise Expired(f"version {version} has expired; the oldest is {self.oldest()}")
        return self._manifest(version)

    def _manifest(self, version: int) -> dict:
        later = [self._entry(version)]
        while "shards" not in later[-1]:
            later.append(self._entry(later[-1]["version"] - 1))
        live = {s["path"]: s for s in later[-1]["shards"]}
        for entry in reversed(later[:-1]):
            for p in entry["removed"]:
                live.pop(p, None)
            live.update((s["path"], s) for s in entry["added"])
        return {"version": version, "schema": later[0]["schema"], "shards": [live[p] for p in sorted(live)]}

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Make base's successor with these shards the newest version, or raise Conflict."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        was, now = ({s["path"] for s in x["shards"]} for x in (base, new))
        entry = {"version": new["version"], "schema": schema, "added": [s for s in new["shards"] if s["path"] not in was], "removed": sorted(was - now)}
        if new["version"] % CHECKPOINT == 1:
            entry["shards"] = new["shards"]
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        target = self._name(new["version"])
        self.fs.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            context.rename(draft, target, options)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    def _committed(self, shards: Callable[[dict], list[dict]], schema: str) -> dict:
        """Commit what `shards` makes of the newest version's manifest; after a Conflict, of the then newest one."""
        for attempt in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self.commit(base, shards(base), schema)
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(0.01 * 2 ** min(attempt, 8))
        raise AssertionError

    def expire(self, keep: int = 1) -> list[str]:
        """Forget all versions but the newest `keep`, which from then on are an error to read, and delete the shards that only they list; their paths. Readers of those versions must have ended."""
        newest = self.version()
        first = max(newest - max(keep, 1) + 1, self.oldest())
        if not newest:
            return []
        live = {s["path"] for v in range(first, newest + 1) for s in self.manifest(v)["shards"]}
        known = [int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(self._path(f"{self.root}/manifests"))]
        old = sorted(v for v in known if v < first)
        ends = [v for v in old if v >= self.oldest()]  # those before have ended already
        gone = {s["path"] for v in ends[:1] for s in self._manifest(v)["shards"]} | {s["path"] for v in ends for s in self._entry(v)["added"]}
        gone -= live
        mark = self._path(f"{self.root}/expired/v{first:010d}")  # before anything goes
        if not self.fs.exists(mark):
            self.fs.create(mark, True).close()
        for p in sorted(gone):
            self.fs.delete(self._path(p), False)
        base = first - (first - 1) % CHECKPOINT  # what the manifests that stay are built on stays
        for v in old:
            if v < base:
                self.fs.delete(self._name(v), False)
        return sorted(gone)

    def sweep(self, older_than_s: float = 86_400) -> list[str]:
        """Delete shard files and drafts that no version lists and that are older than any writer at work can be; their paths."""
        newest, now = self.version(), time.time()
        if not newest:
            return []
        known = [int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(self._path(f"{self.root}/manifests"))]
        listed = {s["path"] for s in self.manifest(newest)["shards"]}
        for v in known:
            entry = self._entry(v)
            listed |= {s["path"] for s in [*entry["added"], *entry.get("shards", ())]}
        keys, gone = {key(p) for p in listed}, []
        for folder in ("shards", "drafts"):
            for p, _, written in self._walk(f"{self.root}/{folder}"):
                if now - written >= older_than_s and not (folder == "shards" and key(p) in keys):
                    self.fs.delete(self._path(p), False)
                    gone.append(p)
        return gone

    # --- shards

    def _walk(self, folder: str) -> list[tuple[str, int, float]]:
        """(path, bytes, time of writing) of all files below a folder."""
        found, todo = [], [self._path(folder)]
        while todo:
            at = todo.pop()
            for s in self.fs.listStatus(at) if self.fs.exists(at) else ():
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    found.append((s.getPath().toString(), s.getLen(), s.getModificationTime() / 1000))
        return sorted(found)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        return [(p, size) for p, size, _ in self._walk(folder) if p.endswith(".parquet")]

    def _counted(self, files: list[tuple[str, int]], schema: StructType) -> list[dict]:
        """Entries of files that hold rows; each file's count comes from one small row."""
        if not files:
            return []
        rows = {r["p"]: r["count"] for r in self.spark.read.schema(schema).parquet(*[p for p, _ in files]).groupBy(file_key().alias("p")).count().toLocalIterator()}
        return [{"path": p, "bytes": size, "rows": rows[key(p)], "tier": self.tier(size)} for p, size in files if key(p) in rows]

    def tier(self, size: int) -> int:
        t = 0
        while size >= SMALLEST and size < self.target * 2:
            size, t = size // self.fanout, t + 1
        return t

    def append(self, rows: DataFrame, waves: Column | None = None) -> dict:
        """Add rows as small shards. waves (an expression of integers): one write, but a version of its own for each value, and compaction after each FANOUT values."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        label = f"wave_{uuid.uuid4().hex[:8]}"
        schema = rows.schema
        rows.withColumn(label, F.lit(0) if waves is None else waves).write.option("compression", "zstd").partitionBy(label).parquet(folder)
        groups: dict[str, list[tuple[str, int]]] = {}
        for p, size in self._files(folder):
            groups.setdefault(p.split(f"{label}=")[1].split("/")[0], []).append((p, size))
        if not groups:
            return self._committed(lambda base: base["shards"], schema.json())
        made = {s["path"]: s for s in self._counted([f for own in groups.values() for f in own], schema)}
        for k, name in enumerate(sorted(groups, key=lambda x: (len(x), x)), 1):
            own = [made[p] for p, _ in groups[name] if p in made]
            out = self._committed(lambda base, own=own: base["shards"] + own, schema.json())
            if k % self.fanout == 0 and waves is not None:
                out = self.compact()
        return out

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards to merge: of each tier with at least FANOUT shards, smallest first, up to the target size each."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(s["tier"], []).append(s)
        groups = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            group, size = [], 0
            for s in sorted(own, key=lambda s: (s["bytes"], s["path"])):
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> dict:
        """Merge until no tier has FANOUT small shards or more; each round is a version. Another writer's appends meanwhile are kept; if another merged the same shards first, its merge counts and this one's files go."""
        while True:
            base = self.manifest()
            groups = self.plan(base["shards"])
            if not groups:
                return base
            schema = StructType.fromJson(json.loads(base["schema"]))
            of = [(key(s["path"]), k) for k, g in enumerate(groups) for s in g]
            label = f"run_{uuid.uuid4().hex[:8]}"
            table = by_shard(self.spark, of, f"file_{label} string, {label} int")
            rows = self.spark.read.schema(schema).parquet(*[s["path"] for g in groups for s in g])
            rows = rows.select("*", file_key().alias(f"file_{label}")).join(table, f"file_{label}").drop(f"file_{label}")
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            rows.repartitionById(len(groups), label).write.option("compression", "zstd").partitionBy(label).parquet(folder)
            merged = self._counted(self._files(folder), schema)
            gone = {s["path"] for g in groups for s in g}
            if sum(s["rows"] for s in merged) != sum(s["rows"] for g in groups for s in g):
                raise RuntimeError("a merge lost rows")

            def swapped(now: dict, gone: set[str] = gone, merged: list[dict] = merged) -> list[dict]:
                if not gone <= {s["path"] for s in now["shards"]}:
                    raise LookupError
                return [s for s in now["shards"] if s["path"] not in gone] + merged

            try:
                done = self._committed(swapped, base["schema"])
            except LookupError:
                self.fs.delete(self._path(folder), True)
                continue
            if len(merged) >= len(gone):
                return done

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version's live shards; older versions until they expire."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"])) if m["schema"] else StructType()
        paths = [s["path"] for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def query(spark, sf_dir: str, waves: int = 8) -> DataFrame:
    """Documents arrive in eight waves; where each ends up after compaction: doc_id, shard (number in the manifest), tier, shard_rows, text_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, new_path(spark, "store"))
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(waves)))
    shards = store.compact()["shards"]
    rows = store.read()
    place = [(key(s["path"]), k, s["tier"], s["rows"]) for k, s in enumerate(shards)]
    table = by_shard(spark, place, "file string, shard int, tier int, shard_rows long")
    file = file_key() if place else F.lit("")
    return rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), file.alias("file")).join(table, "file").select("doc_id", "shard", "tier", "shard_rows", "text_sha256")


