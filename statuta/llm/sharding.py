"""Sharding by size-tiered compaction (operator 8), in DataFrame functions only.

A store is a folder: data/<run>/*.parquet, immutable shards, and manifest/v<n>.json, which names the runs that
make up version n. An arrival is written as a run of small shards and becomes visible by the next manifest.
Compaction sorts runs whose shards are below the target size into tiers by the mean size of their shards, each
`fanout` times as large as the one before; a tier with `fanout` shards or more is rewritten into a run of files
of about the target size, and the manifest that names the new run in place of the old ones is committed. A
commit writes its manifest under another name and renames it to v<n>.json, which fails where that exists: a
writer that comes second reads the new state and tries again. Readers see one version whole. Runs that no
longer belong to the last version are deleted by vacuum().

A manifest has an entry for each run, not for each shard, and only for runs that are still open or were filled
lately: full ones, which no plan needs, move to list files of LIST runs that manifests name. So a commit writes
a few hundred entries, whatever the store holds, and reading goes by folder, which Spark lists in parallel.

A job that dies leaves files that no manifest names; a lost executor's tasks are run again by Spark, whose
committer publishes a task's file once. Rewriting goes file by file without a shuffle, so neither a source
nor a key can be hot: a task reads shards of about the target size, whatever they hold.

Nulls, empty texts and texts of any length are rows like others; a shard ends at its number of rows. Repeated
rows stay repeated. Runs of equal size share a tier, older ones first. An arrival without rows adds no run.
Columns may have any names but those of shard places.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import common

#: Target bytes of a shard, the growth of tiers, and rows of an arrival's shard.
TARGET, FANOUT, ARRIVAL_ROWS = 128 << 20, 4, 2_000
#: Full runs that a manifest names itself; so many move to a list file together.
LIST = 256
#: Arrivals that the query makes of its table.
ARRIVALS = 4
_TRIES = 20


class CommitConflict(RuntimeError):
    """Others kept committing first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, arrival_rows: int = ARRIVAL_ROWS):
        self.spark, self.root, self.target, self.fanout, self.arrival_rows = spark, root.rstrip("/"), target, fanout, arrival_rows
        self._jvm = spark.sparkContext._jvm
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._hadoop)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _store(self, name: str, content: dict) -> None:
        out = self._fs().create(self._path(name), False)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()

    def head(self, version: int | None = None) -> dict:
        """{version, open, full: runs {path, files, bytes, level}, lists: files of more full runs}; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        return self._load(f"manifest/v{version:08d}.json") if version else {"version": 0, "open": [], "full": [], "lists": []}

    def runs(self, version: int | None = None) -> list[dict]:
        """All runs of a version."""
        head = self.head(version)
        return [r for name in head["lists"] for r in self._load(name)["runs"]] + head["full"] + head["open"]

    def _publish(self, manifest: dict) -> bool:
        """Whether this manifest became its version."""
        jvm, fs = self._jvm, self._fs()
        name = f"manifest/.draft-{uuid.uuid4().hex}"
        draft = self._path(name)
        self._store(name, manifest)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._hadoop).rename(draft, self._path(f"manifest/v{manifest['version']:08d}.json"), none)
            return True
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _commit(self, added: dict | None, removed: set[str]) -> dict | None:
        """Adds a run and removes open ones in the next version; None if another writer removed some of them meanwhile."""
        for _ in range(_TRIES):
            now = self.head()
            if not removed <= {r["path"] for r in now["open"]}:
                return None
            left = [r for r in now["open"] if r["path"] not in removed] + ([added] if added else [])
            new = {"version": now["version"] + 1, "open": [r for r in left if self.tier(r)], "full": now["full"] + [r for r in left if not self.tier(r)], "lists": now["lists"]}
            if len(new["full"]) > LIST:
                name = f"manifest/list-{uuid.uuid4().hex}.json"
                self._store(name, {"runs": new["full"]})
                new |= {"full": [], "lists": [*now["lists"], name]}
            if self._publish(new):
                return new
        raise CommitConflict(self.root)

    def _write(self, df: DataFrame, level: int, rows: int = 0) -> dict | None:
        """A run with these rows; None if there are none."""
        run = f"data/{level}-{uuid.uuid4().hex[:16]}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(f"{self.root}/{run}")
        sizes = [s.getLen() for s in self._fs().listStatus(self._path(run)) if s.getPath().getName().endswith(".parquet")]
        if not sizes or (level == 0 and self._read([run]).limit(1).count() == 0):
            return None
        return {"path": run, "files": len(sizes), "bytes": sum(sizes), "level": level}

    def append(self, df: DataFrame) -> dict:
        """An arrival: small shards, and the version that has them."""
        return self._commit(self._write(df, 0, self.arrival_rows), set())

    def tier(self, run: dict) -> int:
        """0 for full runs; else n, where target / fanout ** n is below the mean size of a shard at last."""
        mean = run["bytes"] / run["files"]
        # what was rewritten into files of the target size or half of it counts as full, else it would be written again and again
        if mean >= self.target or run["level"] and (run["files"] > 1 or mean >= 0.5 * self.target):
            return 0
        return max(1, math.ceil(math.log(self.target / max(mean, 1), self.fanout) - 1e-9))

    def plan(self) -> list[list[dict]]:
        """Runs of similar size that are due: each tier below the target with at least fanout shards."""
        tiers: dict[int, list[dict]] = {}
        for r in self.head()["open"]:
            tiers.setdefault(self.tier(r), []).append(r)
        return [runs for _, runs in sorted(tiers.items(), reverse=True) if sum(r["files"] for r in runs) >= self.fanout]

    def compact(self) -> int:
        """Rewrites each due tier once and commits; the number of rewritten shards."""
        done = 0
        for runs in self.plan():
            files = max(1, round(sum(r["bytes"] for r in runs) / self.target))
            added = self._write(self._read([r["path"] for r in runs]).coalesce(files), 1 + max(r["level"] for r in runs))
            if self._commit(added, {r["path"] for r in runs}) is not None:
                done += sum(r["files"] for r in runs)
        return done

    def compact_all(self) -> int:
        rounds = 0
        while self.compact() and rounds < 64:
            rounds += 1
        return rounds

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in paths))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it has none."""
        paths = [r["path"] for r in self.runs(version)]
        return self._read(paths) if paths else None

    def vacuum(self) -> int:
        """Deletes runs that the last version doesn't have; their number. Only when no reader or writer is at work."""
        fs, kept, gone = self._fs(), {r["path"] for r in self.runs()}, 0
        if fs.exists(self._path("data")):
            for run in fs.listStatus(self._path("data")):
                if f"data/{run.getPath().getName()}" not in kept:
                    fs.delete(run.getPath(), True)
                    gone += 1
        return gone


def op8_compaction(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}", target=32 << 20)
    arrival = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.filter(arrival == k))
    store.compact_all()
    store.vacuum()
    rows, version = store.read(), store.head()["version"]
    some = rows is not None
    rows = rows if some else docs.limit(0)
    place = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1) if some else F.lit("")
    size = F.col("_metadata.file_size") if some else F.lit(0)
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), place.alias("shard"), size.cast("long").alias("shard_bytes"), F.lit(version).alias("version"))
