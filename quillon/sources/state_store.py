"""A versioned store of session states: saved by session, committed by one rename.

A folder holds ``data``, written once and never changed, and ``commits``, one
small file for each version.  A commit names, for each bucket of sessions, the
folder with that bucket's states.  Saving writes the buckets that it touches
anew, beside the old ones, and then commits; until then nobody sees them.  Two
writers that touch different buckets both succeed; of two that touch the same
one the later sees the other's commit and merges again.  A commit is a list of
as many entries as there are buckets, whatever the number of sessions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.states import STATE, empty, stamped

#: Buckets of sessions of a new store, and attempts to commit among other writers.
BUCKETS, ATTEMPTS = 64, 20


@dataclass(frozen=True)
class Commit:
    """One version: the number of buckets, and the folder of each bucket that has states."""

    version: int
    buckets: int
    folders: dict[int, str]


class Conflict(RuntimeError):
    """Other writers kept changing the same buckets."""


class StateStore:
    """SRC-11, SRC-12, SNK-1: the states below a path that all machines reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The committed versions in order."""
        folder = self._at("commits")
        names = [x.getPath().getName() for x in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def commit(self, version: int | None = None) -> Commit:
        """A version, by default the latest; version 0 has no states."""
        latest = (self.versions() or [0])[-1] if version is None else version
        if not latest:
            return Commit(0, self.buckets, {})
        stream = self._files.open(self._at(f"commits/{latest:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Commit(latest, found["buckets"], {int(b): f for b, f in found["folders"].items()})

    def _publish(self, commit: Commit) -> bool:
        """Writes a commit under another name and renames it; False if the version is there already."""
        options = self._jvm.org.apache.hadoop.fs.Options
        hidden, name = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{commit.version:012d}.json")
        stream = self._files.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps({"buckets": commit.buckets, "folders": commit.folders}).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri() if "://" in self.path else self._files.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 0)
        try:
            context.rename(hidden, name, plain)  # never over a file that is there
            return True
        except Py4JJavaError as e:
            self._files.delete(hidden, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("sessionId"), F.lit(buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return empty(self.spark)
        return self.spark.read.schema(STATE).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def load(self, sessions: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The states of a version, by default the latest; with ``sessions`` theirs alone, from the buckets that can hold them."""
        at = self.commit(version)
        if sessions is None:
            return self._rows(sorted(at.folders.values()))
        named = self.spark.createDataFrame([(s,) for s in sessions], "sessionId string")
        wanted = {r[0] for r in named.select(self._bucket(at.buckets)).distinct().collect()}
        return self._rows(sorted(f for b, f in at.folders.items() if b in wanted)).join(F.broadcast(named.distinct()), "sessionId", "left_semi").select(*empty(self.spark).columns)

    def save(self, states: DataFrame) -> int:
        """Puts states in place of those of the same sessions and returns the new version; of two rows of a session the one updated last counts.

        Rows without sessionId are left out.  No rows: no new version.
        """
        own = uuid.uuid4().hex
        latest = F.row_number().over(W.partitionBy("sessionId").orderBy(F.desc_nulls_last("lastUpdated"), F.to_json("prune")))
        some = states.filter("sessionId is not null").withColumn("_rn", latest).filter("_rn = 1").drop("_rn")
        stamped(some).write.parquet(f"{self.path}/data/{own}/new")
        new = self.spark.read.schema(STATE).parquet(f"{self.path}/data/{own}/new")
        base, folders, touched = None, {}, set()
        for attempt in range(ATTEMPTS):
            now = self.commit()
            if base is None or now.buckets != base.buckets or any(now.folders.get(b) != base.folders.get(b) for b in touched):
                touched = {r[0] for r in new.select(self._bucket(now.buckets)).distinct().collect()}  # buckets at most
                if not touched:
                    return now.version
                folders = self._merged(new, now, touched, f"{own}/try{attempt}")
            base = now  # where other writers changed other buckets alone, what is merged still holds
            if self._publish(Commit(base.version + 1, base.buckets, base.folders | folders)):
                self._files.delete(self._at(f"data/{own}/new"), True)
                return base.version + 1
        raise Conflict(f"{ATTEMPTS} attempts to save met other writers")

    def _merged(self, new: DataFrame, base: Commit, touched: set[int], name: str) -> dict[int, str]:
        """Writes the touched buckets with the new states in place of old ones."""
        old = self._rows(sorted(f for b, f in base.folders.items() if b in touched))
        kept = old.join(new.select("sessionId"), "sessionId", "left_anti").select(*new.columns)
        rows = kept.unionByName(new).withColumn("bucket", self._bucket(base.buckets))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        return {b: f"{name}/bucket={b}" for b in touched}

    def delete(self, sessions: list[str]) -> int:
        """A version without these sessions."""
        for _ in range(ATTEMPTS):
            base = self.commit()
            named = self.spark.createDataFrame([(s,) for s in sessions], "sessionId string")
            touched = {r[0] for r in named.select(self._bucket(base.buckets)).distinct().collect()} & set(base.folders)
            if not touched:
                return base.version
            left = self._rows(sorted(base.folders[b] for b in touched)).join(F.broadcast(named), "sessionId", "left_anti").withColumn("bucket", self._bucket(base.buckets))
            name = uuid.uuid4().hex
            left.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            full = {r["bucket"] for r in left.select("bucket").distinct().collect()}
            folders = {b: f for b, f in base.folders.items() if b not in touched} | {b: f"{name}/bucket={b}" for b in full}
            if self._publish(Commit(base.version + 1, base.buckets, folders)):
                return base.version + 1
        raise Conflict(f"{ATTEMPTS} attempts to delete met other writers")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last ``keep``, and what no version names; not while others write."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._files.delete(self._at(f"commits/{v:012d}.json"), False)
        used = {f for v in versions[-keep:] for f in self.commit(v).folders.values()}
        if not self._files.exists(self._at("data")):
            return
        for run in self._files.listStatus(self._at("data")):
            name = run.getPath().getName()
            if not any(f.startswith(f"{name}/") for f in used):
                self._files.delete(run.getPath(), True)
