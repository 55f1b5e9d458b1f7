"""A table with one row per key that streams keep up to date, a few buckets at a time.

Rows are dealt to a fixed number of buckets by a hash of their key.  A version of the table is a manifest: for each
bucket the folder that holds it, and for each stream the last batch that went in.  A merge reads and writes only the
buckets that its rows fall into, and commits by creating the next manifest, which only one writer can do.  A writer that
comes second starts again from the first one's version, but only for buckets that have changed since; so nobody's rows
are lost.  A repeated batch is known by its stream, which goes by the id in its checkpoint, and is left out.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import few_files

#: Versions that stay for readers which are still at them.
KEPT_VERSIONS = 4
BUCKET = "_bucket"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    buckets: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    jobs: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "folders": self.folders, "jobs": self.jobs})

    @staticmethod
    def parse(version: int, text: str) -> Manifest:
        parts = json.loads(text)
        return Manifest(version, parts["buckets"], {int(k): v for k, v in parts["folders"].items()}, parts["jobs"])


def job_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that keeps this checkpoint; a new checkpoint at the same place has another one."""
    return json.loads(_read(spark, f"{checkpoint}/metadata"))["id"]


class KeyedTable:
    """The table at ``path``; ``buckets`` counts when it is made, later the table's own number does."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.new_buckets = spark, path, buckets
        self.files = _files(spark, path)

    def manifest(self) -> Manifest:
        """The newest version; an empty one if there is no table yet."""
        versions = self._versions()
        if not versions:
            return Manifest(buckets=self.new_buckets)
        return Manifest.parse(versions[-1], _read(self.spark, self._manifest(versions[-1])))

    def read(self) -> DataFrame:
        manifest = self.manifest()
        if not manifest.folders:
            raise ValueError(f"no table at {self.path}")
        return self._rows(manifest, sorted(manifest.folders))

    def rows_of(self, manifest: Manifest, buckets: list[int]) -> DataFrame | None:
        """The version's rows in these buckets, none if it has none there."""
        held = [b for b in buckets if b in manifest.folders]
        return self._rows(manifest, held) if held else None

    def bucketed(self, rows: DataFrame, keys: list[str], manifest: Manifest) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(manifest.buckets)).cast("int"))

    def merge(
        self, rows: DataFrame, keys: list[str], combined: Callable[[DataFrame], DataFrame], job: str | None = None, batch: int = 0
    ) -> bool:
        """Put rows in; ``combined`` makes one row per key of old and new ones.  False if the job's batch is in already.

        Without a job nothing is remembered, so putting the same rows in twice must do no harm.
        """
        base = self.manifest()
        fresh = self.bucketed(rows, keys, base).persist()
        try:
            # At most one row for each bucket.
            open_ = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
            written: dict[int, str] = {}
            while job is None or base.jobs.get(job, -1) < batch:
                if open_:
                    folder = uuid.uuid4().hex
                    new = fresh.where(F.col(BUCKET).isin(open_))
                    old = self.rows_of(base, open_)
                    both = new if old is None else new.unionByName(self.bucketed(old, keys, base))
                    merged = combined(both.drop(BUCKET)).transform(self.bucketed, keys, base)
                    few_files(merged, [BUCKET], keys).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
                    written |= {b: folder for b in open_}
                after = Manifest(base.version + 1, base.buckets, base.folders | written, base.jobs if job is None else base.jobs | {job: batch})
                if self._create_once(self._manifest(after.version), after.text()):
                    self._forget_old()
                    return True
                # Another writer was first: what it changed under our hands is merged anew.
                now = self.manifest()
                open_ = [b for b in written if now.folders.get(b) != base.folders.get(b)]
                base = now
            return False
        finally:
            fresh.unpersist()

    def _rows(self, manifest: Manifest, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{manifest.folders[b]}/{BUCKET}={b}" for b in buckets])

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _create_once(self, name: str, text: str) -> bool:
        """Make a file that nobody has made before; it appears whole or not at all."""
        jvm = self.spark._jvm
        side, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{self.path}/manifests/_{uuid.uuid4().hex}", name))
        out = self.files.create(side, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.files.getUri().getScheme() == "file":  # a local rename would replace what is there
                os.link(side.toUri().getPath(), target.toUri().getPath())
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(side, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            if self.files.exists(side):
                self.files.delete(side, False)

    def _forget_old(self) -> None:
        """Take out versions that are no longer kept, and folders that only they name."""
        versions = self._versions()
        old, kept = versions[:-KEPT_VERSIONS], versions[-KEPT_VERSIONS:]
        if not old:
            return
        named = lambda v: set(Manifest.parse(v, _read(self.spark, self._manifest(v))).folders.values())
        try:
            needed, gone = set().union(*map(named, kept)), set().union(*map(named, old))
        except Py4JJavaError:  # another writer takes them out just now
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for v in old:
            self.files.delete(path(self._manifest(v)), False)
        for folder in gone - needed:
            self.files.delete(path(f"{self.path}/data/{folder}"), True)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, name: str) -> str:
    stream = _files(spark, name).open(spark._jvm.org.apache.hadoop.fs.Path(name))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
