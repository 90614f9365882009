"""Tables kept in versions: rows in hashed buckets, small additions beside them, and a manifest per version.

A manifest names the folder of every bucket and the additions since these were written. It is
written aside and renamed, so a version is there as a whole or not at all, and the highest
number is the current one. There is one writer at a time; readers keep the version they began with,
as long as it is not expired.

A change writes new folders for the buckets its keys fall into and leaves all others alone. An addition
writes a folder of its own; after ``compact_every`` of them they are folded into the buckets they
touch. So a reader sees a bounded number of folders however many batches there were. Buckets hold
one row per key and are even; ``create`` takes their number from the rows expected.

The driver holds one manifest: a path per bucket and addition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

Fold = Callable[[DataFrame, DataFrame], DataFrame]

BUCKET = "_bucket"


@dataclass(frozen=True)
class Manifest:
    """One version: the last batch in it, the folder of each bucket, and the additions since."""

    version: int
    batch: int
    count: int
    buckets: dict[int, str] = field(default_factory=dict)
    additions: list[str] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def of(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(**{**found, "buckets": {int(k): v for k, v in found["buckets"].items()}})


class _Files:
    """The few file operations a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        at = self.jvm.Path(folder)
        return [one.getPath().getName() for one in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.jvm.Path(path))
        try:
            size = self.fs.getFileStatus(self.jvm.Path(path)).getLen()
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    def publish(self, text: str, path: str) -> None:
        """Write aside, then rename: the file is complete when it can be seen."""
        aside, final = self.jvm.Path(f"{path}.{uuid.uuid4().hex}.tmp"), self.jvm.Path(path)
        if self.fs.exists(final):
            raise FileExistsError(f"{path} was written by another writer")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(aside, final):
            raise FileExistsError(f"{path} was written by another writer")

    def remove(self, path: str) -> None:
        self.fs.delete(self.jvm.Path(path), True)


class VersionedTable:
    """A table of unique keys kept in versions below ``path``.

    ``fold`` gives the rows after additions: (rows, additions) to rows of ``schema``. Additions
    have the columns of ``added`` and, for ``fold``, ``batch``.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: list[str],
        fold: Fold | None = None,
        added: T.StructType | None = None,
        compact_every: int = 8,
        keep: int = 3,
    ) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        # A batch may be two versions, its addition and a compaction; the one before it is needed to repeat it.
        self.fold, self.compact_every, self.keep = fold, compact_every, max(3, keep)
        self.added = added and T.StructType([*added.fields, T.StructField("batch", T.LongType())])
        self.files = _Files(spark, self.path)

    # Versions ---------------------------------------------------------------

    def versions(self) -> list[int]:
        names = self.files.names(f"{self.path}/manifests")
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def manifest(self, before_batch: int | None = None) -> Manifest | None:
        """The current version, or the newest one without batch ``before_batch`` and later ones."""
        for version in reversed(self.versions()):
            found = Manifest.of(self.files.read(f"{self.path}/manifests/{version:010d}.json"))
            if before_batch is None or found.batch < before_batch:
                return found
        return None

    def _publish(self, manifest: Manifest) -> Manifest:
        self.files.publish(manifest.text(), f"{self.path}/manifests/{manifest.version:010d}.json")
        self._expire()
        return manifest

    def _expire(self) -> None:
        """Remove all but the newest ``keep`` versions, and the folders that none of those names."""
        versions = self.versions()
        kept = [Manifest.of(self.files.read(f"{self.path}/manifests/{v:010d}.json")) for v in versions[-self.keep :]]
        for version in versions[: -self.keep]:
            self.files.remove(f"{self.path}/manifests/{version:010d}.json")
        used = {folder for one in kept for folder in [*one.buckets.values(), *one.additions]}
        whole = {folder.split("/")[0] for folder in used}
        for name in self.files.names(f"{self.path}/data"):
            if name not in whole:
                self.files.remove(f"{self.path}/data/{name}")
            elif name not in used:
                parts = [f"{name}/{part}" for part in self.files.names(f"{self.path}/data/{name}") if "=" in part]
                for part in set(parts) - used:
                    self.files.remove(f"{self.path}/data/{part}")

    # Rows ---------------------------------------------------------------------

    def _numbered(self, df: DataFrame, count: int) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(count)).cast("int"))

    def _written(self, rows: DataFrame, count: int, touched: list[int]) -> dict[int, str]:
        """Write rows of the touched buckets; the folders of those that have rows.

        Buckets are brought together as far as a task's advised size goes: small ones share a task and large
        ones are split over several, so that a table's size does not show in its tasks.
        """
        name = uuid.uuid4().hex
        numbered = self._numbered(rows.select(*self.schema.names), count)
        numbered.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        there = self.files.names(f"{self.path}/data/{name}")
        found = {int(one.removeprefix(f"{BUCKET}=")) for one in there if one.startswith(f"{BUCKET}=")}
        return {bucket: f"{name}/{BUCKET}={bucket}" for bucket in sorted(found)}

    def _stored(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        chosen = manifest.buckets if buckets is None else {b: manifest.buckets[b] for b in buckets if b in manifest.buckets}
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}" for folder in chosen.values()])

    def _additions(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.schema(self.added).parquet(*[f"{self.path}/data/{folder}" for folder in manifest.additions])

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        rows = self._stored(manifest, buckets)
        if not manifest.additions:
            return rows
        additions = self._additions(manifest)
        if buckets is not None:
            additions = self._numbered(additions, manifest.count).filter(F.col(BUCKET).isin(buckets)).drop(BUCKET)
        return self.fold(rows, additions).select(*self.schema.names)

    def _touched(self, keys: DataFrame, count: int) -> list[int]:
        """Buckets that keys fall into: at most one number per bucket reaches the driver."""
        return sorted(row[0] for row in self._numbered(keys, count).select(BUCKET).distinct().collect())

    # Use ----------------------------------------------------------------------

    def create(self, rows: DataFrame, buckets: int = 64) -> Manifest:
        """First version, unless there is one already."""
        present = self.manifest()
        if present:
            return present
        return self._publish(Manifest(0, -1, buckets, self._written(rows, buckets, list(range(buckets)))))

    def read(self, before_batch: int | None = None) -> DataFrame:
        return self._rows(self.manifest(before_batch))

    def lookup(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame:
        """Rows of the given keys; only their buckets are read."""
        manifest = self.manifest(before_batch)
        wanted = keys.select(*self.key).distinct()
        return self._rows(manifest, self._touched(wanted, manifest.count)).join(wanted, self.key, "left_semi")

    def unfolded(self, keys: DataFrame, before_batch: int | None = None) -> DataFrame:
        """Stored rows and additions of the buckets of the given keys, side by side: for folds that only add up."""
        manifest = self.manifest(before_batch)
        buckets = self._touched(keys, manifest.count)
        rows = self._stored(manifest, buckets)
        if not manifest.additions:
            return rows
        numbered = self._numbered(self._additions(manifest), manifest.count).filter(F.col(BUCKET).isin(buckets))
        return rows.unionByName(numbered.select(*self.schema.names))

    def change(self, changes: DataFrame, apply: Fold, batch: int | None = None) -> Manifest:
        """New version after ``apply`` (rows, changes) to rows, which may only touch the changes' keys.

        Buckets without a changed key keep their folders. A batch that is in the current
        version already changes nothing.
        """
        current = self.manifest()
        if batch is not None and batch <= current.batch:
            return current
        touched = self._touched(changes.select(*self.key), current.count)
        if current.additions:
            touched = sorted({*touched, *self._touched(self._additions(current).select(*self.key), current.count)})
        number = current.batch if batch is None else batch
        return self._rewritten(current, apply(self._rows(current, touched), changes), touched, number)

    def _rewritten(self, current: Manifest, rows: DataFrame, touched: list[int], batch: int) -> Manifest:
        """New version in which the touched buckets have these rows, and no additions."""
        written = self._written(rows, current.count, touched) if touched else {}
        kept = {bucket: folder for bucket, folder in current.buckets.items() if bucket not in touched}
        return self._publish(Manifest(current.version + 1, batch, current.count, {**kept, **written}))

    def add(self, additions: DataFrame, batch: int) -> Manifest:
        """New version with the additions of a batch; a batch that is in already adds nothing."""
        current = self.manifest()
        if batch <= current.batch:
            return current
        name = uuid.uuid4().hex
        numbered = additions.withColumn("batch", F.lit(batch).cast("bigint")).select(*self.added.names)
        numbered.write.parquet(f"{self.path}/data/{name}")
        after = replace(current, version=current.version + 1, batch=batch, additions=[*current.additions, name])
        after = self._publish(after)
        return self.compact() if len(after.additions) >= self.compact_every else after

    def compact(self) -> Manifest:
        """New version with all additions folded into the buckets they touch."""
        current = self.manifest()
        if not current.additions:
            return current
        touched = self._touched(self._additions(current).select(*self.key), current.count)
        return self._rewritten(current, self._rows(current, touched), touched, current.batch)
