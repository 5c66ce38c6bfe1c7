"""A keyed store of Parquet files whose cost follows the batch: a batch reads and replaces only the buckets it touches.

Rows are dealt by a hash of their key into buckets. A version writes the buckets it touches, then a manifest with one
row per bucket: which version's files hold it, how many rows these are, and a digest of their keys and hashes that does
not depend on order. The manifest is written last and all at once, so a version is there in whole or not at all; a
version that is applied again starts from the one before it and replaces its own files only.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "bucket int, version long, n long, digest long"


class KeyedStore:
    """Rows by key under root. buckets is fixed for the life of a store: choose it so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    # --- files

    def _children(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        """Versions whose manifest is complete, rising."""
        return sorted(int(x.split("=")[1]) for x in self._children(f"{self.root}/manifest") if x.startswith("version=") and "_SUCCESS" in self._children(f"{self.root}/manifest/{x}"))

    def manifest(self, version: int | None = None) -> list:
        """Rows (bucket, version, n, digest) of a version, or of the last; none if there is no version."""
        known = self.versions()
        if not known:
            return []
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.root}/manifest/version={known[-1] if version is None else version}").collect()

    # --- rows

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The rows of a version (the last one by default), or of some of its buckets; None if no bucket has any."""
        paths = [f"{self.root}/data/version={r['version']}/bucket={r['bucket']}" for r in self.manifest(version) if only is None or r["bucket"] in only]
        return self.spark.read.parquet(*paths).drop("merge_action") if paths else None

    def digests(self, rows: DataFrame, hash_column: str | None = None) -> DataFrame:
        """bucket, n and digest of rows with unique keys."""
        what = [self.key] + ([hash_column] if hash_column else [c for c in rows.columns if c not in (self.key, "merge_action")])
        return rows.groupBy(self.bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*what)).alias("digest"))

    def apply(self, batch: DataFrame, version: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame], hash_column: str | None = None) -> dict[str, int]:
        """Writes version: merge(rows of the touched buckets so far, or None; batch) in place of these buckets.

        Returns the rows of the version by merge_action, where merge gives one; rows of buckets that are not touched are
        "kept". The same version applied twice changes nothing.
        """
        earlier = [v for v in self.versions() if v < version]
        old = {r["bucket"]: r for r in (self.manifest(earlier[-1]) if earlier else [])}
        batch = batch.persist()
        try:
            touched = {r["bucket"] for r in batch.select(self.bucket().alias("bucket")).distinct().collect()}  # at most self.buckets
            before = self.read(earlier[-1], touched) if earlier else None
            merged = merge(before, batch).withColumn("bucket", self.bucket())
            data = f"{self.root}/data/version={version}"
            merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        finally:
            batch.unpersist()
        now, actions = {}, {}
        if touched:
            written = self.spark.read.parquet(*(f"{data}/{x}" for x in self._children(data) if x.startswith("bucket=")))
            now = {r["bucket"]: (r["bucket"], version, r["n"], r["digest"]) for r in self.digests(written, hash_column).collect()}
            if "merge_action" in written.columns:
                actions = {r["merge_action"]: r["n"] for r in written.groupBy("merge_action").agg(F.count(F.lit(1)).alias("n")).collect()}
        rest = [tuple(r) for b, r in old.items() if b not in touched]
        if actions:
            actions["kept"] = actions.get("kept", 0) + sum(r[2] for r in rest)
        self.spark.createDataFrame([*now.values(), *rest], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return actions

    def clean(self, keep: int = 2) -> int:
        """Deletes the files that the last keep manifests don't name, and older manifests; how many folders went."""
        known = self.versions()
        used = {(r["version"], r["bucket"]) for v in known[-keep:] for r in self.manifest(v)}
        gone = [f"manifest/version={v}" for v in known[:-keep]]
        for name in self._children(f"{self.root}/data"):
            v = int(name.split("=")[1])
            if not known or v > known[-1]:
                continue  # being written
            own = [x for x in self._children(f"{self.root}/data/{name}") if x.startswith("bucket=")]
            gone += [f"data/{name}/{x}" for x in own if (v, int(x.split("=")[1])) not in used]
        for name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)

    # --- differences

    def differing(self, current: DataFrame, hash_column: str) -> tuple[set[int], int]:
        """(buckets in which current, with unique keys, differs from the store; rows of the buckets that are equal). Reads
        the keys and hashes of current and the manifest, none of the store's rows."""
        old = {r["bucket"]: (r["n"], r["digest"]) for r in self.manifest()}
        new = {r["bucket"]: (r["n"], r["digest"]) for r in self.digests(current.select(self.key, hash_column), hash_column).collect()}
        equal = {b for b in new if new[b] == old.get(b)}
        return (set(old) | set(new)) - equal, sum(new[b][0] for b in equal)

    def diff(self, current: DataFrame, hash_column: str, fields: list[str], observed_at: datetime | str, report_not_observed: bool = True) -> tuple[DataFrame, int]:
        """(snapshot_diff of the store and current, with unique keys; rows in buckets without a difference). Only buckets
        whose digests differ are read and joined. The store must have been written with this hash_column."""
        from ..operators.changes import snapshot_diff

        buckets, same = self.differing(current, hash_column)
        rows = current.where(self.bucket().isin(*buckets)) if buckets else current.limit(0)
        before = self.read(only=buckets)
        before = rows.limit(0) if before is None else before
        arrival = lambda df: df.withColumn("_arrival", F.lit(0))
        return snapshot_diff(arrival(before), arrival(rows), self.key, hash_column, fields, "_arrival", observed_at, report_not_observed), same
