"""A stored table of briefs, one for each key, of which an upsert rewrites only what it must.

Keys are dealt to a fixed number of buckets by hash.  The store is a folder of generations, each of
which holds some buckets as Parquet, and of manifests, which say for every bucket in which generation it is.
An upsert reads the buckets that its keys fall into, and no others, and writes them as a new
generation; then a new manifest takes its place in one move.  So a reader sees all of an upsert or
nothing of it, a failed one leaves the store as it was, and buckets that no new key falls into
are neither read nor written.

The driver holds the manifest: a line for each bucket.  ``buckets`` is chosen when a store is created; take
about one for each 128 MB that the store shall hold.

Defined cases: the latest ``saved_at`` of a key wins, the new row on a tie, a null ``saved_at`` never
over another; a null key is one key; an upsert without rows changes nothing; a store without rows
reads as an empty table, one that was never written as an error.  Two upserts at the same time: the one that
ends second fails.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.sources.store import upsert_briefs

BUCKET = "__bucket"


class BriefTable:
    """The store at ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, key: str = "store_key", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.system, self.inner = fs.FileSystem.from_uri(self.path)

    def _manifests(self) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.inner, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))

    def _manifest(self) -> dict | None:
        names = self._manifests()
        if not names:
            return None
        with self.system.open_input_stream(names[-1]) as file:
            return json.loads(file.read())

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        """The buckets that the keys of ``rows`` fall into: no more numbers than there are buckets."""
        return {r[0] for r in rows.select(self._bucket(buckets)).distinct().collect()}

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*paths)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All briefs, or those of ``keys`` (a table with the key column), for which their buckets are read."""
        manifest = self._manifest()
        if manifest is None:
            raise ValueError(f"no store at {self.path}")
        if keys is None:
            return self._read(manifest)
        wanted = keys.select(F.col(self.key).alias("__wanted")).distinct()
        found = self._read(manifest, self._touched(keys, manifest["buckets"]))
        return found.join(wanted, F.col(self.key).eqNullSafe(F.col("__wanted")), "left_semi")

    def upsert(self, new: DataFrame) -> int:
        """Briefs(key, saved_at, ..) into the store -> how many buckets were rewritten."""
        manifest = self._manifest()
        version = len(self._manifests())
        if manifest is None:
            # columns may be null whatever the first rows say
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
            manifest = {"buckets": self.buckets, "schema": schema, "folders": {}}
        empty = self.spark.createDataFrame([], manifest["schema"])
        new = new.select(*empty.columns)
        touched = self._touched(new, manifest["buckets"])
        generation = f"generation-{uuid.uuid4().hex}"
        if touched:
            old = self._read(manifest, touched)
            merged = upsert_briefs(old, new, self.key).withColumn(BUCKET, self._bucket(manifest["buckets"]))
            merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{generation}")
        elif version:
            return 0
        folders = {**manifest["folders"], **{str(b): generation for b in touched}}
        self._swap({**manifest, "folders": folders}, version)
        return len(touched)

    def _swap(self, manifest: dict, version: int) -> None:
        self.system.create_dir(self.inner)
        made, place = f"{self.inner}/new-{uuid.uuid4().hex}", f"{self.inner}/manifest-{version:010d}.json"
        with self.system.open_output_stream(made) as file:
            file.write(json.dumps(manifest).encode())
        if len(self._manifests()) != version:
            self.system.delete_file(made)
            raise RuntimeError(f"{self.path} has changed during the upsert")
        self.system.move(made, place)

    def forget(self) -> int:
        """Delete the generations that the manifest no longer names -> how many; for when no reader
        and no writer works with an older one."""
        manifest = self._manifest()
        used = set(manifest["folders"].values()) if manifest else set()
        found = self.system.get_file_info(fs.FileSelector(self.inner, allow_not_found=True))
        old = [f.path for f in found if f.base_name.startswith("generation-") and f.base_name not in used]
        for path in old:
            self.system.delete_dir(path)
        return len(old)
