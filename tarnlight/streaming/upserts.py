"""A table that streams upsert into: the latest row of each key, by batches that may be replayed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UpsertTable:
    """The latest row of each key in a folder, in buckets by the key's hash, under numbered manifests.

    A manifest names for each bucket the folder that holds it, and for each writer the last batch that is in. A batch rewrites only the
    buckets whose keys it has, into folders of its own, and counts once its manifest is there: readers see all of it or nothing, and
    a batch that comes again, after a failure or a restart, changes nothing. Of two writers that commit one version, the second fails and its batch is tried anew.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], buckets: int = 64):
        """The row with the largest `order` is a key's latest; of rows that are equal in it, the one that came in a later batch, and in one batch any, is. Nulls in it are lowest."""
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), list(keys), list(order), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest; an empty one for a new table."""
        place = self._path(f"{self.folder}/_manifests")
        if not self._files.exists(place):
            return {"version": 0, "batches": {}, "buckets": {}, "schema": None}
        version = max(int(s.getPath().getName().split(".")[0]) for s in self._files.listStatus(place) if s.getPath().getName().endswith(".json"))
        stream = self._files.open(self._path(f"{self.folder}/_manifests/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Write the manifest under its version, which must be new: it is written aside, then renamed."""
        last = self._path(f"{self.folder}/_manifests/{manifest['version']:020d}.json")
        aside = self._path(f"{self.folder}/_manifests/.{uuid.uuid4().hex}")
        self._files.mkdirs(last.getParent())
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(last) or not self._files.rename(aside, last):
            self._files.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} of {self.folder} was committed by another writer")

    def merge(self, batch: DataFrame, batch_id: int, writer: str = "stream") -> bool:
        """Merge a batch; False if the writer's batch of that number, or a later one, is in already. A key with a null in it is a key like any other; a null is equal to itself."""
        now = self.manifest()
        if now["batches"].get(writer, -1) >= batch_id:
            return False
        fields = batch.columns
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # counted by key before anything is moved, so a hot key is one row for each task
        latest = self._latest(batch.withColumn("bucket", bucket).withColumn("age", F.lit(1)), fields)
        scratch = f"{self.folder}/data/{uuid.uuid4().hex}"
        latest.write.parquet(f"{scratch}/new")
        latest = self.spark.read.schema(latest.schema).parquet(f"{scratch}/new")
        touched = [r.bucket for r in latest.select("bucket").distinct().collect()]  # as many as there are buckets at most
        held = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
        if held:
            old = self.spark.read.schema(latest.select(*fields, "bucket").schema).parquet(*held)
            latest = self._latest(latest.select(*fields, "bucket").withColumn("age", F.lit(1)).unionByName(old.withColumn("age", F.lit(0))), fields)
        # each bucket is one folder; its rows are in one task for each bucket, which bounds both files and rows
        latest.repartition("bucket").withColumn("of", F.col("bucket")).write.partitionBy("of").parquet(f"{scratch}/merged")
        places = now["buckets"] | {str(b): f"{scratch}/merged/of={b}" for b in touched}
        self._commit({"version": now["version"] + 1, "batches": now["batches"] | {writer: batch_id}, "buckets": places, "schema": batch.schema.json()})
        return True

    def _latest(self, rows: DataFrame, fields: list[str]) -> DataFrame:
        best = F.max_by(F.struct(*fields), F.struct(*self.order, "age")).alias("row")
        return rows.groupBy("bucket", *[F.col(k).alias(f"key_{i}") for i, k in enumerate(self.keys)]).agg(best).select("row.*", "bucket")

    def read(self) -> DataFrame:
        """The latest row of each key, as of the newest manifest. A table without a batch cannot be read."""
        now = self.manifest()
        if not now["version"]:
            raise ValueError(f"{self.folder} has no batch yet")
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(now["schema"]))
        places = list(now["buckets"].values())
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def follow(self, stream: DataFrame, checkpoint: str, writer: str = "stream") -> None:
        """Merge all that a stream has now, batch by batch, in order."""
        query = stream.writeStream.foreachBatch(lambda batch, batch_id: self.merge(batch, batch_id, writer) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
