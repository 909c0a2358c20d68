"""Tables that streams write: each batch once, rows of a key once, whatever is replayed.

A table is a folder of hash buckets of its key, so the number of folders doesn't grow with the
keys. A batch writes the buckets that it touches anew under its own number, and is committed by its manifest, a file that
names the current folder of each bucket; readers follow the last manifest. A batch that was
cut off before its manifest leaves files that nothing names, and its replay overwrites them; a batch
with a manifest is skipped. One stream writes a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.records import STAGES


class BucketedTable:
    """Rows by key in ``folder``. ``digest``: a column that tells whether two rows of a key say the same."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], order: str, digest: str | None = None, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.order, self.digest, self.buckets = spark, folder.rstrip("/"), schema, key, order, digest, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._path("manifests")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self) -> dict:
        """{"buckets": {bucket: folder}, "errors": [folder]} of the last committed batch."""
        done = self._manifests()
        if not done:
            return {"buckets": {}, "errors": []}
        path, _ = self._path(f"manifests/{done[-1]}.json")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def _publish(self, batch: int, manifest: dict) -> None:
        path, fs = self._path(f"manifests/{batch}.json")
        temporary, _ = self._path(f"manifests/{batch}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(temporary, path):
            raise RuntimeError(f"batch {batch} is committed already")

    def _read(self, folders: list[str], schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema or self.schema)
        return reader.parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema or self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.manifest()["buckets"].values()))

    def errors(self) -> DataFrame:
        """Rows that were refused: their key was stored with another digest."""
        return self._read(self.manifest()["errors"])

    def commit(self, rows: DataFrame, batch: int, replace: bool) -> bool:
        """Stores a batch; false if it was committed before.

        ``replace``: of each key the last row by ``order`` counts, over what is stored. Otherwise the
        first one ever stays; another of the same digest changes nothing, and one of another digest is an error row.
        """
        done = self._manifests()
        if done and batch <= done[-1]:
            return False
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = rows.select(*names).withColumn("_bucket", bucket)
        rows = rows.persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most the number of buckets
            last = self.manifest()
            held = self._read([last["buckets"][str(b)] for b in touched if str(b) in last["buckets"]])
            pick = F.max_by if replace else F.min_by
            one = rows.groupBy("_bucket", *self.key).agg(pick(F.struct(*names), self.order).alias("_new"))
            old = held.select(*[F.col(k).alias(f"_old_{k}") for k in self.key], F.struct(*names).alias("_old"))
            same = [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in self.key]
            both = one.join(old, same, "full_outer")
            kept = F.coalesce("_new", "_old") if replace else F.coalesce("_old", "_new")
            stored = both.select(kept.alias("_row")).select("_row.*").withColumn("_bucket", bucket)
            stored.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/{batch}")
            manifest = {"buckets": last["buckets"] | {str(b): f"data/{batch}/_bucket={b}" for b in touched}, "errors": last["errors"]}
            if self.digest and not replace:
                kept = self._read([manifest["buckets"][str(b)] for b in touched])
                kept = kept.select(*[F.col(k).alias(f"_old_{k}") for k in self.key], F.col(self.digest).alias("_held"))
                wrong = rows.join(kept, same).filter(~F.col(self.digest).eqNullSafe(F.col("_held"))).select(*names)
                wrong.write.mode("overwrite").parquet(f"{self.folder}/errors/{batch}")
                manifest["errors"] = [*last["errors"], f"errors/{batch}"]
            self._publish(batch, manifest)
        finally:
            rows.unpersist()
        return True


def stage_sink(table: BucketedTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: stage results (job_id, attempt, stage, payload_hash, ...), each once; another hash is an error row."""
    return lambda rows, batch: table.commit(rows, batch, replace=False)


def completion_sink(table: BucketedTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: completions of requests, the latest in place of earlier ones."""
    return lambda rows, batch: table.commit(rows, batch, replace=True)


def pending_stages(jobs: DataFrame, done: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(job_id, attempt, place, stage): what a resumed job has still to do, from ``jobs`` (job_id, attempt) and stored stages."""
    plan = jobs.select("job_id", "attempt", F.posexplode(F.array(*map(F.lit, stages))).alias("place", "stage"))
    return plan.join(done.select("job_id", "attempt", "stage").distinct(), ["job_id", "attempt", "stage"], "left_anti").select("job_id", "attempt", "place", "stage")
