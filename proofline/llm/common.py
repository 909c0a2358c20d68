"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A maximal run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, as in tests, a folder of our own is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        context.setCheckpointDir(found)
    return found


def cut_sized(df: DataFrame, rows_per_part: int) -> tuple[DataFrame, int]:
    """``cut(df)`` in as few partitions as its rows ask, and their number.

    Small results of wide shuffles otherwise stay in as many partitions, each a
    task of every step that follows.
    """
    held = cut(df)
    rows = held.count()
    return held.coalesce(max(1, -(-rows // rows_per_part))), rows


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that are gone.

    Spark does so when its driver collects garbage, by default every 30 minutes;
    jobs with many small steps would fill disks before. Checkpoints go where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true.
    """
    gc.collect()
    spark._jvm.System.gc()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later uses read those files.

    The files survive lost executors. They go some time after the frame, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true (see
    ``release``); otherwise the folder's owner deletes them. A checkpoint also hands on what the optimizer has inferred so far, which in
    iterations grows without bound; the frame returned starts afresh.
    """
    session = df.sparkSession
    shared_dir(session)
    held = df.checkpoint()._jdf
    fresh = session._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False)
    return DataFrame(fresh, session)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of a batch sent to Python, unless the session
    sets its own bounds: documents can be very long."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "16777216"),
    ):
        if spark.conf.get(key, None) in (None, "10000", "67108864", "-1"):
            spark.conf.set(key, value)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, but for those that hold maps, which have no hash."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as empty."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
