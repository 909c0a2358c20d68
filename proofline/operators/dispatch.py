"""The next entry of each queue to dispatch, as a table function over an outbox.

``dispatch_next(TABLE(outbox))`` deals entries by queue, sorts them by age, and gives the first that is due; the
rest of a queue is skipped without being read into memory, so a queue with a third of all entries is one that streams by.
Columns: queue, id, state, attempts, available_at, now. Gives queue, id, attempts (counted
up), outcome. Entries that aren't pending or whose time hasn't come are passed; a queue without a due
entry gives no row; a null time is due at once; null queues are one queue.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

NEEDED = ("queue", "id", "state", "attempts", "available_at", "now")


class DispatchNext:
    @staticmethod
    def analyze(outbox: AnalyzeArgument) -> AnalyzeResult:
        if not outbox.isTable:
            raise ValueError("dispatch_next takes a table")
        missing = [n for n in NEEDED if n not in outbox.dataType.fieldNames()]
        if missing:
            raise ValueError(f"dispatch_next lacks columns {missing}")
        kind = {f.name: f.dataType for f in outbox.dataType.fields}
        schema = StructType().add("queue", kind["queue"]).add("id", kind["id"]).add("attempts", LongType()).add("outcome", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("queue")], orderBy=[OrderingColumn("id")])

    def __init__(self):
        self.found = False

    def eval(self, row) -> Iterator[tuple]:
        if self.found:
            raise SkipRestOfInputTableException("a queue dispatches one entry")
        if row["state"] == "pending" and (row["available_at"] is None or row["available_at"] <= row["now"]):
            self.found = True
            attempts = (row["attempts"] or 0) + 1
            yield row["queue"], row["id"], attempts, "dispatched" if attempts <= 5 else "exhausted"


def register(spark: SparkSession) -> None:
    spark.udtf.register("dispatch_next", udtf(DispatchNext))
