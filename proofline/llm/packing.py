"""Best-fit packing of documents into sequences.

Length-histogram planning: best fit, longest first, runs over the counts of
pieces of each length, at most ``room`` of them, never over documents. The plan
is a list of runs (so many pieces of a length, from a rank on, go into so many
sequences in a row); its size depends on ``room`` alone. Then each piece takes
its slot by its rank within its length.

Ranks are found in two steps, as one length may hold a third of all pieces:
the pieces of a length are dealt into as many buckets as their count asks, the
buckets' sizes are summed, and each piece is numbered within its bucket.

Defined results: a null text counts as empty and has the end id alone; rows
that repeat a doc_id are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import cut, small_batches
from proofline.llm.tokens import default_path, encoder, slices

ROOM = 2048
END_ID = 0
PIECES_PER_BUCKET = 4096
_RANK_BITS = 44


def plan_best_fit(counts: dict[int, int], room: int = ROOM) -> np.ndarray:
    """Runs of slots: columns length, first rank, first sequence, pieces a sequence, first offset.

    The best place for a piece is the open sequence with the least room that
    holds it; once a sequence has taken it, the same sequence is the best place
    for the next of that length, so a sequence takes as many as fit at once.
    """
    spare: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
    runs, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, many: int, room_left: int, length=length) -> None:
            """Fills sequences first .. first + many with as many pieces as are left."""
            nonlocal left, rank
            each = room_left // length
            full = min(many, left // each)
            part = left - full * each if full < many else 0
            for start, n, per in ((first, full, each), (first + full, int(part > 0), part)):
                if n:
                    runs.append((length, rank, start, per, room - room_left))
                    rank += n * per
                    if room_left > per * length:
                        spare[room_left - per * length].append((start, n))
            left -= full * each + part
            taken = full + int(part > 0)
            if taken < many:
                spare[room_left].append((first + taken, many - taken))

        for room_left in sorted(k for k in spare if k >= length):
            groups = spare.pop(room_left)
            while groups and left:
                place(*groups.pop(), room_left)
            if groups:
                spare[room_left].extend(groups)
            if not left:
                break
        if left:
            many = -(-left // (room // length))
            used += many
            place(used - many, many, room)
    return np.array(runs, np.int64).reshape(-1, 5)


def cut_pieces(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % room or room
    return [(0, min(first, n))] + [(a, room) for a in range(first, n, room)]


def token_pieces(docs: DataFrame, path: str | None = None, room: int = ROOM, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                rows = []
                for key, raw in zip(keys[a:b], encoder(path).encode(texts[a:b]), strict=True):
                    raw += end
                    for k, (start, length) in enumerate(cut_pieces(len(raw) // 4, room)):
                        part = raw[4 * start : 4 * (start + length)]
                        rows.append((key, k, start, length, zlib.crc32(part)) + (((np.frombuffer(part, "<u4").tolist()),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def pack(pieces: DataFrame, room: int = ROOM, pieces_per_bucket: int = PIECES_PER_BUCKET) -> DataFrame:
    """``pieces`` (doc_id, piece, length, any more) with sequence_id and offset."""
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``room`` rows
    many = np.zeros(room + 1, np.int64)
    many[list(counts)] = [-(-n // pieces_per_bucket) for n in counts.values()]
    buckets = F.element_at(F.lit(many.tolist()), F.col("length").cast("int") + 1)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    sizes = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = pieces.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1).drop("_bucket", "_start")
    runs = plan_best_fit(counts, room)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))] if len(runs) else runs
    firsts = (runs[:, 0] << _RANK_BITS) + runs[:, 1]
    kept = [c for c in ranked.columns if c != "_rank"]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, (length << _RANK_BITS) + rank, side="right") - 1
            _, first, sequence, each, offset = runs[at].T
            k = rank - first
            columns = [batch.column(c) for c in kept] + [pa.array(sequence + k // each), pa.array(offset + k % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(kept).schema.fields)
    return ranked.select(*kept, "_rank").mapInArrow(slots, f"{schema}, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
