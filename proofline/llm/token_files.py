"""Token ids in binary files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id, level k the k-th chunk of the ids that have one; a bitmap
beside each level says which ids go on, and a directory of ranks (ones before
each block of 512 bits) finds an id's place in the next level. So any id is read
with a few look-ups, without decoding what stands before it.

A file: magic, counts, the documents' ids and offsets, then each level's chunks,
bitmap and rank directory. All numbers are little-endian.

Defined results: a null text counts as empty and has the end id alone; a null
doc_id comes before all others; rows that repeat a doc_id follow each other, by
text; an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import cut, small_batches
from proofline.llm.files import output_dir, read_file, write_file
from proofline.llm.tokens import default_path, encoder, slices

MAGIC = b"DACTOK01"
RANK_BITS = 512
IDS_PER_FILE = 1 << 21
END_ID = 2
_HEAD = struct.Struct("<8sQQI")


def _section(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return struct.pack("<Q", len(raw)) + raw


def encode_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents: ``starts`` has one more entry than ``doc_ids``."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        last = not more.any()
        levels.append((rest & 255).astype("u1"))
        if last:
            break
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) * 8 // RANK_BITS) * RANK_BITS // 8, "u1")
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.view("<u8")).reshape(-1, RANK_BITS // 64).sum(1)
        levels += [padded, np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8")]
        rest = rest[more] >> 8
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), (len(levels) + 2) // 3)]
    parts.append(_section(np.array([d if d is not None else 0 for d in doc_ids], "<i8")))
    parts.append(_section(np.array([d is None for d in doc_ids], "u1")))
    parts.append(_section(starts.astype("<u8")))
    return b"".join(parts + [_section(x) for x in levels])


class TokenFile:
    """Random access to the ids of a file's bytes."""

    def __init__(self, raw: bytes):
        magic, n_docs, self.n_ids, self.n_levels = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, found = _HEAD.size, []
        for _ in range(3 + 3 * self.n_levels - 2):
            (size,) = struct.unpack_from("<Q", raw, at)
            found.append(memoryview(raw)[at + 8 : at + 8 + size])
            at += 8 + size
        ids, null, starts, *levels = found
        nulls = np.frombuffer(null, "u1")
        self.doc_ids = [None if n else d for d, n in zip(np.frombuffer(ids, "<i8").tolist(), nulls.tolist(), strict=True)]
        self.starts = np.frombuffer(starts, "<u8").astype(np.int64)
        self._chunks = [np.frombuffer(x, "u1") for x in levels[0::3]]
        self._bits = [np.frombuffer(x, "<u8") for x in levels[1::3]]
        self._ranks = [np.frombuffer(x, "<u8") for x in levels[2::3]]
        if len(self.doc_ids) != n_docs:
            raise ValueError("a token file's directory is damaged")

    def _rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before bit ``i``: the directory, then whole words, then the rest of a word."""
        bits, block = self._bits[level], i // RANK_BITS
        rank = self._ranks[level][block].astype(np.int64)
        word = i // 64
        for k in range(RANK_BITS // 64 - 1):
            w = block * (RANK_BITS // 64) + k
            rank += np.where(w < word, np.bitwise_count(bits[np.minimum(w, len(bits) - 1)]), 0)
        below = (np.uint64(1) << (i % 64).astype(np.uint64)) - np.uint64(1)
        return rank + np.bitwise_count(bits[word] & below)

    def take(self, i: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order."""
        i = np.asarray(i, np.int64)
        out = self._chunks[0][i].astype("<u4")
        at, left = i, np.arange(len(i))
        for level, bits in enumerate(self._bits):
            goes_on = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            left, at = left[goes_on], self._rank(level, at[goes_on])
            out[left] |= self._chunks[level + 1][at].astype("<u4") << np.uint32(8 * (level + 1))
        return out

    def scan(self) -> np.ndarray:
        """All ids in order. Those that go on from a level stand in order in the next, so
        no rank is looked up; instead every rank directory is held against its bitmap."""
        out, at = self._chunks[0].astype("<u4"), np.arange(self.n_ids)
        for level, bits in enumerate(self._bits):
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))[:-1]
            if not np.array_equal(before[:: RANK_BITS // 64], self._ranks[level]):
                raise ValueError("a rank directory is damaged")
            at = at[np.unpackbits(bits.view("u1"), count=len(at), bitorder="little").view(bool)]
            out[at] |= self._chunks[level + 1].astype("<u4") << np.uint32(8 * (level + 1))
        return out

    def document(self, k: int) -> np.ndarray:
        return self.take(np.arange(self.starts[k], self.starts[k + 1]))


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), 0
        names, ids, held, before = [], [], 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            nonlocal names, ids, held, before, files
            starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
            uri = write_file(folder, f"part-{part:06d}-{files:06d}", encode_file(names, starts, np.frombuffer(b"".join(ids), "<u4")))
            row = {"part": [part], "path": [uri], "before": [before], "n_ids": [held], "n_docs": [len(names)]}
            files, before, names, ids, held = files + 1, before + held, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_MANIFEST)

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                for key, raw in zip(keys[a:b], encoder(path).encode(texts[a:b]), strict=True):
                    names.append(key)
                    ids.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= IDS_PER_FILE:
                        yield flush()
        if names:
            yield flush()

    return run


_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: path, start, n_ids, n_docs.

    Documents are dealt into ranges of doc_id; ``start`` counts the ids of all
    documents before a file. One row a file, of about two million ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or output_dir(spark, "tokens")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = cut(ordered.mapInArrow(_write(folder, path or default_path(), end_id), "part int, path string, before long, n_ids long, n_docs long"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return files.join(bases.select("part", "_base"), "part").select("path", (F.col("_base") + F.col("before")).alias("start"), "n_ids", "n_docs")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                held = TokenFile(read_file(uri))
                sizes = np.diff(held.starts)
                ids = [held.document(k) for k in range(len(sizes))] if with_ids else None
                every = held.scan() if ids is None else np.concatenate(ids)
                sums = [zlib.crc32(every[a:b].tobytes()) for a, b in zip(held.starts[:-1].tolist(), held.starts[1:].tolist(), strict=True)]
                columns = [pa.array(held.doc_ids, pa.int64()), pa.array(held.starts[:-1] + start), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] if with_ids else []), schema=schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(run, ddl)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs))
