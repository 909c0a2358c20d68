"""Compression of vectors to short codes, in integer arithmetic.

Components become integers, a vector is cut into equal parts, and each part is
coded by the nearest entry of its part's codebook. Distances are screened by a
float32 matrix product: the exact value lies within a proven interval around
the computed one. Entries whose interval overlaps the best one's are evaluated
again in int64, and ties go to the lower index. So codes don't hang on the order
of sums, on the machine, or on how rows are dealt out.

Codebooks are learned over all rows: each round adds up the parts of each entry
within a partition, and one row per entry, component and partition is shuffled.
The driver holds the codebooks alone (``ENTRIES`` vectors).

Defined results: rows whose vector is null or holds null or non-finite
components are left out. Vectors of another length than most (of lengths that
``PARTS`` divides; ties: the shorter) keep their row, with a null code and
error. Numbers beyond int64's safe range are computed with Python's integers; an
error beyond a long is null, and so is the sum of a label that holds one. A
null vec_id comes last where codebooks start; rows that repeat a vec_id are
ordered by vector there and coded each. With fewer rows than ``ENTRIES``, codebooks
have as many entries. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import cut, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels with more than this share of all rows, which are at most as many as its inverse, are joined by broadcast.
HEAVY = 1 / 1024
_LIMB = 40
_UNIT = 2.0**-24  # of float32's rounding


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of float32 components as int64, or as Python integers if some are too large for it."""
    x = np.floor(np.asarray(vectors, np.float64) * SCALE)
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2.0**53 else np.array([[int(v) for v in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` (int64) the nearest row of ``book`` (ties: the first), and their squared distance.

    The caller makes sure that a squared distance fits int64.
    """
    width = x.shape[1]
    x64, b64 = x.astype(np.float64), book.astype(np.float64)
    product = (x64.astype(np.float32) @ b64.astype(np.float32).T).astype(np.float64)
    squares = (b64 * b64).sum(1)
    score = squares[None, :] - 2 * product  # squared distance less the row's own square
    # |computed - exact| of a dot product of n float32 terms is at most n u / (1 - n u) times the sum of |x_i||b_i|, in any
    # order of summation and with or without fused steps; rounding the factors to float32 counts as two more terms, and
    # Cauchy's bound stands for the sum. The last terms cover the float64 steps (at most width + 4 roundings each).
    steps = (width + 3) * _UNIT
    lengths = np.sqrt((x64 * x64).sum(1))[:, None] * np.sqrt(squares)[None, :]
    reach = 2 * (steps / (1 - steps)) * lengths + (squares[None, :] + 2 * lengths) * ((width + 8) * 2.0**-52)
    reach *= 1 + 2.0**-30
    open_ = score - reach <= (score + reach).min(1, keepdims=True)
    row, entry = np.nonzero(open_)
    gap = x[row] - book[entry]
    exact = (gap * gap).sum(1)
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(exact, starts) if len(row) else np.zeros(0, np.int64)
    best = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(starts, len(row)))))
    first = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))] if len(best) else best
    return entry[first], least


def nearest_of_any_size(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, with Python's integers."""
    codes, errors = [], []
    entries = [[int(v) for v in e] for e in book.tolist()]
    for row in x.tolist():
        far = [sum((int(a) - b) ** 2 for a, b in zip(row, e, strict=True)) for e in entries]
        errors.append(min(far))
        codes.append(far.index(errors[-1]))
    return np.array(codes, np.int64), np.array(errors, object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each part and squared distances summed over the parts."""
    width, length = books[0].shape[1], x.shape[1]
    # squares of differences, summed over a whole vector, must stay below 2**62
    safe = lambda most: 4 * most**2 * length < 2**62
    bound = max(map(_largest, books))
    small = np.full(len(x), safe(bound))
    if safe(bound) and not safe(_largest(x)):
        small = np.array([safe(_largest(r)) for r in x])
    codes, errors = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64 if small.all() else object)
    for rows, find, kind in ((small, nearest, np.int64), (~small, nearest_of_any_size, object)):
        if rows.any():
            some = x[rows].astype(kind)
            for p, book in enumerate(books):
                codes[rows, p], more = find(some[:, p * width : (p + 1) * width], book.astype(kind))
                errors[rows] += more
    return codes, errors


def _numbers(f: pd.DataFrame) -> np.ndarray:
    return whole_numbers(np.stack(f["vector"].to_numpy()))


def learn(spark: SparkSession, rows: DataFrame, length: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part, from all ``rows`` (vec_id, vector) of one length."""
    width = length // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = whole_numbers(np.array([r["vector"] for r in first], np.float32))
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            books = shared.value
            total, n = np.zeros((parts, len(books[0]), width), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for f in frames:
                if len(f):
                    x = _numbers(f)
                    codes, _ = encode(x, books)
                    if x.dtype == object or np.abs(x).max() >= 2**40:
                        total, x = total.astype(object), x.astype(object)
                    for p in range(parts):
                        np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
                        n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
            part, entry = np.nonzero(n)
            values = total[part, entry].ravel()
            out = {"part": np.repeat(part, width), "entry": np.repeat(entry, width), "place": np.tile(np.arange(width), len(part)), "n": np.repeat(n[part, entry], width)}
            for k in range(4):  # a sum as limbs, the last one signed: sums of any size then add up in longs
                moved = values >> (_LIMB * k if values.dtype == object else min(63, _LIMB * k))
                out[f"limb{k}"] = moved if k == 3 else moved & (2**_LIMB - 1)
            yield pd.DataFrame(out).astype(np.int64)

        kind = "part long, entry long, place long, n long, limb0 long, limb1 long, limb2 long, limb3 long"
        found = rows.select("vector").mapInPandas(sums, kind).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), *[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(4)])
        fresh = [[[int(v) for v in e] for e in b.tolist()] for b in books]
        for r in found.collect():  # entries times the length of a vector
            fresh[r["part"]][r["entry"]][r["place"]] = sum(r[f"limb{k}"] << (_LIMB * k) for k in range(4)) // r["n"]
        wide = any(abs(v) >= 2**53 for b in fresh for e in b for v in e)
        books = [np.array(b, object if wide else np.int64) for b in fresh]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (bytes) and error of each usable row, and the codebooks."""
    spark = vectors.sparkSession
    small_batches(spark)
    vector = F.col("embedding").cast("array<float>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(vector.isNotNull() & finite, F.lit(False))).select("vec_id", "label", vector.alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), "n").head(1)
    length = lengths[0]["n"] if lengths else -1
    books = learn(spark, rows.filter(F.size("vector") == length), length, parts, entries, rounds) if lengths else []
    shared = spark.sparkContext.broadcast(books)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fits = f["vector"].map(len).to_numpy() == length
            codes, errors = [None] * len(f), [None] * len(f)
            if fits.any():
                found, far = encode(_numbers(f[fits]), shared.value)
                for k, c, e in zip(np.flatnonzero(fits), found, far.tolist(), strict=True):
                    codes[k], errors[k] = c.tobytes(), e if e < 2**63 else None
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "code": codes, "error": pd.array(errors, dtype="Int64")})

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInPandas(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"), books


def decompress(code: bytes, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[c] for book, c in zip(books, code, strict=True)]).astype(np.float64) / SCALE


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors of its label added up. Labels with many rows, which are few, don't move those rows."""
    coded = cut(coded)
    fits = F.count("error") == F.count("*")
    totals = coded.groupBy("label").agg(F.count("*").alias("_rows"), F.when(fits, F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")).alias("label_error"))
    heavy = coded.count() * HEAVY
    frequent = F.broadcast(totals.filter(F.col("_rows") > heavy)).withColumnRenamed("label", "_label")
    marked = coded.join(frequent, F.col("label").eqNullSafe(F.col("_label")), "left")
    rest = totals.filter(F.col("_rows") <= heavy).withColumnsRenamed({"label": "_label", "_rows": "_less"}).withColumnRenamed("label_error", "_error")
    few = marked.filter("_rows IS NULL").drop("_label").join(rest, F.col("label").eqNullSafe(F.col("_label"))).withColumn("label_error", F.col("_error"))
    columns = [*coded.columns, "label_error"]
    return marked.filter("_rows IS NOT NULL").select(*columns).unionByName(few.select(*columns))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


_ROUND = """
code{k} AS (SELECT a.vec_id, a.label, a.p, arg_min(b.e, d * 64 + b.e) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.label, x.p, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i]))) AS d
        FROM parts x JOIN book{k} b USING (p)) a JOIN book{k} b ON a.p = b.p AND a.e = b.e GROUP BY a.vec_id, a.label, a.p)"""
_LEARN = """,
sums{k} AS (SELECT p, e, i, sum(x.x[i]) AS s, count(*) AS n FROM code{k} JOIN parts x USING (vec_id, p), range(1, 1 + (SELECT max(len(x)) FROM parts)) t(i) GROUP BY p, e, i),
book{j} AS (SELECT b.p, b.e, coalesce(f.x, b.x) AS x FROM book{k} b
  LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{k} GROUP BY p, e) f USING (p, e)),"""
OP13_SQL = (
    """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
book0 AS (SELECT p, e, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts) WHERE e < 64),"""
    + "".join(_ROUND.format(k=k) + (_LEARN.format(k=k, j=k + 1) if k < 2 else "") for k in range(3))
    + """,
coded AS (SELECT vec_id, label, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM code2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded
"""
)
