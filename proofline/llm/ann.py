"""Approximate nearest neighbours by cosine: inverted file with product codes.

Coarse centroids and the codebooks of product-quantised residuals are fitted on
a sample of at most ``TRAIN_ROWS`` vectors; every vector is indexed. A query
probes the lists of its nearest centroids, ranks their members by asymmetric
distance tables, and the best are ranked anew by the exact cosine of the
original vectors, in double precision.

Lists are laid into tiles of bounded size, neighbours together, and a list with a
third of all vectors is cut into many. A query goes once to each tile that holds
lists it probes, with their numbers, and a tile's queries come in blocks; within a
task distances are ranked list by list and the best of the whole tile are ranked
anew. So rows grow with queries times tiles, not with queries times lists.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another length than most take no part; nor do rows without
a vec_id. Rows with the query's own vec_id are not candidates; other rows that
repeat a vec_id are candidates each, and a repeated query is asked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import cut, small_batches

TRAIN_ROWS = 20_000
MAX_LISTS = 4096
#: Share of the lists that a query probes. Vectors without clear clusters need about 0.45 for a recall of 0.92.
PROBED = 0.6
SUBSPACES = 16
#: Members of a tile that are ranked anew for a query.
RERANK = 160
MEMBERS_PER_TILE = 4096
QUERIES_PER_BLOCK = 1024


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, many: int = 1) -> np.ndarray:
    far = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    if many == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :many]


def _k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([_nearest(x[a : a + 4096], centres)[:, 0] for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Codebooks:
    """Coarse centroids, and one codebook of residuals for each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int):
        x = _unit(sample)
        self.dim = x.shape[1]
        self.width = -(-self.dim // subspaces)
        self.subspaces = -(-self.dim // self.width)
        self.coarse = _k_means(x, lists)
        rest = self._split(x - self.coarse[_nearest(x, self.coarse)[:, 0]])
        self.codes = [_k_means(rest[:, s], min(256, len(x))) for s in range(self.subspaces)]

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.subspaces * self.width), np.float32)
        padded[:, : self.dim] = x
        return padded.reshape(len(x), self.subspaces, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _unit(x)
        at = _nearest(x, self.coarse)[:, 0]
        rest = self._split(x - self.coarse[at])
        return at, np.stack([_nearest(rest[:, s], self.codes[s])[:, 0] for s in range(self.subspaces)], 1).astype(np.uint8)

    def tables(self, x: np.ndarray, which: int) -> np.ndarray:
        """Squared distances from each query's residual to each code of each subspace."""
        rest = self._split(_unit(x) - self.coarse[which])
        out = np.full((len(x), self.subspaces, 256), np.inf, np.float32)
        for s, book in enumerate(self.codes):
            out[:, s, : len(book)] = ((rest[:, s, None, :] - book[None]) ** 2).sum(2)
        return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows over a power of two, which keeps every bit and lets no square overflow."""
    return v / np.exp2(np.frexp(np.abs(v).max(-1, keepdims=True))[1])


def _prepared(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled rows and their lengths."""
    v = _scaled(np.asarray(v, np.float64))
    return v, np.sqrt((v * v).sum(-1))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def tiles_of(sizes: np.ndarray, coarse: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First tile and number of tiles of each list; small lists share one, in order along the centroids' main axis."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    axis = np.linalg.svd(coarse - coarse.mean(0), full_matrices=False)[2][0] if len(coarse) > 1 else np.zeros(coarse.shape[1])
    tile, held, last = 0, 0, -1
    for k in np.argsort(coarse @ axis, kind="stable"):
        if parts[k] > 1:
            first[k], last = last + 1, last + parts[k]
        else:
            if last < 0 or held < 0 or held + sizes[k] > most:
                tile, held, last = last + 1, 0, last + 1
            first[k], held = tile, held + sizes[k]
            continue
        held = -1  # the next small list opens a tile
    return first, parts


def nearest_in_tile(queries: pd.DataFrame, members: pd.DataFrame, books: Codebooks, top: int, rerank: int) -> pd.DataFrame:
    """The best members of a tile for each of a block of queries (query_id, vector, lists)."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(queries) and len(members):
        members = members.sort_values(["list", "vec_id"], kind="stable")
        ids, vectors, lists = members["vec_id"].to_numpy(), _matrix(members["vector"]), members["list"].to_numpy()
        codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
        asked, names = _matrix(queries["vector"]), queries["query_id"].to_numpy()
        wanted = queries["lists"].to_numpy()
        who, what = np.repeat(np.arange(len(queries)), [len(w) for w in wanted]), np.concatenate([np.asarray(w, np.int64) for w in wanted])
        starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(starts, np.append(starts[1:], len(lists)), strict=True):
            asking = who[what == lists[a]]
            for k in range(0, len(asking), 64):
                some = asking[k : k + 64]
                tables = books.tables(asked[some], int(lists[a]))
                far = np.zeros((len(some), b - a), np.float32)
                for j in range(books.subspaces):
                    far += tables[:, j][:, codes[a:b, j]]
                far[names[some, None] == ids[None, a:b]] = np.inf
                close = np.argsort(far, axis=1, kind="stable")[:, :rerank]  # ties stay in order of vec_id
                near.append((np.repeat(some, close.shape[1]), (close + a).ravel(), np.take_along_axis(far, close, 1).ravel()))
        q, m, far = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, np.int64),) * 3
        real = np.isfinite(far)
        q, m, far = q[real], m[real], far[real]
        order = np.lexsort((ids[m], far, q))
        q, m = q[order], m[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, m = q[place < rerank], m[place < rerank]
        (left, left_length), (right, right_length) = _prepared(asked), _prepared(vectors)
        for k in range(0, len(q), 16_384):
            x, y = q[k : k + 16_384], m[k : k + 16_384]
            out.append((names[x], ids[y], (left[x] * right[y]).sum(-1) / (left_length[x] * right_length[y])))
    found = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found.groupby("query_id").head(top)


def search(
    vectors: DataFrame,
    is_query: Column,
    top: int = 5,
    probed: float = PROBED,
    rerank: int = RERANK,
    train_rows: int = TRAIN_ROWS,
    subspaces: int = SUBSPACES,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest rows of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    shape = "query_id long, rank int, vec_id long, score double"
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    if not lengths:
        return spark.createDataFrame([], shape)
    rows = rows.filter(F.size("vector") == lengths[0]["n"])
    total = lengths[0]["count"]
    # a sample of about train_rows and at most so many, by a hash of the id
    drawn = rows if total <= train_rows else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(1_000_003 * 0.95 * train_rows / total))
    sample = np.array([r["vector"] for r in drawn.limit(train_rows).select("vector").toLocalIterator()], np.float64)
    if not len(sample):  # one id holds nearly all rows
        sample = np.array([r["vector"] for r in rows.limit(train_rows).select("vector").toLocalIterator()], np.float64)
    books = Codebooks(sample, int(min(MAX_LISTS, len(sample), max(1, round(total**0.5)))), subspaces)
    shared = spark.sparkContext.broadcast(books)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                at, codes = shared.value.encode(np.stack(f["vector"].to_numpy()))
                vectors = [np.asarray(v, np.float64).tobytes() for v in f["vector"]]
                yield f.assign(vector=vectors, list=at.astype(np.int32), code=[c.tobytes() for c in codes])

    index = cut(rows.mapInPandas(assign, "vec_id long, vector binary, list int, code binary"))
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    held = np.array([sizes.get(k, 0) for k in range(len(books.coarse))])

    first, parts = tiles_of(held, books.coarse, MEMBERS_PER_TILE)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                order = _nearest(_unit(np.stack(f["vector"].to_numpy())), shared.value.coarse, len(held)) if len(held) > 1 else np.zeros((len(f), 1), int)
                # more lists than usual where the nearest hold too few: the query's own row and top others
                enough = (np.cumsum(held[order], 1) < top + 1).sum(1) + 1
                many = np.maximum(int(np.ceil(probed * len(held))), enough)
                rows = []
                for name, vector, o, m in zip(f["query_id"], f["vector"], order, many, strict=True):
                    by_tile: dict[int, list[int]] = {}
                    for k in o[: int(m)].tolist():
                        for tile in range(first[k], first[k] + parts[k]):
                            by_tile.setdefault(tile, []).append(k)
                    raw = np.asarray(vector, np.float64).tobytes()
                    rows += [(name, raw, tile, lists) for tile, lists in by_tile.items()]
                yield pd.DataFrame(rows, columns=["query_id", "vector", "tile", "lists"])

    asked = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = cut(asked.mapInPandas(probe, "query_id long, vector binary, tile long, lists array<int>"))
    blocks = asked.groupBy("tile").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("_blocks"))
    asked = asked.join(blocks, "tile").withColumn("q", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int")).drop("_blocks")
    of_list = lambda values: F.element_at(F.lit(values.tolist()), F.col("list") + 1)
    members = index.withColumn("tile", of_list(first) + F.pmod(F.xxhash64("vec_id"), of_list(parts)))
    members = members.join(blocks, "tile").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    found = asked.groupBy("tile", "q").cogroup(members.groupBy("tile", "q")).applyInPandas(
        lambda a, b: nearest_in_tile(a, b, shared.value, top, rerank), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)
