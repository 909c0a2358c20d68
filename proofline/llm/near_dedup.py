"""Near-duplicate documents by fast similarity sketches.

Each document's set of word shingles is sketched by rounds of hashed bin
placement: in each of the first ``COORDINATES`` rounds every element falls into
a bin by hash, in each of as many more rounds into one given bin, so that every
coordinate fills, and two sketches agree in a coordinate with the probability of
the sets' similarity. Bands of coordinates propose candidates, two bits of each
coordinate estimate their similarity, and full sets confirm every link.

No bucket is expanded into its pairs:

1. Documents of equal sets form a class and are represented by one of them.
2. Each member of a bucket is compared with a few pivots of the bucket and its
   best candidate is confirmed.
3. What a bucket then holds outside its largest component is compared with all
   its members, in blocks of bounded size. The best candidates of each outsider
   are confirmed, and most groups are then one component.
4. Members that still have candidates of another component are gathered, by the
   buckets they share, into clusters. In each cluster outsiders are held against
   all members by their full sets, in blocks; only links come out of a block.

Links between documents of one component need no proof, so the work stays near
the number of documents. Buckets have no cap. With 32 bands of 4 coordinates a
pair at the threshold of 0.75 is missed with a probability of 5e-6, by the
estimate's limit with 3e-7.

Defined results: a null or blank text has no shingles and links with nothing; a
null doc_id links with nothing, its component is null and it is kept; rows that
repeat a doc_id are one document, for whose links the greatest of their texts
stands where they differ; an empty table gives no rows. Links are confirmed on
64-bit hashes of shingles: that a pair of texts of some 1,000 shingles has any
two different ones of the same hash has a chance of about 1e-13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import cut, release, small_batches
from proofline.llm.components import bounded, connected_components
from proofline.llm.shingles import mix, overlap, shingle_sets
from proofline.llm.tokens import slices

COORDINATES = 128
PER_BAND = 4
#: Of 128 coordinates' two bits; at a similarity of 0.75, 104 agree on average, with a deviation of 4.4.
AGREE = 82
PIVOTS = 4
#: Candidates of an outsider, in each block, that are tried before all others.
BEST = 3
OUT_BLOCK = 2048
ALL_BLOCK = 8192
#: The same for blocks of full sets, by the shingles they hold.
OUT_SHINGLES = 250_000
ALL_SHINGLES = 1_000_000
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_NONE = np.uint64(2**64 - 1)
_PAIRS = np.uint64(0x5555555555555555)


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches of non-empty sets given in a row; one row of coordinates a set."""
    t = COORDINATES
    out = np.full((len(sizes), t), _NONE)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    open_sets = np.ones(len(sizes), bool)
    for k in range(2 * t):
        h = mix(values ^ _SEEDS[k])
        bins = (h & np.uint64(t - 1)).astype(np.int64) if k < t else np.full(len(h), k - t)
        np.minimum.at(out.reshape(-1), owner * t + bins, (np.uint64(k) << np.uint64(56)) | (h >> np.uint64(8)))
        still = (out == _NONE).any(1)
        if not still.any():
            break
        if still.sum() < open_sets.sum():
            keep = still[owner]
            values, owner, open_sets = values[keep], owner[keep], still
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each band; bands differ in their keys."""
    bands = sketch.reshape(len(sketch), COORDINATES // PER_BAND, PER_BAND)
    key = np.arange(1, bands.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)
    for k in range(PER_BAND):
        key = mix(key ^ bands[:, :, k])
    return key.view(np.int64)


def two_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, in four numbers."""
    low = (mix(sketch) & np.uint64(3)).reshape(len(sketch), COORDINATES // 32, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2).view(np.int64)


_SKETCH = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("keys", pa.list_(pa.int64()))] + [(f"s{k}", pa.int64()) for k in range(4)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        for a, b in slices(texts):
            values, sizes = shingle_sets(texts[a:b])
            full = np.flatnonzero(sizes)
            sketch = sketches(values, sizes[full])
            keys, bits = band_keys(sketch), two_bits(sketch)
            place = {int(k): i for i, k in enumerate(full)}
            ends = np.cumsum(sizes)
            names = [hashlib.blake2b(values[e - n : e].tobytes(), digest_size=16).digest() if n else None for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            got = [place.get(k) for k in range(b - a)]
            columns = [ids[a:b], sizes, names, [keys[i] if i is not None else None for i in got]]
            columns += [[int(bits[i, w]) if i is not None else None for i in got] for w in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _SKETCH, strict=True)], schema=pa.schema(_SKETCH))


def _agreement(prefix: str) -> Column:
    """Coordinates in which a row's bits agree with those named with a prefix."""
    apart = None
    for w in range(4):
        x = F.col(f"s{w}").bitwiseXOR(F.col(f"{prefix}s{w}"))
        n = F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        apart = n if apart is None else apart + n
    return F.lit(COORDINATES) - apart


def _by_pivots(members: DataFrame) -> DataFrame:
    """(a, b): each member's best candidate among its buckets' pivots."""
    sides = ["id", "s0", "s1", "s2", "s3"]
    draws = [F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), *sides)).alias(f"p{j}") for j in range(PIVOTS)]
    rows = members.join(members.groupBy("key").agg(*draws), "key")
    choices = []
    for j in range(PIVOTS):
        near = _agreement(f"p{j}.")
        fits = (F.col(f"p{j}.id") != F.col("id")) & (near >= AGREE)
        choices.append(F.when(fits, F.struct(near.alias("n"), (-F.col(f"p{j}.id")).alias("p"))))
    best = rows.select("id", F.array_max(F.array(*choices)).alias("best")).filter("best is not null").groupBy("id").agg(F.max("best").alias("best"))
    return best.select(F.least("id", -F.col("best.p")).alias("a"), F.greatest("id", -F.col("best.p")).alias("b")).distinct()


_BLOCK = "key long, q int, m int, out boolean, id long, component long, s0 long, s1 long, s2 long, s3 long"


def _compare(batches: Iterator[pa.RecordBatch], best: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, q, m): each such group is compared, outsiders with all.

    ``best``: gives so many candidates of each outsider. None: gives each member
    that has a candidate, with one of them for all.
    """
    held: list[np.ndarray] = []

    def pairs(x: np.ndarray) -> list[np.ndarray]:
        out, rest, found = x[x[:, 3] == 1], x[x[:, 3] == 0], []
        bits = rest[:, 6:].view(np.uint64)
        step = max(1, 2_000_000 // max(1, len(rest)))
        for a in range(0, len(out), step):
            own = out[a : a + step]
            apart = np.zeros((len(own), len(rest)), np.uint8)
            for w in range(4):
                d = own[:, 6 + w, None].view(np.uint64) ^ bits[None, :, w]
                apart += np.bitwise_count((d | (d >> np.uint64(1))) & _PAIRS)
            apart[own[:, 5, None] == rest[None, :, 5]] = COORDINATES + 1
            if best is not None and len(rest) > best:
                j = np.argpartition(apart, best, axis=1)[:, :best]
                i = np.repeat(np.arange(len(own)), best)
                i, j = (k[apart[i, j.ravel()] <= COORDINATES - AGREE] for k in (i, j.ravel()))
            else:
                i, j = np.nonzero(apart <= COORDINATES - AGREE)
            if len(i) and best is None:
                involved = np.unique(np.concatenate((own[i, 4], rest[j, 4])))
                found.append(np.stack((np.full(len(involved), involved[0]), involved), 1))
            elif len(i):
                found.append(np.stack((np.minimum(own[i, 4], rest[j, 4]), np.maximum(own[i, 4], rest[j, 4])), 1))
        return found

    def emit(found: list[np.ndarray]):
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        x = np.stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)], 1)
        if not len(x):
            continue
        x = np.concatenate([*held, x])
        starts = np.flatnonzero(np.concatenate(([True], (x[1:, :3] != x[:-1, :3]).any(1))))
        found = [p for a, b in zip(starts[:-1], starts[1:], strict=True) for p in pairs(x[a:b])]
        held = [x[starts[-1] :]]
        if found:
            yield emit(found)
    if held and (found := pairs(held[0])):
        yield emit(found)


def _blocks(rows: DataFrame, out_block: int, all_block: int, parts: int, weight: Column | None = None) -> DataFrame:
    """Rows (key, id, component, more) of keys with several components, dealt into blocks.

    Within a key the members outside its largest component (``out``) meet all
    members: outsiders come in ``q`` blocks, all in ``m`` blocks, and each block
    of one meets each of the other. A block has the given weight on average; a
    row weighs 1 unless ``weight`` is given. Sorted by (key, q, m) within partitions.
    """
    more = [c for c in rows.columns if c not in ("key", "id", "component")]
    per = rows.groupBy("key", "component").agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    stats = per.groupBy("key").agg(F.sum("n").alias("_all"), F.max(F.struct("n", "component")).alias("_top")).filter("_all > _top.n")
    nq = F.ceil((F.col("_all") - F.col("_top.n")) / out_block).cast("int")
    stats = stats.select("key", F.col("_top.component").alias("_top"), nq.alias("_nq"), F.ceil(F.col("_all") / all_block).cast("int").alias("_nm"))
    rows = rows.join(stats, "key")
    q, m = (F.pmod(F.xxhash64("id", F.lit(s)), F.col(n)).cast("int") for s, n in (("q", "_nq"), ("m", "_nm")))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    roles = F.when(F.col("component") != F.col("_top"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("out", F.explode(roles))
    rows = rows.withColumn("_other", F.explode(F.when(F.col("out"), every("_nm")).otherwise(every("_nq"))))
    rows = rows.select("key", F.when(F.col("out"), q).otherwise(F.col("_other")).alias("q"), F.when(F.col("out"), F.col("_other")).otherwise(m).alias("m"), "out", "id", "component", *more)
    return rows.repartition(parts, "key", "q", "m").sortWithinPartitions("key", "q", "m")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return cut(members.join(bounded(labels), "id", "left").withColumn("component", F.coalesce("component", "id")))


def _by_sketches(members: DataFrame, best: int | None, parts: int) -> DataFrame:
    dealt = _blocks(members, OUT_BLOCK, ALL_BLOCK, parts)
    return dealt.mapInArrow(lambda batches: _compare(batches, best), "a long, b long").distinct()


def _spanning_links(out: list[tuple], every: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between outsiders and members, (id, component, text) each; one suffices for two components."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    values, sizes = shingle_sets([r[2] for r in every])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(every)), sizes)[order]
    own, own_sizes = shingle_sets([r[2] for r in out])
    links, end = [], 0
    for (name, component, _), n in zip(out, own_sizes.tolist(), strict=True):
        mine, end = own[end : end + n], end + n
        low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(every))
        for k in np.flatnonzero((100 * shared >= percent * (n + sizes - shared)) & (shared > 0)).tolist():
            a, b = root(component), root(every[k][1])
            if a != b and name != every[k][0]:
                up[max(a, b)] = min(a, b)
                links.append((min(name, every[k][0]), max(name, every[k][0])))
    return links


def _link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, every = None, [], []

        def emit():
            links = _spanning_links(out, every, percent) if out and every else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            for *at, is_out, name, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    yield emit()
                    key, out, every = at, [], []
                (out if is_out else every).append((name, component, text))
        yield emit()

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for a, b in slices(right):
                texts = dict(zip(ids_a[a:b], left[a:b], strict=True)) | dict(zip(ids_b[a:b], right[a:b], strict=True))
                values, sizes = shingle_sets(list(texts.values()))
                ends = np.cumsum(sizes)
                sets = {k: values[e - n : e] for k, n, e in zip(texts, sizes.tolist(), ends.tolist(), strict=True)}
                good = []
                for x, y in zip(ids_a[a:b], ids_b[a:b], strict=True):
                    shared = overlap(sets[x], sets[y])
                    if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                        good.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shape = "doc_id long, n_shingles long, set_id binary, keys array<long>, s0 long, s1 long, s2 long, s3 long"
    sketched = cut(docs.mapInArrow(_sketch, shape))
    linked = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "s0", "s1", "s2", "s3")).alias("r"))
    classes = cut(classes.select("set_id", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.keys", "r.s0", "r.s1", "r.s2", "r.s3"))

    in_bands = classes.select("id", F.explode("keys").alias("key"))
    shared = in_bands.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    members = in_bands.join(shared, "key").join(classes.select("id", "s0", "s1", "s2", "s3"), "id")
    members = cut(members)
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = cut(docs.join(wanted, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")))
    release(spark)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        pairs = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return cut(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"))

    tried = cut(_by_pivots(members))
    labels = connected_components(confirmed(tried))
    more = cut(_by_sketches(_labelled(members, labels), BEST, parts).join(tried, ["a", "b"], "left_anti"))
    labels = connected_components(confirmed(more), labels)

    clusters = connected_components(_by_sketches(_labelled(members, labels), None, parts)).withColumnRenamed("component", "key")
    rest = clusters.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = classes.select("id", "n_shingles")
    rest = rest.join(sizes, "id").join(texts.withColumnRenamed("doc_id", "id"), "id").select("key", "id", "component", "n_shingles", "text")
    dealt = _blocks(rest, OUT_SHINGLES, ALL_SHINGLES, parts, F.col("n_shingles")).drop("n_shingles")
    labels = connected_components(dealt.mapInArrow(_link(percent), "a long, b long"), labels)

    of_class = classes.select("set_id", "id").join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("_c"))
    found = sketched.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.size + q.size - shared.n)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least_id AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, l.b IS NULL OR l.b >= d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id l USING (doc_id)
"""


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group, with all columns.

    A null doc_id stays. Joined on doc_id.
    """
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
