"""Language identification by hierarchical discrimination.

A text's language family is predicted first, by linear support vector machines
of one family against the rest; then one-versus-one linear machines separate
the languages of that family. Features are the square roots of hashed counts of
byte pairs and triples of the whole lower-cased text, at unit length.

The machines are fitted on the driver on a sample of at most ``TRAIN_ROWS``
labelled rows, shared evenly among the labels and drawn by a hash of doc_id.

Defined results: a text that is null or has no letter gets ``und`` and score 0,
as does every text when nothing can be learned; rows without a label are never
learned from; repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import small_batches
from proofline.llm.tokens import forget, slices

TRAIN_ROWS = 2400
FEATURES = 4096
#: What a worker holds at a time: texts by number and characters, and bytes being hashed.
SLICE_ROWS, SLICE_CHARS, BLOCK_BYTES = 256, 1_000_000, 262_144
UNDETERMINED = "und"
#: Families of some languages. A language of none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn mr ne gu pa ur sa",
    "turkic": "tr az kk uz ky tt",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text; the last column is constant."""
    raw = [(t or "").lower().encode("utf-8", "replace").translate(_FOLD) for t in texts]
    data = np.frombuffer(b"   ".join([b"", *raw, b"  "]), np.uint8)[2:]  # each text keeps one space before it and two after
    ends = np.cumsum([len(r) + 3 for r in raw])
    counts = np.zeros(len(raw) * FEATURES, np.int32)
    for start in range(0, int(ends[-1]) if raw else 0, BLOCK_BYTES):  # the hashes of a block at a time
        stop = min(start + BLOCK_BYTES, int(ends[-1]))
        owner = np.searchsorted(ends, np.arange(start, stop), "right")
        first, n = int(owner[0]), stop - start
        owner = (owner - first) * FEATURES
        block = data[start : stop + 2].astype(np.uint32)
        triple = ((block[:n] + block[1 : n + 1] * np.uint32(257) + block[2 : n + 2] * np.uint32(66049)) * np.uint32(2654435761)) >> np.uint32(20)
        pair = ((block[:n] * np.uint32(263) + block[1 : n + 1] + np.uint32(99991)) * np.uint32(2246822519)) >> np.uint32(20)
        found = np.bincount(owner + triple), np.bincount(owner + pair)
        for hashed in found:
            counts[first * FEATURES : first * FEATURES + len(hashed)] += hashed.astype(np.int32)
    x = np.sqrt(counts.reshape(len(raw), FEATURES).astype(np.float32))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return np.concatenate((x, np.full((len(raw), 1), 0.5, np.float32)), 1)


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 3e-5, rounds: int = 150) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss (accelerated gradient); y is -1 or 1.

    Both classes weigh the same.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step = 1 / (ridge + 2.5)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ridge * ahead - 2 * (x.T @ (weight * y * slack)))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Families against the rest, then languages of a family against each other."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        kinds, given = np.array([family_of(v) for v in langs]), np.array(langs)
        self.families = sorted(set(kinds))
        self.langs = {f: sorted(set(given[kinds == f])) for f in self.families}
        one = lambda mask, part=slice(None): fit_machine(x[part], np.where(mask[part], 1, -1).astype(np.float32))
        if len(self.families) == 2:
            w = one(kinds == self.families[0])
            self.family_weights = np.stack((w, -w), 1)
        else:
            self.family_weights = np.stack([one(kinds == f) for f in self.families], 1) if len(self.families) > 1 else np.zeros((x.shape[1], len(self.families)), np.float32)
        self.pairs = {f: {(a, b): one(given == a, (given == a) | (given == b)) for a, b in combinations(self.langs[f], 2)} for f in self.families}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        margins = x @ self.family_weights
        chance = np.exp(2 * (margins - margins.max(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        best = margins.argmax(1)
        out, score = np.empty(len(x), object), chance[np.arange(len(x)), best]
        for k, f in enumerate(self.families):
            rows, langs = np.flatnonzero(best == k), self.langs[f]
            votes, sure = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for (a, b), w in self.pairs[f].items():
                margin = x[rows] @ w
                p = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
                i, j = langs.index(a), langs.index(b)
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                sure[:, i] = np.minimum(sure[:, i], p)
                sure[:, j] = np.minimum(sure[:, j], 1 - p)
            pick = (votes + 0.5 * sure).argmax(1)
            out[rows] = np.array(langs, object)[pick]
            score[rows] *= sure[np.arange(len(rows)), pick]
        return out.tolist(), np.clip(score, 0, 1)


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the non-null labels of the rows that may be learned from."""
    small_batches(docs.sparkSession)
    known = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Model(np.zeros((0, FEATURES + 1), np.float32), [])
    share = max(1, train_rows // len(counts))
    dice = 1_000_003
    limit = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(int(dice * min(1.0, share / n)) + 1))])
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("lang"), F.col("doc_id").cast("string")), F.lit(dice)) < limit[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in slices(texts, SLICE_CHARS, SLICE_ROWS):
                x = features(texts[a:b]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(langs[a:b], pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    # the draw is about train_rows; the limit bounds what one hash value may bring
    rows = drawn.select("text", "lang").mapInArrow(run, "lang string, x binary").limit(2 * train_rows + 2 * len(counts)).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES + 1), np.float32)
    return Model(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that has encoded texts before needs their units no more, and this stage much memory
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE_CHARS, SLICE_ROWS):
                langs, scores = shared.value.predict(features(texts[a:b]))
                for k, text in enumerate(texts[a:b]):
                    if not text or not any(map(str.isalpha, text)):
                        langs[k], scores[k] = UNDETERMINED, 0.0
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(np.asarray(scores, np.float64))], names=[*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
