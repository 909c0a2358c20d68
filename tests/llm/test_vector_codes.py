"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from proofline.llm import vector_codes as vc

SHAPE = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error by row, and the codebooks; rows of one length."""
    numbers = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (numbers[k][0] is None, numbers[k][0] or 0, rows[k][1]))
    width = len(numbers[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(numbers[k][1], p) for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(v):
        found = [min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
        return [k for _, k in found], sum(d for d, _ in found)

    for _ in range(rounds):
        codes = [assign(v)[0] for _, v in numbers]
        for p in range(parts):
            held = {}
            for (_, v), c in zip(numbers, codes):
                held.setdefault(c[p], []).append(cut(v, p))
            for k, members in held.items():
                books[p][k] = [sum(col) // len(members) for col in zip(*members)]
    return [(i, bytes(c).hex(), e) for (i, v), (c, e) in zip(numbers, (assign(v) for _, v in numbers))], books


def run(spark, rows, schema=SHAPE):
    coded, books = vc.compress(spark.createDataFrame(rows, schema).withColumn("code", F.lit("x")).withColumn("error", F.lit("y")).repartition(3))
    return coded, books


def check(spark, rows):
    coded, books = run(spark, rows)
    want, want_books = plain(rows)
    found = [(r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in coded.collect()]
    assert sorted(found, key=repr) == sorted([(i, c, e if e < 2**63 else None) for i, c, e in want], key=repr)
    assert [b.tolist() for b in books] == want_books
    assert vc.books_digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()
    return coded


def test_codes_equal_integer_arithmetic(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.normal(0, 0.3, 32).astype(np.float32)], int(i) % 3) for i in range(300)]
    check(spark, rows)


def test_ties_repeats_and_nulls(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i) // 2, [float(x) / 4 for x in draw.integers(-2, 3, 32)], None if i % 5 == 0 else 1) for i in range(200)]
    rows += rows[:30] + [(None, [0.25] * 32, 7), (None, [-0.25] * 32, 7)]
    coded = check(spark, rows)
    found = vc.with_label_error(coded).collect()
    sums = {}
    for r in found:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert len(found) == len(rows) and all(r["label_error"] == sums[r["label"]] for r in found)


def test_few_and_large_numbers(spark):
    draw = np.random.default_rng(5)
    few = [(int(i), [float(x) for x in draw.normal(0, 1, 16).astype(np.float32)], 1) for i in range(5)]
    check(spark, few)
    for size in (2.0**20, 2.0**28, 2.0**60, 3e38):
        large = [(i + 10, [float(np.float32(x * size)) for x in draw.uniform(-1, 1, 16)], 1) for i in range(3)]
        rows = few + large
        coded, books = run(spark, rows)
        want, want_books = plain(rows)
        assert sorted((r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in coded.collect()) == sorted((i, c, e if e < 2**63 else None) for i, c, e in want)
        assert [b.tolist() for b in books] == want_books


def test_odd_rows(spark):
    ok = [(k, [float(k % 7)] * 16, None) for k in range(80)]
    odd = [(200, None, 1), (201, [1.0, None] * 8, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 1)]
    strange = [(204, [], 1), (205, [1.0] * 15, 2), (206, [1.0] * 32, None)]
    coded, _ = run(spark, ok + odd + strange)
    found = vc.with_label_error(coded).collect()
    assert sorted(r["vec_id"] for r in found) == sorted([*range(80), 204, 205, 206])
    assert {r["vec_id"] for r in found if r["code"] is None} == {204, 205, 206}
    assert all(r["label_error"] is None for r in found)  # each label holds a vector without a code
    coded, books = run(spark, odd)
    assert coded.collect() == [] and books == [] and vc.with_label_error(coded).collect() == []
    assert run(spark, [])[0].collect() == []


def test_intervals_hold_the_best(spark):
    """Close calls: entries that float32 can't tell apart."""
    draw = np.random.default_rng(6)
    book = draw.integers(-(2**26), 2**26, (64, 4))
    book[1:20] = book[0] + draw.integers(-1, 2, (19, 4))
    x = np.concatenate([book + draw.integers(-1, 2, book.shape), draw.integers(-(2**26), 2**26, (500, 4))])
    codes, errors = vc.nearest(x, book)
    exact, least = vc.nearest_of_any_size(x, book)
    assert codes.tolist() == exact.tolist() and errors.tolist() == least.tolist()


def test_codes_stand_for_close_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    coded, books = vc.compress(vectors)
    original = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    close = [np.dot(v := vc.decompress(bytes(r["code"]), books), o := original[r["vec_id"]]) / np.linalg.norm(v) / np.linalg.norm(o) for r in coded.collect()]
    assert np.mean(close) > 0.85
