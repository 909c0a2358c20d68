"""The operators against brute force, and their defined results in odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import ann, exact_dedup, html_text, langid, mixing, near_dedup, packing, pii, shingles, token_files, tokens, warc
from proofline.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000


def frame(spark, rows, schema=DOC, **extra):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", None), (2, "", None, None, 0), (3, "   \n\t", "en", "b", 5),
        (4, "one two three four five six", "en", "a", 27), (4, "one two three four five six", "en", "a", 27),
        (5, "ONE two three four five  six", "en", "a", 27), (6, LONG, "en", "a", len(LONG)), (7, LONG, None, None, None), (8, "12345 ... !!", "en", "c", 12),
        (-9, "one two three four five six", "fr", "a", 27), (None, "one two three four five six", "fr", "a", 27),
    ]
    df = spark.createDataFrame(rows, DOC)
    for name in ("id", "key", "size", "copies", "kept", "n", "_row", "_id", "_n", "component", "text_sha256", "rank", "_gone"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- mixing


def water_fill(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    docs = docs_of(spark)
    rows = mixing.mix_plan(docs, rows_per_bucket=8).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    sizes = Counter()
    for r in texts.values():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = water_fill(sizes), Counter()
    largest = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] >= int(want[r["source"]] / max(1, sizes[r["source"]]) + 1e-9) or not r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix_plan(docs.repartition(7), rows_per_bucket=8).collect()))
    mixed = mixing.mix(docs, rows_per_bucket=8)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mixing_prefers_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    good = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    chosen = mixing.mix_plan(docs, weights=(1.0, 3.0), quality=good).filter("source = 'a' and copies > 0").collect()
    assert len(chosen) == 1000 and sum(r["doc_id"] % 2 == 0 for r in chosen) > 700


def test_mixing_odd(spark, odd):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == 12 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# -- exact duplicates


@pytest.mark.parametrize("heavy", [2, 1000])
def test_exact(spark, odd, heavy):
    for docs in (docs_of(spark), odd, docs_of(spark).unionByName(docs_of(spark).filter("doc_id < 20"))):
        groups = defaultdict(list)
        for r in docs.collect():
            groups[r["text"] or ""].append(r["doc_id"])
        found = exact_dedup.duplicate_groups(docs, heavy=heavy).collect()
        assert len(found) == sum(map(len, groups.values()))
        by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
        kept = Counter()
        for r in found:
            ids = by_digest[r["text_sha256"]]
            largest = max((x for x in ids if x is not None), default=None)
            assert r["keep_id"] == largest and r["group_size"] == len(ids)
            if r["kept"]:
                assert r["doc_id"] == largest
                kept[r["text_sha256"]] += 1
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        stay = exact_dedup.drop_duplicates(docs, heavy=heavy)
        assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


# -- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    None, "", "a@b.com_x@y.org, a.b+c@d-e.f.gh. @x.y z@ q@w", "1.2.3.4.5.6.7.8 12.3.4 999.1.1.1 0001.2.3.0255 1..2.3.4 1.2.3.4",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 4111  1111 1111 1111 9 4111111111111111", "4111 1111 1111 1111 4111 1111 1111 1111",
    "call +1 (555) 010-9999 or +49.30.1234567 +12 +1 2345678901234567890 ++4930123456789", "é𝒳 mail é𝒳a@b.co 𝒳 +4930123456789",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE89370400440532013001", "x" * 200_000 + "@y.z " + "1" * 100_000 + " " + "7.7.7.7 " * 3000, "a@b.co " * 5000, "+1" + " 2" * 50_000,
]


def test_pii(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(PII_TEXTS)], "doc_id long, text string").unionByName(docs_of(spark).select("doc_id", "text").limit(150))
    rows = pii.find_pii(docs).select("text", F.transform("pii", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))).collect()
    assert len(rows) == docs.count()
    for text, spans in rows:
        assert [tuple(s)[:3] for s in spans if s[0] in BASE] == base_spans(text)
        assert all(text[s[1] : s[2]] == s[3] for s in spans)
        if text and text.startswith("IBAN"):
            assert [s[3] for s in spans if s[0] == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    scores = pii.find_pii(spark.createDataFrame([(1, "my card 4111111111111111"), (2, "the 4111111111111111")], "doc_id long, text string")).select("doc_id", F.col("pii")[0]["score"]).collect()
    assert dict(map(tuple, scores)) == {1: 0.85, 2: 0.6}


def test_pii_odd(spark, odd):
    found = pii.find_pii(odd)
    assert found.columns == [*odd.columns, "pii"] and found.filter("size(pii) = 0").count() == 12
    assert pii.find_pii(empty(spark)).count() == 0


# -- token ids


def library_ids(text, end):
    return tokens.encoder(tokens.default_path())._library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    draw = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "a", "é", "'s", "'", "12", "!!", "<|endoftext|>", "\x1c", "　", "Ω", "\t", "\r\n", "ab", "。", "'ll", "\xa0", "\x85", "$"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 12))) for _ in range(3000)] + [None, "", LONG]
    for text, raw in zip(texts, tokens.encoder(tokens.default_path()).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library_ids(text, 0)[:-1]


def test_token_file_gives_any_id():
    draw = np.random.default_rng(5)
    ids = np.concatenate((draw.integers(0, 300, 5000), draw.integers(0, 2**32, 3000), draw.integers(0, 50_000, 9000))).astype("<u4")
    held = token_files.TokenFile(token_files.encode_file([7, None, 8], np.array([0, 10, 10, len(ids)]), ids))
    at = draw.integers(0, len(ids), 4000)
    assert (held.take(at) == ids[at]).all() and (held.take(np.arange(len(ids))) == ids).all()
    assert held.doc_ids == [7, None, 8] and len(held.document(1)) == 0 and (held.document(0) == ids[:10]).all()


def test_token_files(spark, odd, monkeypatch):
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 2000)
    for docs in (docs_of(spark), odd):
        rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
        want, start = Counter(), 0
        for r in rows:
            ids = library_ids(r["text"], 2)
            want[r["doc_id"], start, len(ids), crc(ids)] += 1
            start += len(ids)
        assert Counter(map(tuple, token_files.read_token_files(token_files.write_token_files(docs)).collect())) == want
    with_ids = token_files.read_token_files(token_files.write_token_files(docs_of(spark).limit(5)), with_ids=True).collect()
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in with_ids)
    assert token_files.read_token_files(token_files.write_token_files(empty(spark))).count() == 0


# -- packing


@pytest.mark.parametrize("counts", [{}, {5: 3}, {2048: 4, 1: 5000}, {1500: 3, 600: 4, 548: 3, 500: 9, 7: 1000}, {3: 1}, {1024: 3, 1025: 2}])
def test_plan(counts):
    runs = packing.plan_best_fit(counts)
    held, ranks = defaultdict(list), defaultdict(set)
    for length, rank, first, each, offset in runs.tolist():
        later = [r for r in runs.tolist() if r[0] == length and r[1] > rank]
        stop = min((r[1] for r in later), default=counts[length])
        for k in range(stop - rank):
            held[first + k // each].append((offset + k % each * length, length))
            ranks[length].add(rank + k)
    assert {k: len(v) for k, v in ranks.items()} == counts
    for slots in held.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(held) == list(range(len(held)))


def first_fit_decreasing(lengths, room=2048):
    spare = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k in range(len(spare)) if spare[k] >= n), key=lambda k: spare[k], default=None)
        if best is None:
            spare.append(room - n)
        else:
            spare[best] -= n
    return len(spare)


def test_packing(spark, odd):
    for docs in (docs_of(spark), odd):
        rows = packing.pack(packing.token_pieces(docs), pieces_per_bucket=8).collect()
        want = Counter()
        for r in docs.collect():
            ids = library_ids(r["text"], 0)
            first = len(ids) % 2048 or 2048
            starts = [0, *range(first, len(ids), 2048)]
            for k, a in enumerate(starts):
                part = ids[a : (starts + [len(ids)])[k + 1]]
                want[r["doc_id"], k, a, len(part), crc(part)] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for slots in sequences.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(sequences) == first_fit_decreasing([r["length"] for r in rows])
    assert packing.pack(packing.token_pieces(empty(spark))).count() == 0


# -- nearest neighbours


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_nearest(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    found = defaultdict(list)
    for r in ann.op3_nearest(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 50 == 0)
    hit = 0
    for q, got in found.items():
        own = x[ids == q][0]
        score = (x @ own) / np.sqrt((own @ own) * (x * x).sum(1))
        score[ids == q] = -9
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert np.allclose([g[2] for g in got], [score[ids == g[1]][0] for g in got], atol=1e-12)
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        hit += sum(g[2] >= np.sort(score)[-5] - 1e-12 for g in got)
    assert hit / (5 * len(found)) >= 0.9


def test_nearest_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], None), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [inf, 1.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (50, [1e38, 0.0], 1), (None, [1.0, 0.0], 1), (9, [1.0], 1), (3, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("list", F.lit(1)).withColumn("vector", F.lit(2))
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 3, 0.0), (0, 5, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 1.0), (50, 4, 3, 0.0), (50, 5, 3, 0.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    same = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    near = ann.search(same, F.col("vec_id") % 50 == 0).filter("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [0, 1, 2, 3, 4]


# -- languages


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op7_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd(spark, odd):
    model = langid.fit(odd)
    found = langid.identify(odd.withColumn("score", F.lit(3)), model)
    assert [c for c in found.columns if c not in ("lang_pred", "score")] == odd.columns
    rows = found.collect()
    assert len(rows) == 12
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"]))) for r in rows)
    none = langid.identify(odd, langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert langid.identify(empty(spark), langid.fit(empty(spark))).count() == 0


# -- near duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            shared = len(a & b)
            if a and b and 100 * shared >= 75 * (len(a) + len(b) - shared):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_shingles():
    texts = ["A b c d e", "a B c d e f", "", None, " \x1c x", "one", "one two", "ÀB c", "Àb C", "x y z u v w x y z u v"] + ["w%d" % (k % 7) for k in range(20)]
    values, sizes = shingles.shingle_sets(texts)
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]
    ends = np.cumsum(sizes)
    sets = [values[e - n : e] for n, e in zip(sizes, ends, strict=True)]
    for a, s in zip(texts, sets, strict=True):
        for b, r in zip(texts, sets, strict=True):
            assert shingles.overlap(s, r) == len(shingle_set(a) & shingle_set(b))


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(1)
    for size, shared in ((1000, 900), (40, 30), (6, 3)):
        a = draw.integers(0, 2**63, (200, 2 * size - shared), dtype=np.uint64)
        one, two = (near_dedup.sketches(np.ascontiguousarray(x).reshape(-1), np.full(200, size)) for x in (a[:, :size], a[:, size - shared :]))
        assert abs((one == two).mean() - shared / (2 * size - shared)) < 0.02


def test_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    found = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert len({c for _, c in want.values()}) < len(want)


def test_near_groups(spark, monkeypatch):
    """A large group whose members are alike only through a centre, a chain, and a common passage; small blocks."""
    monkeypatch.setattr(near_dedup, "OUT_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "ALL_BLOCK", 32)
    monkeypatch.setattr(near_dedup, "OUT_SHINGLES", 800)
    monkeypatch.setattr(near_dedup, "ALL_SHINGLES", 1600)
    monkeypatch.setattr(near_dedup, "BEST", 1)
    draw = np.random.default_rng(2)
    word = lambda n: [f"w{k}" for k in draw.integers(0, 10**9, n)]
    rows, base, passage = [], word(100), word(60)
    for k in range(70):  # each differs from the centre in three places
        own = list(base)
        for at in draw.permutation(19)[:2]:
            own[5 * at + 3] = f"x{k}-{at}"
        rows.append((100 + k, " ".join(own)))
    rows.append((99, " ".join(base)))
    chain = word(100)
    for k in range(30):
        chain = chain[8:] + word(8)
        rows.append((300 - k, " ".join(chain)))
    rows += [(400 + k, " ".join(passage + word(int(draw.integers(5, 40))))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_near_odd(spark, odd):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == 12
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in found}
    assert by[1, 0] == (1, True) and by[2, 0] == (2, True) and by[3, 0] == (3, True)
    assert by[4, 2] == (-9, False) and by[5, 2] == (-9, False) and by[-9, 2] == (-9, True)
    assert by[None, 2] == (None, True) and by[7, 5] == (6, False)
    assert near_dedup.drop_near_duplicates(odd).columns == odd.columns
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 150), (7, 7)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- archives


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 3000)
    body = "<p>é " + "x" * 5000
    rows = [(1, "http://a", body), (2, None, body), (9, "http://b\r\nX: y", body), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", body), (7, "u", "y" * 100_000), (9, "http://b", body), (8, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "\r\n0\r\n\r\n" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1)).withColumn("_same", F.lit(2))
    got = warc.read_archives(warc.write_archives(pages), with_payload=True).collect()
    assert len(got) == len(rows)
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == body and page != 9
        want[page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None, raw] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got) == want
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_damage(spark, tmp_path):
    sha = hashlib.sha1(b"q" * 90_000).hexdigest()
    parts = warc.page_records(5, "u", b"q" * 90_000, sha, None, None, "n")
    assert len(parts) == 3
    for name, kept in (("whole", [parts[2], parts[0], parts[1]]), ("torn", parts[:2]), ("gap", [parts[0], parts[2]])):
        path = tmp_path / name
        path.write_bytes(b"".join(kept))
        (row,) = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
        assert (row["record_type"], row["payload_digest"]) == (("response", sha) if name == "whole" else ("damaged", None))


def test_chunked():
    for payload in (b"", b"a", b"\r\n" * 9000):
        assert warc.dechunked(warc.chunked(payload, 100)) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


# -- HTML

PAGES = {
    "<p>one<p>two <b>bold</b><br>next": "one\n\ntwo bold\nnext",
    "<title>t</title><script>var a='<p>x</p>';</script><style>p{}</style><div>a</div>b<div>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "* a\n* b\n  * c\n* d",
    "<ol start=3><li>x</li><li>y</ol>": "3. x\n4. y",
    "<table><tr><th>Name<th>N<tr><td>longer name<td>1</table>": "Name        | N\nlonger name | 1",
    "<table><tr><td colspan=2>wide cell here<tr><td>a<td>b<td>c</table>after": "wide cell here\na | b | c\n\nafter",
    "a<span hidden>no</span> <span style='display: none'>no</span><span style=\"visibility:hidden\">no</span>b": "a b",
    "<pre>  x\n    y</pre>z": "  x\n    y\n\nz",
    "x &amp; y &lt;z&gt; &eacute;&#233;": "x & y <z> éé",
    "<!-- no --><h1>T</h1>text<!-- open": "T\n\ntext",
    "a < b <3 c": "a < b <3 c",
    "<blockquote>q<p>r</blockquote>": "  q\n\n  r",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "</p></div>ok</b>": "ok",
    "<head><meta charset=x><title>t</title>\n<p>in body": "in body",
    "<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>": "a     | d\n      |\nb | c |",
    "": "",
}


@pytest.mark.parametrize("html", PAGES)
def test_html(html):
    assert html_text.render(html) == PAGES[html]


def test_html_odd(spark):
    deep, unclosed = "<div>" * 50_000 + "x" + "<b>" * 50_000, "<p" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", deep), (4, "u", unclosed), (None, "u", "<p>a"), (5, "u", "<li>" * 3000 + "x"), (6, "u", "<a b='" * 3000), (7, "u", "a" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    found = html_text.extract_text(pages)
    assert found.columns == ["page_id", "url", "html", "text"]
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert got[4] == unclosed and got[7] == "a" * 2_000_000
    assert got[1] is None and got[2] == "" and got[3] == "x" and got[None] == "a" and "x" in got[5]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def words(text):
    return Counter(re.findall(r"\w+", text))


def test_html_keeps_all_words(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", " ", r["html"])
        if not re.search(r"hidden|display|noscript|template|iframe", plain):
            from html import unescape

            assert words(unescape(re.sub(r"(?s)<[a-zA-Z/!](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", " ", plain))) - words(html_text.render(r["html"])) == Counter()


def test_token_file_scan_and_random_access_agree():
    import numpy as np

    from proofline.llm.token_files import TokenFile, encode_file

    rng = np.random.default_rng(5)
    for size, top in ((1, 3), (5, 1 << 32), (511, 256), (512, 257), (5000, 50_000), (5000, 1 << 24)):
        ids = rng.integers(0, top, size, dtype=np.uint64).astype("<u4")
        held = TokenFile(encode_file([7, None], np.array([0, size // 2, size]), ids))
        places = rng.integers(0, size, 300)
        assert np.array_equal(held.scan(), ids)
        assert np.array_equal(held.take(places), ids[places])
        assert np.array_equal(held.document(1), ids[size // 2 :])
