import random

from proofline.llm.components import connected_components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def found(spark, edges, parts=3, labels=None):
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    rows = connected_components(df, labels).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["component"] for r in rows}


def test_long_path(spark):
    path = [0, *range(202, 101, -1), 1]
    edges = list(zip(path, path[1:]))
    assert found(spark, edges) == brute(edges)


def test_random_ids_on_a_path_and_in_a_graph(spark):
    draw = random.Random(5)
    ids = draw.sample(range(-(10**12), 10**12), 10_000)
    edges = list(zip(ids[:6000], ids[1:6000])) + [tuple(draw.sample(ids[6000:], 2)) for _ in range(2500)] + [(ids[0], x) for x in ids[9000:9500]]
    draw.shuffle(edges)
    assert found(spark, edges, 7) == brute(edges)


def test_odd_edges(spark):
    edges = [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (4, 5), (7, 5)]
    assert found(spark, edges) == {4: 4, 5: 4, 7: 4}
    assert found(spark, []) == {}
    assert found(spark, [(1, 1)]) == {}


def test_labels_are_joined(spark):
    first = [(1, 2), (3, 4), (5, 6), (8, 9)]
    labels = connected_components(spark.createDataFrame(first, "a long, b long"))
    more = [(2, 4), (6, 0), (20, 21), (9, 9)]
    assert found(spark, more, labels=labels) == brute(first + more)
    assert found(spark, [], labels=labels) == brute(first)


def test_beyond_a_block(spark, monkeypatch):
    """Phases, and joins without broadcast, as for graphs of more than a block."""
    from proofline.llm import components

    monkeypatch.setattr(components, "BLOCK", 40)
    monkeypatch.setattr(components, "MOST_NAMES", 5)
    draw = random.Random(3)
    ids = draw.sample(range(-(10**9), 10**9), 900)
    edges = list(zip(ids[:400], ids[1:400])) + [tuple(draw.sample(ids[400:], 2)) for _ in range(300)] + [(ids[0], x) for x in ids[850:]]
    assert found(spark, edges, 5) == brute(edges)
    labels = connected_components(spark.createDataFrame(edges[:350], "a long, b long"))
    assert found(spark, edges[350:], labels=labels) == brute(edges)
