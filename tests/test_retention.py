"""The purge plan against a plain walk."""

import random

from proofline.operators import retention as R


def test_plan_equals_a_plain_walk(spark):
    draw = random.Random(3)
    kinds = [*R.KEPT_DAYS, "report", "evidence", None]
    assets = [(k, draw.choice(kinds), draw.choice([1, 1, 2, 3, None]), draw.choice([None, draw.randrange(400)]), draw.choice([None, None, None, draw.randrange(800)]), draw.choice([None, False, False, False, draw.random() < 0.3])) for k in range(400)]
    links = [(draw.choice([5, draw.randrange(400)]), draw.randrange(410)) for _ in range(500)] + [(0, 1), (1, 2), (2, 0), (None, 3), (4, None)]
    holds = [(2, 100, 500), (3, 100, 400), (None, 0, None), (9, 500, None)]
    now, reason = 400, {}
    held = {k for k, _, o, *_ in assets if o == 2}
    for k, kind, _, created, expires, deleted in assets:
        if deleted:
            reason[k] = ("deleted", 0)
        elif expires is not None and expires <= now:
            reason[k] = ("expired", 0)
        elif created is not None and kind in R.KEPT_DAYS and created + R.KEPT_DAYS[kind] <= now:
            reason[k] = ("aged", 0)
    edge, depth = set(reason), 0
    while edge:
        depth += 1
        edge = {c for p, c in links if p in edge - held and c is not None and c < 400 and c not in reason}
        reason |= {c: ("cascade", depth) for c in edge}
    want = {k: ("held" if k in held else "tombstone" if assets[k][1] in R.TOMBSTONES else "purge", *reason[k]) for k in reason}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    shape = "asset_id long, kind string, owner_id long, created_at long, expires_at long, deleted boolean"
    args = frame(links + links[:20], "parent_id long, child_id long"), frame(holds, "owner_id long, since long, until long"), now
    found = R.purge_plan(frame(assets, shape), *args).collect()
    assert len(found) == len(want) and {r["asset_id"]: (r["action"], r["reason"], r["depth"]) for r in found} == want
    assert max(r["depth"] for r in found) >= 3
    assert R.purge_plan(frame([], shape), *args).collect() == []


def test_rounds_write_only_what_is_open(spark, monkeypatch):
    from proofline.operators import retention

    written, write = {}, retention.Steps.write

    def noted(self, df, name):
        out = write(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(retention.Steps, "write", noted)
    n, leaves = 4, 100
    assets = spark.range(n * (leaves + 1)).selectExpr("id asset_id", "'evidence' kind", "id owner_id", "1 created_at", "cast(null as int) expires_at", "id = 0 deleted")
    links = spark.range(n - 1).selectExpr("id parent_id", "id + 1 child_id").unionByName(spark.range(n, n * (leaves + 1)).selectExpr(f"id % {n} parent_id", "id child_id"))
    holds = spark.sql("select 1L owner_id, 0 since, 0 until where false")
    plan = {r["asset_id"]: r["depth"] for r in retention.purge_plan(assets, links, holds, 10).collect()}
    assert plan == {k: k if k < n else k % n + 1 for k in range(n * (leaves + 1))}
    assert sum(rows for name, rows in written.items() if name not in ("assets", "links")) < leaves
