"""The ledger against plain loops, with a user who holds most entries."""

import random

from proofline.operators import entitlements as E

SHAPE = "entry_id long, user_id long, at long, kind string, credits long, expires_at long, reserve_id long, request_id long, idempotency_key string, passed boolean"


def ledger(seed, n=900):
    draw = random.Random(seed)
    rows, reserves = [], []
    for i in range(n):
        user = draw.choice([1, 1, 1, 2, 3, None])
        kind = draw.choice(["purchase_grant", "purchase_grant", "trial_grant", "reserve", "reserve", "reserve", "consume", "release", "restore", "expiry", "refund_reversal"])
        size = draw.choice([1, 1, 2, 3, 40, None, 0])
        sign = 1 if kind in E.POSITIVE else -1
        ends = None
        if kind in E.ENDINGS:
            if not reserves:
                continue
            ends, user = draw.choice(reserves)
        if kind == "reserve":
            reserves.append((i, user))
        rows.append((i, user, draw.randrange(300), kind, None if size is None else sign * size, draw.choice([None, draw.randrange(600)]) if kind in E.GRANTS else None, ends, draw.randrange(200) if kind == "reserve" else None, draw.choice([None, f"k{draw.randrange(700)}"]), draw.choice([None, True, True, False])))
    return rows


def plain(rows):
    balance, allocated = {}, {}
    first = {}
    for r in sorted(rows):
        if r[3] in E.ENDINGS and r[6] is not None:
            first.setdefault(r[6], r[3])
    for user in {r[1] for r in rows}:
        own, total = [r for r in rows if r[1] == user], 0
        for r in sorted(own, key=lambda r: (r[2], r[0])):
            total += 0 if r[3] == "consume" else (r[4] or 0)
            balance[r[0]] = total
        grants = [[r[0], r[4]] for r in sorted(own, key=lambda r: (r[5] is None, r[5] or 0, r[0])) if r[3] in E.GRANTS and r[4]]
        for r in sorted(own, key=lambda r: (r[2], r[0])):
            if r[3] in E.USES and first.get(r[0], "consume") == "consume":
                left = abs(r[4] or 0)
                while left:
                    while grants and not grants[0][1]:
                        grants.pop(0)
                    takes = min(left, grants[0][1]) if grants else left
                    name = grants[0][0] if grants else None
                    allocated[user, r[0], name] = allocated.get((user, r[0], name), 0) + takes
                    left -= takes
                    if grants:
                        grants[0][1] -= takes
    return balance, allocated


def test_balances_and_lots(spark):
    for seed, block, ranges in ((1, 4096, 4), (2, 7, 9), (3, 1, 2)):
        rows = ledger(seed)
        entries = spark.createDataFrame(rows, SHAPE)
        balance, allocated = plain(rows)
        assert {r["entry_id"]: r["balance"] for r in E.balances(entries, ranges).collect()} == balance
        assert {(r["user_id"], r["use_id"], r["grant_id"]): r["credits"] for r in E.allocations(entries, block, ranges).collect()} == allocated
        negative = {r["entry_id"] for r in E.violations(entries, block, ranges).filter("rule = 'balance_negative'").collect()}
        assert negative == {k for k, v in balance.items() if v < 0}


def test_each_rule(spark):
    rows = [
        (1, 1, 1, "purchase_grant", 2, 10, None, None, "a", None), (2, 1, 2, "reserve", -1, None, None, 7, "b", None), (3, 1, 3, "consume", -1, None, 2, None, None, True), (4, 1, 4, "release", 1, None, 2, None, "a", None),
        (5, 1, 5, "reserve", -1, None, None, 8, None, None), (6, 1, 6, "reserve", -1, None, None, 8, None, None), (7, 1, 7, "consume", -1, None, 99, None, None, None), (8, 2, 1, "trial_grant", 1, 5, None, None, None, None),
        (9, 2, 2, "trial_grant", -1, 5, None, None, None, None), (10, 2, 9, "reserve", -1, None, None, 9, None, None), (11, 3, 1, "reserve", -1, None, None, 10, None, None), (12, 3, 2, "purchase_grant", 5, None, None, None, None, None), (13, 3, 3, "gift", 1, None, None, None, None, None),
    ]
    found = sorted((r["rule"], r["entry_id"]) for r in E.violations(spark.createDataFrame(rows, SHAPE)).collect())
    assert found == [
        ("balance_negative", 10), ("balance_negative", 11), ("consume_without_pass", 7), ("grant_after_use", 11), ("grant_expired", 10), ("idempotency_key_repeated", 4), ("request_reserved_twice", 6),
        ("reserve_ended_twice", 4), ("reserve_unknown", 7), ("sign", 9), ("sign", 13), ("trial_repeated", 9), ("use_not_covered", 6),
    ]
    assert E.violations(spark.createDataFrame([], SHAPE)).collect() == [] and E.allocations(spark.createDataFrame([], SHAPE)).collect() == []
