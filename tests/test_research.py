"""Research stages against a plain loop, resumed from any stage."""

import random

from proofline.operators import research as R

STAGES = tuple(R.STAGE_SEARCHES_PAGES)
PLAN = dict(zip(STAGES, (3, 1, 2, 5, 3, 4)))
JOB = {"searches": 5, "pages": 9, "model_calls": 4, "input_tokens": 300, "output_tokens": 90, "cost_inr": 20}
OWN = {s: {"searches": 1, "pages": 4, "model_calls": 1, "input_tokens": 120, "output_tokens": 40, "cost_inr": 9} for s in STAGES}


def world(seed):
    draw = random.Random(seed)
    jobs = list(range(40))
    results = [(j, s, draw.randrange(6), f"u{draw.randrange(60)}") for j in jobs for s in STAGES for _ in range(draw.choice([1, 2, 4, 8]) if draw.random() < 0.97 else 0)]
    results += [(0, STAGES[0], k, f"u{k % 60}") for k in range(2000)]
    pages = [(f"u{k}", draw.choice([True, True, True, False, None]), draw.choice([1, 2, 3, 4, 4, 5, None])) for k in range(55)]
    runs = [(j, s, draw.choice([10, 60, 130]) if draw.random() < 0.2 else 30, draw.choice([5, 10, 20, 50]) if draw.random() < 0.2 else 6, float(draw.choice([1, 2, 3, 10]))) for j in jobs for s in STAGES if draw.random() < 0.9]
    return jobs, results, pages, runs


def plain(jobs, results, pages, runs):
    known, spent, out, evidence = {}, {}, [], []
    for u, ok, tier in pages:
        known[u] = (bool(ok), tier)
    for j, s, *more in runs:
        spent[j, s] = more
    for j in jobs:
        used = dict.fromkeys(R.BOOKED, 0.0)

        def book(field, amount, own):
            if used[field] + amount > JOB[field]:  # noqa: B023
                return R.CODES[field]
            if amount > own[field]:
                return "budget_stage_cost_exhausted" if field == "cost_inr" else f"budget_stage_{field}_exhausted"
            return None

        for s in STAGES:
            own, code, fetched, admitted, cited = OWN[s], book("searches", 1, OWN[s]), 0, 0, 0
            if code is None:
                used["searches"] += 1
                found = sorted((p, u) for jj, ss, p, u in results if (jj, ss) == (j, s))
                for n, (_, u) in enumerate(found[: min(PLAN[s], own["pages"])]):
                    if used["pages"] + 1 > JOB["pages"]:
                        break
                    used["pages"] += 1
                    fetched += 1
                    ok, tier = known.get(u, (False, None))
                    evidence.append((j, s, n + 1, u, ok and tier is not None))
                    admitted += ok and tier is not None
                    cited += ok and tier is not None and tier <= 4
                code = None if cited else "research_model_evidence_tier_unsupported" if admitted else "research_no_admitted_evidence"
            if code is None:
                code = book("model_calls", 1, own)
                if code is None:
                    used["model_calls"] += 1
                    i, o, x = spent.get((j, s), (0, 0, 0.0))
                    code = book("input_tokens", i, own) or book("output_tokens", o, own)
                    if code is None:
                        used["input_tokens"] += i
                        used["output_tokens"] += o
                        code = book("cost_inr", x, own)
                        used["cost_inr"] += 0 if code else x
            out.append((j, s, *used.values(), fetched, admitted, cited, code))
            if code:
                break
    return out, evidence


def test_stages_equal_a_plain_loop(spark):
    codes = set()
    for seed in (1, 2):
        jobs, results, pages, runs = world(seed)
        args = (
            spark.createDataFrame([(j,) for j in [*jobs, 3]], "job_id long"), spark.createDataFrame(results, "job_id long, stage string, place int, url string"),
            spark.createDataFrame(pages + pages[:9], "url string, readable boolean, tier int"), spark.createDataFrame(runs + runs[:9], "job_id long, stage string, input_tokens long, output_tokens long, cost_inr double"),
        )
        want, seen = plain(jobs, results, pages, runs)
        rows, evidence = R.research(*args, PLAN, JOB, OWN)
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)
        assert sorted((r["job_id"], r["stage"], r["place"], r["url"], r["admitted"]) for r in evidence.collect()) == sorted(seen)
        codes |= {r[-1] for r in want}
        if seed == 1:  # from what two stages have left
            done = rows.filter(rows["stage"].isin(*STAGES[:2]))
            again, _ = R.research(*args, PLAN, JOB, OWN, done=done)
            assert sorted(map(tuple, again.collect()), key=repr) == sorted(want, key=repr)
    assert {None, "research_no_admitted_evidence", "research_model_evidence_tier_unsupported"} <= codes and len(codes) >= 6, codes


def test_no_jobs(spark):
    rows, evidence = R.research(
        spark.createDataFrame([], "job_id long"), spark.createDataFrame([], "job_id long, stage string, place int, url string"), spark.createDataFrame([], "url string, readable boolean, tier int"),
        spark.createDataFrame([], "job_id long, stage string, input_tokens long, output_tokens long, cost_inr double"),
    )
    assert rows.collect() == [] and evidence.collect() == []
