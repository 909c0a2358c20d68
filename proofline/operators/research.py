"""Research stages of jobs over recorded searches, pages and model runs: what each stage admits under the budget that earlier ones left.

Tables: ``jobs`` (job_id); ``results`` (job_id, stage, place, url) of each stage's search, in
rank order; ``pages`` (url, readable, tier), where an unread page or one without a tier can't be admitted; ``runs`` (job_id, stage,
input_tokens, output_tokens, cost_inr) of the models. The stages are folded in their order, all jobs at
once: a stage is one step, which joins the results that the job can still pay with their pages, and hands the totals on. A job ends at its first
refusal. A step's rows are written, so a fold can go on from any stage (``done``).

A stage books a search, then a page for each result up to its plan, its own share and what is left of the job's, whether
the page can be read or not; then a model call, tokens and cost. Codes, in this order: budget_searches_exhausted,
budget_stage_searches_exhausted, research_no_admitted_evidence, research_model_evidence_tier_unsupported (evidence of tier 4
at most is needed), then those of model calls, input tokens, output tokens and cost, the job's limit before the stage's.

Defined results: a job without results at a stage ends there without evidence; of results that repeat a place the
least URL counts first; a URL without a page can't be read; of pages or runs that repeat a key the least counts; a stage without a run books no tokens; an empty table of jobs gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators.sequential import CODES, JOB_CAPS, STAGE_CAPS, STAGE_SEARCHES_PAGES
from proofline.operators.steps import Steps

BOOKED = ("searches", "pages", "model_calls", "input_tokens", "output_tokens", "cost_inr")
WEAKEST = 4
_STATE = ("job_id", "stage", *(f"{b}_used" for b in BOOKED), "fetched", "admitted", "cited", "code")


def _caps(stage: str) -> dict:
    searches, pages = STAGE_SEARCHES_PAGES[stage]
    return {"searches": searches, "pages": pages, **STAGE_CAPS}


def stage_evidence(results: DataFrame, pages: DataFrame, left: DataFrame, most: int) -> DataFrame:
    """job_id, place, url, readable, tier of the results that a job fetches: the first ones, as many as ``left`` (job_id, allowed) has; never over ``most``."""
    ranked = results.withColumn("_n", F.expr("row_number() over (partition by job_id order by place, url)")).filter(F.col("_n") <= most)
    read = pages.groupBy("url").agg(F.min(F.struct("readable", "tier")).alias("_p")).select("url", "_p.readable", "_p.tier")
    taken = ranked.join(left, "job_id").filter(F.col("_n") <= F.col("allowed"))
    return taken.join(read, "url", "left").select("job_id", F.col("_n").alias("place"), "url", F.coalesce("readable", F.lit(False)).alias("readable"), "tier")


def research(
    jobs: DataFrame, results: DataFrame, pages: DataFrame, runs: DataFrame, plan: dict[str, int] | None = None, job_caps: dict | None = None, stage_caps: dict[str, dict] | None = None, done: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows for each job and stage that it came to, with the job's totals and the code that ended it (null: it went on), and the evidence of all stages.

    ``plan``: pages to fetch a stage, in order of the stages. ``done``: such rows of earlier stages, from which the fold goes on.
    """
    spark, steps = jobs.sparkSession, Steps(jobs.sparkSession, "research")
    plan = {s: p for s, (_, p) in STAGE_SEARCHES_PAGES.items()} if plan is None else plan
    job_caps = ({k: v for k, v in JOB_CAPS.items()} | {"model_calls": len(STAGE_SEARCHES_PAGES)}) if job_caps is None else job_caps
    run = runs.groupBy("job_id", "stage").agg(F.min(F.struct("input_tokens", "output_tokens", "cost_inr")).alias("_r")).select("job_id", "stage", "_r.*")
    zero = {f"{b}_used": F.lit(0).cast("double") for b in BOOKED}
    start = jobs.select("job_id").distinct().select("job_id", F.lit(None).cast("string").alias("stage"), *[v.alias(k) for k, v in zero.items()], *[F.lit(0).cast("long").alias(c) for c in ("fetched", "admitted", "cited")], F.lit(None).cast("string").alias("code"))
    state, rows, evidence, passed = start, [], [], ()
    if done is not None:
        order = F.create_map(*[x for k, s in enumerate(plan) for x in (F.lit(s), F.lit(k))])
        last = done.withColumn("_at", order[F.col("stage")]).groupBy("job_id").agg(F.max_by(F.struct(*_STATE), "_at").alias("_s")).select("_s.*")
        state = start.join(last.select("job_id"), "job_id", "left_anti").unionByName(last)
        passed = tuple(r[0] for r in done.select("stage").distinct().collect())  # at most the number of stages
    state = steps.write(state, "start")
    for stage, most in plan.items():
        if stage in passed:
            continue
        own = _caps(stage) if stage_caps is None else stage_caps[stage]
        going = state.filter("code is null")
        total = lambda b, more: F.col(f"{b}_used") + more
        over = lambda b, more: F.when(total(b, more) > job_caps[b], CODES[b]).when(more > own[b], "budget_stage_cost_exhausted" if b == "cost_inr" else f"budget_stage_{b}_exhausted")  # noqa: B023, E731
        one = F.lit(1.0)
        searched = going.withColumn("_code", over("searches", one))
        allowed = F.when(F.col("_code").isNull(), F.greatest(F.lit(0), F.least(F.lit(most), F.lit(own["pages"]), F.lit(job_caps["pages"]) - F.col("pages_used")))).otherwise(0)
        found = stage_evidence(results.filter(F.col("stage") == stage), pages, searched.select("job_id", allowed.cast("int").alias("allowed")), min(most, own["pages"]))
        found = steps.write(found.withColumns({"stage": F.lit(stage), "admitted": F.col("readable") & F.col("tier").isNotNull()}), f"evidence-{stage}")
        sums = found.groupBy("job_id").agg(F.count("*").alias("_fetched"), F.count_if("admitted").alias("_admitted"), F.count_if(F.col("admitted") & (F.col("tier") <= WEAKEST)).alias("_cited"))
        df = searched.join(sums, "job_id", "left").join(run.filter(F.col("stage") == stage).drop("stage"), "job_id", "left").fillna(0, ["_fetched", "_admitted", "_cited", "input_tokens", "output_tokens", "cost_inr"])
        tokens = F.coalesce(over("input_tokens", F.col("input_tokens")), over("output_tokens", F.col("output_tokens")))
        called, spent = over("model_calls", one), over("cost_inr", F.col("cost_inr"))
        before = F.col("_code").isNull()
        weak = F.when(F.col("_admitted") == 0, "research_no_admitted_evidence").when(F.col("_cited") == 0, "research_model_evidence_tier_unsupported")
        asked = before & weak.isNull()
        ran = asked & called.isNull()
        told = ran & tokens.isNull()
        add = lambda b, when, more: F.when(when, total(b, more)).otherwise(F.col(f"{b}_used")).alias(f"{b}_used")
        after = df.select(
            "job_id", F.lit(stage).alias("stage"), add("searches", before, one), add("pages", before, F.col("_fetched").cast("double")), add("model_calls", ran, one), add("input_tokens", told, F.col("input_tokens").cast("double")),
            add("output_tokens", told, F.col("output_tokens").cast("double")), add("cost_inr", told & spent.isNull(), F.col("cost_inr").cast("double")), F.col("_fetched").alias("fetched"), F.col("_admitted").alias("admitted"), F.col("_cited").alias("cited"),
            F.coalesce("_code", weak, called, tokens, spent).alias("code"),
        )
        state = steps.write(after, f"stage-{stage}")
        rows.append(state)
        evidence.append(found)
    kinds = found.schema if evidence else "job_id long, place int, url string, readable boolean, tier int, stage string, admitted boolean"
    out, kept = (done.select(*_STATE) if done is not None else spark.createDataFrame([], start.schema)), spark.createDataFrame([], kinds)
    for part in rows:
        out = out.unionByName(part)
    for part in evidence:
        kept = kept.unionByName(part)
    return out, kept


