"""What model calls cost and how they end, from recorded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rupees for a thousand tokens in and out, by tier.
PRICES = {"low": ("0.10", "0.20"), "mid": ("0.50", "1.00"), "frontier": ("2.00", "4.00")}
CAPACITY = "no endpoints found matching your data policy"

c = F.col


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Exact decimal cost; prices are for a thousand tokens."""
    part = lambda n, price: n.cast("decimal(15,0)") * price.cast("decimal(10,4)") * F.lit("0.001").cast("decimal(4,3)")
    return (part(tokens_in, price_in) + part(tokens_out, price_out)).cast("decimal(28,7)")


def routed(tasks: DataFrame, tiers: DataFrame, routes: DataFrame) -> DataFrame:
    """Tasks (task, more) with tier and its route; code where the task, or its tier's route, is unknown."""
    df = tasks.join(tiers.select("task", "tier"), "task", "left").join(routes, "tier", "left")
    return df.withColumn("code", F.when(c("tier").isNull(), "model_task_unrouted").when(c("model").isNull(), "model_route_missing"))


def missing_tiers(routes: DataFrame, wanted: tuple[str, ...] = tuple(PRICES)) -> DataFrame:
    """(config, tier) for tiers that a config's routes lack."""
    have = routes.groupBy("config").agg(F.collect_set("tier").alias("_t"))
    return have.select("config", F.explode(F.array_except(F.array(*map(F.lit, wanted)), "_t")).alias("tier"))


def most_output(budget: Column, override: Column) -> Column:
    return F.least(budget, override)


def breached(projected: Column, remaining: Column, per_call: Column) -> Column:
    return (remaining <= 0) | (projected > per_call) | (projected > remaining)


def actually_breached(spent: Column, remaining: Column, per_call: Column) -> Column:
    return (spent > per_call) | (spent > remaining)


def no_capacity(body: Column) -> Column:
    """Whether an answer's message, at the top or within its error, says that no endpoint fits. Never null."""
    of = lambda path: F.coalesce(F.lower(F.get_json_object(body, path)), F.lit(""))
    error = of("$.error")
    said = of("$.message").contains(CAPACITY) | of("$.error.message").contains(CAPACITY)
    return said | (~error.startswith("{") & ~error.startswith("[") & error.contains(CAPACITY))


def http_failure(status: Column, media_type: Column, kind: str, body: Column | None = None) -> Column:
    """struct(code, retryable) of a provider's answer, null for a good one. Kinds: model, search, company_data."""
    answer = lambda code, again: F.struct(F.lit(code if code == "no_approved_capacity" else f"{kind}_{code}").alias("code"), F.lit(again).alias("retryable"))
    good = F.lower(F.trim(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1)))) == "application/json"
    full = (status == 404) | (F.lit(False) if body is None else no_capacity(body)) if kind == "model" else F.lit(False)
    return (
        F.when(full, answer("no_approved_capacity", True))
        .when((status == 200) & ~good, answer("response_invalid", False))
        .when(status == 200, F.lit(None))
        .when(status == 400, answer("invalid_request", False))
        .when(status.isin(401, 403), answer("unauthorized", False))
        .when(status == 429, answer("rate_limited", True))
        .when(status.between(500, 599), answer("unavailable", True))
        .otherwise(answer("http_error", False))
    )


def validation_summary(errors: Column, most: int = 10, length: int = 600) -> Column:
    """``place:type;...`` of validation errors (struct loc array, type), the first few."""
    part = lambda e: F.concat_ws(":", F.when(F.size(e["loc"]) > 0, F.array_join(e["loc"], ".")).otherwise("root"), F.coalesce(e["type"], F.lit("invalid")))
    joined = F.array_join(F.transform(F.slice(errors, 1, most), part), ";")
    return F.substring(F.when(joined == "", "schema_invalid").otherwise(joined), 1, length)


def calls(rows: DataFrame) -> DataFrame:
    """``rows`` with result, error, tokens and cost of each call.

    A row has the estimate (est_in, max_out), prices (price_in, price_out), the
    budget (remaining, per_call), the first attempt (ok_1, in_1, out_1, fail_1)
    and the repair (est_in_2, ok_2, in_2, out_2, fail_2); fail is a transport
    error's code. A call is refused if its worst case breaks the budget, so is a
    repair; a good answer that broke it is an error all the same.
    """
    price = lambda a, b: cost(a, b, c("price_in"), c("price_out"))
    first, second = price(c("in_1"), c("out_1")), price(c("in_2"), c("out_2"))
    refused = breached(price(c("est_in"), c("max_out")), c("remaining"), c("per_call"))
    over = lambda spent: actually_breached(spent, c("remaining"), c("per_call"))
    again_refused = breached(first + price(c("est_in_2"), c("max_out")), c("remaining"), c("per_call"))
    case = (
        F.when(refused, "refused")
        .when(c("fail_1").isNotNull(), "failed_1")
        .when(c("ok_1"), F.when(over(first), "over_1").otherwise("ok"))
        .when(again_refused, "again_refused")
        .when(c("fail_2").isNotNull(), "failed_2")
        .when(over(first + second), "over_2")
        .when(c("ok_2"), "schema_retry_ok")
        .otherwise("invalid")
    )
    df = rows.withColumn("_case", case)
    spent_1, spent_2 = c("_case").isin("ok", "over_1", "again_refused"), c("_case").isin("over_2", "schema_retry_ok", "invalid")
    total = lambda one, two, zero: F.when(spent_1, one).when(spent_2, one + two).otherwise(zero)
    error = (
        F.when(c("_case").isin("refused", "over_1", "over_2", "again_refused"), "model_cost_cap_exceeded")
        .when(c("_case") == "failed_1", c("fail_1")).when(c("_case") == "failed_2", c("fail_2")).when(c("_case") == "invalid", "model_schema_invalid_after_repair")
    )
    zero = F.lit(0).cast("decimal(28,7)")
    return df.withColumns({
        "result": F.when(c("_case").isin("refused", "ok", "schema_retry_ok"), c("_case")).otherwise("error"), "error": error, "tokens_in": total(c("in_1"), c("in_2"), F.lit(0)),
        "tokens_out": total(c("out_1"), c("out_2"), F.lit(0)), "cost_inr": total(first, second, zero).cast("decimal(28,7)"),
    }).drop("_case")


def cost_by_job(runs: DataFrame) -> DataFrame:
    """job_id, calls, refused, tokens_in, tokens_out, cost_total_inr."""
    return runs.groupBy("job_id").agg(
        F.count("*").alias("calls"), F.count_if(c("result") == "refused").alias("refused"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_inr").alias("cost_total_inr")
    )


def first_success(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """What a bounded retry of recorded attempts (ord, ok, retryable, code) comes to: calls made, ok, code.

    Attempts go on after a retryable failure only, ``most`` in all.
    """
    stop = F.min(F.when(c("ok") | ~c("retryable") | (c("ord") >= most), c("ord"))).alias("_stop")
    ends = attempts.groupBy(key).agg(F.coalesce(stop, F.max("ord")).alias("calls"))
    last = attempts.join(ends, key).filter(c("ord") == c("calls"))
    return last.select(key, "calls", "ok", F.when(~c("ok"), c("code")).alias("code"))
