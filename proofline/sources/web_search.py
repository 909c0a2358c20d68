"""Web search and page fetch from recorded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.identifiers import highlights
from proofline.functions.text import collapsed
from proofline.functions.web import default_port_url

c = F.col
_ANSWER = "struct<results:array<struct<title:string,url:string,id:string,publishedDate:string,author:string,highlights:array<string>>>,costDollars:struct<total:double>>"


def search_query(query: Column, most: int = 500) -> Column:
    """A query with single spaces; null for one that is empty, too long or holds control characters."""
    q = collapsed(query)
    return F.when(F.length(q).between(1, most) & ~q.rlike(r"[\x00-\x1f\x7f]"), q)


def search_payload(query: Column, limit: Column, include: Column, exclude: Column, since: Column, until: Column) -> Column:
    """A search request as JSON; filters that aren't set are left out."""
    some = lambda a: F.when(F.size(a) > 0, a)
    passages = F.struct(F.struct(query.alias("query"), F.lit(2000).alias("maxCharacters")).alias("highlights"))
    return F.to_json(F.struct(
        query.alias("query"), F.lit("auto").alias("type"), limit.alias("numResults"), F.lit(True).alias("moderation"), passages.alias("contents"),
        some(include).alias("includeDomains"), some(exclude).alias("excludeDomains"), since.alias("startPublishedDate"), until.alias("endPublishedDate"),
    ))


def search_results(answers: DataFrame) -> DataFrame:
    """Recorded answers (answer_id, body, most) as results: each URL once, in order, the first ``most``; cost; or a code.

    Results after the last one needed aren't looked at, so they can't make an
    answer invalid.
    """
    parsed = F.from_json(c("body"), _ANSWER)
    sound = F.coalesce(F.get_json_object("body", "$.results").startswith("["), F.lit(False))
    rows = answers.select("answer_id", "most", sound.alias("_sound"), parsed.alias("p")).select("answer_id", "most", "_sound", F.coalesce("p.costDollars.total", F.lit(0.0)).alias("cost"), F.posexplode_outer("p.results").alias("pos", "r"))
    rows = rows.withColumn("url", default_port_url(c("r.url")))
    first = F.row_number().over(Window.partitionBy("answer_id", "url").orderBy("pos"))
    rows = rows.withColumn("_new", (c("url").isNotNull() & (first == 1)).cast("int"))
    before = Window.partitionBy("answer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_had", F.coalesce(F.sum("_new").over(before), F.lit(0))).filter(c("_had") < c("most"))
    bad = ~c("_sound") | (c("r").isNotNull() & (c("url").isNull() | c("r.title").isNull()))
    rows = rows.withColumn("_bad", F.bool_or(bad).over(Window.partitionBy("answer_id")))
    broken = rows.filter("_bad").select("answer_id").distinct().withColumn("code", F.lit("search_response_invalid"))
    good = rows.filter("not _bad and _new = 1").select("answer_id", (c("_had") + 1).cast("int").alias("place"), c("r.title").alias("title"), "url", F.coalesce("r.id", "r.url").alias("source_id"), highlights(c("r.highlights")).alias("highlights"), "cost")
    return good.withColumn("code", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)


def recorded_results(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """Results that a record of exact queries (query, pos, url, title) has for queries (ask_id, query, most)."""
    return asked.withColumn("query", search_query(c("query"))).join(recorded, "query").filter(c("pos") < c("most")).drop("most")


def fetch_outcome(hops: DataFrame, most_redirects: int = 5, most_attempts: int = 2, most_bytes: int = 10 << 20) -> DataFrame:
    """What a recorded fetch (fetch_id, ord, attempt, url, status, target, bytes, code) comes to.

    fetch_id, final_url, chain, attempts, code. Redirects are followed as far
    as they may be; a hop whose URL the policy refused (code) ends the fetch, a
    failed attempt (no status) may be repeated.
    """
    redirect = c("status").isin(301, 302, 303, 307, 308) & c("target").isNotNull()
    last = Window.partitionBy("fetch_id").orderBy("ord")
    rows = hops.withColumn("_redirects", F.sum(redirect.cast("int")).over(last)).withColumn("_tries", F.sum(c("status").isNull().cast("int")).over(last))
    stop = c("code").isNotNull() | (~redirect & c("status").isNotNull()) | (c("_redirects") > most_redirects) | (c("_tries") >= most_attempts)
    rows = rows.withColumn("_end", F.min(F.when(stop, c("ord"))).over(Window.partitionBy("fetch_id"))).filter(c("_end").isNull() | (c("ord") <= c("_end")))
    end = F.max_by(F.struct("url", "status", "bytes", "code", "_redirects", "_tries"), "ord").alias("e")
    per = rows.groupBy("fetch_id").agg(end, F.transform(F.array_sort(F.collect_list(F.when(redirect, F.struct("ord", "target")))), lambda s: s["target"]).alias("chain"), F.count("*").alias("attempts"))
    code = (
        F.when(c("e.code").isNotNull(), c("e.code")).when(c("e._redirects") > most_redirects, "too_many_redirects").when(c("e.status").isNull() & (c("e._tries") >= most_attempts), "fetch_failed")
        .when(c("e.status").isNull() | c("e.status").isin(301, 302, 303, 307, 308), "fetch_incomplete").when(c("e.bytes") > most_bytes, "response_too_large")
    )
    return per.select("fetch_id", F.when(code.isNull(), c("e.url")).alias("final_url"), "chain", "attempts", code.alias("code"))


def fetched_pages(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests (ask_id, url) with the recorded page of that URL; code where there is none."""
    both = asked.join(pages, "url", "left")
    return both.withColumn("code", F.when(c("status").isNull(), "page_fixture_missing"))
