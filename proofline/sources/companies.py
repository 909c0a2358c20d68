"""Company registers: recorded vendor answers, and a register of fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import folded
from proofline.operators.candidates import CIN_RULE

MOST_RESULTS = 20
#: About how many asks, and how many records, of one name are paired at a time.
ASKS, RECORDS = 2_000, 4_000
_ADDRESS = "struct<type:string,active:boolean,fullAddress:string,state:string>"
_SEARCH = f"array<struct<indexId:string,businessName:string,type:string,status:string,active:boolean,incorporatedDate:string,addresses:array<{_ADDRESS}>>>"
_MASTER = f"struct<valid:boolean,reg:string,businessName:string,previousName:string,type:string,status:string,active:boolean,listed:boolean,incorporatedDate:string,addresses:array<{_ADDRESS}>>"

c = F.col


def vendor_date(text: Column) -> Column:
    """A date as day-month-year; null for none and for a bad one (see ``bad_date``)."""
    return F.when(text.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), F.try_to_date(text, "dd-MM-yyyy"))


def bad_date(text: Column) -> Column:
    return text.isNotNull() & vendor_date(text).isNull()


def registered_office(addresses: Column) -> Column:
    """struct(state, summary): of the registered offices the first active one, else the first."""
    registered = F.filter(addresses, lambda a: F.coalesce(F.lower(a["type"]).contains("registered"), F.lit(False)))
    picked = F.coalesce(F.try_element_at(F.filter(registered, lambda a: F.coalesce(a["active"], F.lit(False))), F.lit(1)), F.try_element_at(registered, F.lit(1)))
    return F.struct(picked["state"].alias("state"), F.when(picked["fullAddress"] != "", F.substring(picked["fullAddress"], 1, 500)).alias("summary"))


def limit_code(limit: Column) -> Column:
    return F.when(~F.coalesce(limit.between(1, MOST_RESULTS), F.lit(False)), "company_data_limit_invalid")


def search_answers(answers: DataFrame) -> DataFrame:
    """Recorded answers (answer_id, body, most) of a search as records, a row each; code where the answer isn't valid.

    An answer is valid if it is a list whose first ``most`` items all have an
    identifier, a name and a good date; otherwise it gives one row with a code.
    """
    items = F.slice(F.from_json(c("body"), _SEARCH), F.lit(1), c("most").cast("int"))
    listed = F.coalesce(F.trim("body").startswith("["), F.lit(False)) & F.try_parse_json("body").isNotNull()
    good = lambda r: r["indexId"].rlike(CIN_RULE) & F.length(r["businessName"]).between(1, 300) & ~bad_date(r["incorporatedDate"])
    valid = listed & F.coalesce(F.forall(items, lambda r: F.coalesce(good(r), F.lit(False))), F.lit(False))
    df = answers.select("answer_id", F.when(valid, items).alias("_items"), F.when(~valid, "company_data_response_invalid").alias("code"))
    df = df.select("answer_id", "code", F.posexplode_outer("_items").alias("pos", "r")).filter("code is not null or r is not null")
    office = registered_office(c("r.addresses"))
    return df.select(
        "answer_id", "code", "pos", c("r.indexId").alias("cin"), c("r.businessName").alias("legal_name"), F.array().cast("array<string>").alias("former_names"), c("r.type").alias("company_type"), c("r.status").alias("status"), c("r.active").alias("active"),
        F.lit(None).cast("boolean").alias("listed"), vendor_date(c("r.incorporatedDate")).alias("incorporated"), office["state"].alias("state"), office["summary"].alias("summary"),
    )


def master_answers(answers: DataFrame) -> DataFrame:
    """Recorded answers (answer_id, body, expected_cin) of a look-up: a record, nothing for one the register says it hasn't, or a code.

    A record of another number than the expected one, or without number or
    name, makes the answer invalid.
    """
    r = F.from_json(c("body"), _MASTER)
    df = answers.withColumn("r", r).withColumn("_object", F.coalesce(F.trim("body").startswith("{"), F.lit(False)) & F.try_parse_json("body").isNotNull() & c("r.valid").isNotNull())
    good = (c("r.reg") == c("expected_cin")) & c("r.businessName").isNotNull() & ~bad_date(c("r.incorporatedDate"))
    code = F.when(~c("_object") | (c("r.valid") & ~F.coalesce(good, F.lit(False))), "company_data_response_invalid")
    df = df.withColumn("code", code).filter("code is not null or r.valid")
    office = registered_office(c("r.addresses"))
    kept = lambda v: F.when(c("code").isNull(), v)
    former = F.when(c("r.previousName") != "", F.array("r.previousName")).otherwise(F.array().cast("array<string>"))
    return df.select(
        "answer_id", "code", kept(c("r.reg")).alias("cin"), kept(c("r.businessName")).alias("legal_name"), kept(former).alias("former_names"), kept(c("r.type")).alias("company_type"), kept(c("r.status")).alias("status"), kept(c("r.active")).alias("active"),
        kept(c("r.listed")).alias("listed"), kept(vendor_date(c("r.incorporatedDate"))).alias("incorporated"), kept(office["state"]).alias("state"), kept(office["summary"]).alias("summary"),
    )


def lookup_key(name: Column) -> Column:
    """A name's key for look-ups; null for one that is empty, too long or holds control characters."""
    key = folded(name)
    return F.when(F.length(key).between(1, 300) & ~key.rlike(r"[\x00-\x1f\x7f]"), key)


def search_register(asked: DataFrame, searches: DataFrame, records: DataFrame) -> DataFrame:
    """Records that a register of fixtures has for names (ask_id, name, most), in its order: ask_id, pos, record.

    ``searches``: legal_name, cins (in order). The result has a row for each pair of an ask and a record of its name, so both of a
    frequent name are dealt to blocks of about ``ASKS`` and ``RECORDS``, and a join of two blocks holds no more than its asks. They
    follow each other in the result, record by record: files of it repeat a short run of asks, and stay small.
    """
    asks = asked.withColumn("_key", lookup_key(c("name"))).filter("_key is not null and most > 0")
    named = searches.withColumn("_key", lookup_key(c("legal_name"))).filter("_key is not null")
    sizes = asks.groupBy("_key").agg(F.count("*").alias("_asks"), F.lit(0).cast("long").alias("_records")).unionByName(named.groupBy("_key").agg(F.lit(0).cast("long").alias("_asks"), F.sum(F.size("cins")).alias("_records")))
    frequent = sizes.groupBy("_key").agg(F.ceil(F.sum("_asks") / ASKS).cast("int").alias("_blocks"), F.ceil(F.sum("_records") / RECORDS).cast("int").alias("_parts")).filter("_blocks > 1 and _parts > 0 or _parts > 1 and _blocks > 0")
    blocks, parts, at = F.coalesce("_blocks", F.lit(1)), F.coalesce("_parts", F.lit(1)), ["_key", "_block", "_part"]
    each = lambda number: F.explode(F.sequence(F.lit(0), number - 1))
    dealt = asks.join(frequent, "_key", "left").withColumn("_block", F.pmod(F.xxhash64("ask_id"), blocks).cast("int")).withColumn("_part", each(parts)).select("ask_id", "most", *at)
    held = named.select("_key", F.posexplode("cins").alias("pos", "cin")).join(records, "cin")
    held = held.join(frequent, "_key", "left").withColumn("_part", F.pmod(F.xxhash64("cin", "pos"), parts).cast("int")).withColumn("_block", each(blocks)).drop("_blocks", "_parts")
    # a number of partitions of its own, as few bytes make many rows
    most = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = held.repartition(most, *at).hint("merge").join(dealt.repartition(most, *at), at).filter(c("pos") < c("most"))
    return hits.select("cin", "ask_id", "pos", *[n for n in records.columns if n != "cin"])


def look_up(asked: DataFrame, records: DataFrame) -> DataFrame:
    """(ask_id, cin) with the register's record; nulls where it has none."""
    return asked.join(records, "cin", "left")


def register_errors(searches: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, value) for what makes a register of fixtures unsound."""
    again = records.groupBy("cin").count().filter("count > 1").select(F.lit("cin_not_unique").alias("rule"), c("cin").alias("value"))
    names = searches.groupBy(lookup_key(c("legal_name")).alias("value")).count().filter("count > 1").select(F.lit("search_not_unique").alias("rule"), "value")
    dangling = searches.select(F.explode("cins").alias("cin")).distinct().join(records, "cin", "left_anti").select(F.lit("cin_unknown").alias("rule"), c("cin").alias("value"))
    return again.unionByName(names).unionByName(dangling)
