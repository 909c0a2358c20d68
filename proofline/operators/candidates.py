"""Candidate entities for a request: what to ask, what came back, what speaks for each, their order.

Tables, all by request_id: ``requests`` (legal_name, cin, state, root_url);
``disclosures`` (page_no, ord, url, content_hash, controlled, kind, value,
context) found on the request's site; ``answers`` (query_no, by_name, pos, cin)
of the company register; ``records`` of that register by cin (legal_name,
former_names, company_type, status, active, listed, state, summary);
``signals`` and ``hints`` of other sources. A request has at most some twenty
candidates, so arrays by request stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import identifiers as I
from proofline.functions.text import folded, legal_name_key, uuid5
from proofline.functions.web import root_host
from proofline.operators.scoring import WEIGHTS, score
from proofline.operators.steps import Steps

# Fixed values.
CANDIDATES_NAMESPACE = "7c20b8e4-290f-5f26-848d-b49a73fe791d"
EVIDENCE_NAMESPACE = "c3529550-3ee8-5bc4-966d-4346ded3fa37"
STOP_WORDS = ["address", "building", "floor", "india", "limited", "no", "number", "office", "plot", "registered", "road", "street"]
STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "delhi", "goa", "gujarat", "haryana", "himachal pradesh", "jammu and kashmir", "jharkhand", "karnataka", "kerala", "ladakh",
    "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "puducherry", "punjab", "rajasthan", "tamil nadu", "telangana", "uttar pradesh", "uttarakhand", "west bengal",
]
SIGNAL_FACTORS = {
    "official_domain_link": "official_regulator_exchange_links_domain",
    "director_promoter_business_match": "directors_promoters_business_match",
    "credible_corroboration": "credible_corroboration",
    "conflicting_registered_office": "conflicting_registered_office",
    "incompatible_business": "incompatible_business_description",
    "common_name_adverse_ambiguity": "common_name_adverse_ambiguity",
}
CONFLICTS = {
    "inactive_status": "Company status appears inactive; confirm any successor or former name.",
    "conflicting_registered_office": "The registered-office evidence conflicts with the master-data record.",
    "incompatible_business_description": "The public business description appears incompatible with this candidate.",
    "name_only_match": "This candidate is linked by name only; add a CIN or stronger evidence.",
    "common_name_adverse_ambiguity": "A common company name creates unresolved adverse-result ambiguity.",
}
CIN_RULE = "^[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"


def clean_name(name: Column) -> Column:
    """Single spaces; null if nothing or more than 300 characters are left."""
    name = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    return F.when(F.length(name).between(1, 300), name)


def clean_cin(cin: Column) -> Column:
    cin = F.upper(F.trim(cin))
    return F.when(cin.rlike(CIN_RULE), cin)


def state_key(state: Column) -> Column:
    key = folded(state)
    return F.when(F.length(key).between(1, 100), key)


def identities(requests: DataFrame, disclosures: DataFrame, kind: str, most: int = 10) -> DataFrame:
    """(request_id, place, value): names (``legal_name``) or numbers (``cin``) to ask for.

    The supplied one comes first, then the site's in page order; those that
    aren't valid are passed over, repeats by key too.
    """
    clean, key = (clean_name, legal_name_key) if kind == "legal_name" else (clean_cin, F.lower)
    own = requests.select("request_id", F.lit(-1).alias("page_no"), F.lit(0).alias("ord"), F.col(kind).alias("value"))
    seen = disclosures.filter(F.col("kind") == kind).select("request_id", "page_no", "ord", "value")
    named = own.unionByName(seen).withColumn("value", clean(F.col("value"))).filter("value is not null").withColumn("_key", key(F.col("value")))
    first = Window.partitionBy("request_id", "_key").orderBy("page_no", "ord", "value")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("page_no", "ord", "value"))
    named = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("place", place)
    return named.filter(F.col("place") <= most).select("request_id", "place", "value")


def ingested(answers: DataFrame, most: int = 20, per_query: int = 10) -> DataFrame:
    """(request_id, cin, place, query_no, by_name): what each query adds, until a request has ``most`` candidates.

    A search asks for no more than are still missing, but for one at least; so
    what it brings depends on what came before. The queries of a request, few
    and short, are walked in order as arrays.
    """
    asked = answers.groupBy("request_id", "query_no", "by_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cin"))), lambda s: s["cin"]).alias("cins"))
    asked = asked.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("query_no", "by_name", "cins"))).alias("queries"))
    used_type = "array<struct<query_no:bigint,by_name:boolean,cins:array<string>>>"

    def step(acc: Column, q: Column) -> Column:
        left = F.lit(most) - F.size(acc["held"])
        part = F.when(q["by_name"], F.slice(q["cins"], F.lit(1), F.least(F.lit(per_query), F.greatest(F.lit(1), left)))).otherwise(q["cins"])
        held = F.slice(F.array_distinct(F.concat(acc["held"], part)), 1, most)
        used = F.concat(acc["used"], F.array(F.struct(q["query_no"].cast("bigint").alias("query_no"), q["by_name"].alias("by_name"), part.alias("cins"))))
        return F.when(left <= 0, acc).otherwise(F.struct(held.alias("held"), used.alias("used")))

    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast(used_type).alias("used"))
    walked = asked.select("request_id", F.aggregate("queries", start, step).alias("w"))
    rows = walked.select("request_id", F.col("w.held").alias("_held"), F.explode("w.used").alias("u")).select("request_id", "_held", "u.query_no", "u.by_name", F.explode("u.cins").alias("cin"))
    place = F.array_position("_held", F.col("cin"))
    return rows.withColumn("place", place).filter("place > 0").drop("_held")


def handles(found: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, cin, kind, key, present): by what each candidate of a request can be named.

    Kinds: name (keys of present and former names) and cin. ``records`` is one a
    cin, or, where it has a request_id, one for each candidate of each request:
    what a request was told of a company doesn't speak in another request.
    """
    held = records if "request_id" in records.columns else found.select("request_id", "cin").distinct().join(records, "cin")
    way = lambda kind, key, present: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(present).alias("present"))
    former = F.transform(F.coalesce("former_names", F.array().cast("array<string>")), lambda n: way("name", legal_name_key(n), False))
    every = F.concat(F.array(way("name", legal_name_key(F.col("legal_name")), True), way("cin", F.col("cin"), True)), former)
    return held.select("request_id", "cin", F.explode(every).alias("_h")).groupBy("request_id", "cin", F.col("_h.kind").alias("kind"), F.col("_h.key").alias("key")).agg(F.bool_or("_h.present").alias("present"))


def hinted(hints: DataFrame, named: DataFrame, most: int = 20) -> DataFrame:
    """A row for each candidate (request_id, cin) that hints speak of: brand_names, related_reason, code.

    ``named`` comes from ``handles``. A hint (request_id, ord, cin, name, brands, reason) fits a record if its
    number and its name do, as far as it states them. Brands are united without
    case, first spelling kept; two different reasons are an error.
    """
    key = F.coalesce(legal_name_key(F.col("name")), F.col("cin"))
    asked = hints.withColumns({"kind": F.when(F.col("name").isNotNull(), "name").otherwise("cin"), "key": key})
    fits = asked.join(named.select("request_id", F.col("cin").alias("_cin"), "kind", "key"), ["request_id", "kind", "key"]).filter("cin is null or cin = _cin")
    brands = fits.select("request_id", "_cin", "ord", F.posexplode_outer("brands").alias("_pos", "brand"))
    first = Window.partitionBy("request_id", "_cin", F.lower("brand")).orderBy("ord", "_pos")
    brands = brands.filter("brand is not null").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    brands = brands.groupBy("request_id", "_cin").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_pos", "brand"))), lambda s: s["brand"]).alias("brand_names"))
    reasons = fits.groupBy("request_id", "_cin").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("ord"))).alias("related_reason"), F.count_distinct(F.lower("reason")).alias("_reasons"))
    out = reasons.join(brands, ["request_id", "_cin"], "left")
    code = F.when(F.col("_reasons") > 1, "conflicting_entity_relationship_hints")
    kept = F.slice(F.coalesce("brand_names", F.array().cast("array<string>")), 1, most)
    return out.select("request_id", F.col("_cin").alias("cin"), kept.alias("brand_names"), "related_reason", code.alias("code"))


def brand_statement(legal_name: Column, brand_names: Column, brand: Column) -> Column:
    """The sentence that ties a brand to its company; null if the brand isn't the candidate's."""
    canonical = F.try_element_at(F.filter(brand_names, lambda b: F.lower(b) == F.lower(clean_name(brand))), F.lit(1))
    return F.concat(legal_name, F.lit(" operates the "), canonical, F.lit(" business/website."))


def state_conflict(address: Column, state: Column) -> Column:
    """Whether an address names another state than the record's; the longest name found counts. Never null."""
    ordered = sorted(STATES, key=len, reverse=True)
    named = F.try_element_at(F.filter(F.array(*map(F.lit, ordered)), lambda s: F.contains(F.lower(address), s)), F.lit(1))
    return F.coalesce(named != F.lower(state), F.lit(False))


def page_evidence_id(url: Column, content_hash: Column, kind: Column, value: Column, context: Column) -> Column:
    return uuid5(EVIDENCE_NAMESPACE, F.concat_ws("|", F.lit("site"), url, content_hash, kind, value, context))


def provider_url(provider: Column, by_name: Column, urls: dict[str, tuple[str, str]]) -> Column:
    """Where a register's answer comes from, by (search, look-up); null for a register that isn't listed."""
    out = F.lit(None).cast("string")
    for name, (search, lookup) in urls.items():
        out = F.when(provider == name, F.when(by_name, F.lit(search)).otherwise(F.lit(lookup))).otherwise(out)
    return out


def provider_sentence(legal_name: Column, cin: Column, status: Column, state: Column) -> Column:
    part = lambda lead, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c)).otherwise("")
    return F.concat(F.lit("Compatible company-data source returned "), legal_name, F.lit(" ("), cin, F.lit(")"), part(" with status ", status), part(" and registered-office state ", state), F.lit("."))


def provider_evidence_id(provider: Column, by_name: Column, cin: Column, sentence: Column) -> Column:
    operation = F.when(by_name, "search_by_name").otherwise("lookup_by_cin")
    return uuid5(EVIDENCE_NAMESPACE, F.concat_ws("|", F.lit("provider"), provider, operation, cin, sentence))


def site_facts(named: DataFrame, records: DataFrame, disclosures: DataFrame) -> DataFrame:
    """(request_id, cin, fact, evidence_id) of what a company's own site says of each candidate.

    ``named`` comes from ``handles``; ``records`` are (request_id, cin, state, summary).
    Facts: name (present), legal_page (present or former name), cin,
    address_match, address_conflict. Names and numbers meet by equi joins;
    addresses are held against the request's own candidates only.
    """
    said = disclosures.filter("controlled").withColumn("evidence_id", page_evidence_id(F.col("url"), F.col("content_hash"), F.col("kind"), F.col("value"), F.col("context")))
    kind = F.when(F.col("kind") == "legal_name", "name").when(F.col("kind") == "cin", "cin")
    key = F.when(F.col("kind") == "cin", F.upper("value")).otherwise(legal_name_key(F.col("value")))
    asked = said.select("request_id", "evidence_id", kind.alias("kind"), key.alias("key")).filter("kind is not null")
    facts = F.when(F.col("kind") == "cin", F.array(F.lit("cin"))).when(F.col("present"), F.array(F.lit("name"), F.lit("legal_page"))).otherwise(F.array(F.lit("legal_page")))
    out = asked.join(named, ["request_id", "kind", "key"]).select("request_id", "cin", F.explode(facts).alias("fact"), "evidence_id")
    offices = said.filter("kind = 'registered_office'").select("request_id", "value", "evidence_id").join(records.select("request_id", "cin", "state", "summary"), "request_id")
    match = I.addresses_match(F.col("value"), F.col("summary"), F.col("state"), STOP_WORDS)
    fact = F.when(match, "address_match").when(state_conflict(F.col("value"), F.col("state")), "address_conflict")
    out = out.unionByName(offices.select("request_id", "cin", fact.alias("fact"), "evidence_id").filter("fact is not null"))
    return out.distinct()


def signal_facts(named: DataFrame, signals: DataFrame) -> DataFrame:
    """(request_id, cin, fact, evidence_id): each signal's factor for the candidates that it names, by number or else by name."""
    factor = F.create_map(*[F.lit(x) for pair in SIGNAL_FACTORS.items() for x in pair])[F.col("kind")]
    kind = F.when(F.col("cin").isNotNull(), "cin").otherwise("name")
    given = signals.select("request_id", factor.alias("fact"), "evidence_id", kind.alias("kind"), F.coalesce("cin", legal_name_key(F.col("name"))).alias("key"))
    return given.join(named, ["request_id", "kind", "key"]).select("request_id", "cin", "fact", "evidence_id").distinct()


def provider_facts(found: DataFrame, records: DataFrame, provider: str) -> DataFrame:
    """(request_id, cin, fact, evidence_id): one for each different answer of the register."""
    rows = found.join(records, ["cin", "query_no"] if "query_no" in records.columns else ["cin"])
    sentence = provider_sentence(F.col("legal_name"), F.col("cin"), F.col("status"), F.col("state"))
    return rows.select("request_id", "cin", F.lit("provider").alias("fact"), provider_evidence_id(F.lit(provider), F.col("by_name"), F.col("cin"), sentence).alias("evidence_id")).distinct()


def conflict_messages() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in CONFLICTS.items()]))


def merged_records(found: DataFrame, records: DataFrame) -> DataFrame:
    """One record for each (request_id, cin) from its answers in order.

    ``records`` may differ by query (column query_no) or be one a cin. The first
    one's names stand; other fields are the first that is there, an empty text
    counting as none; former names are united in order.
    """
    keys = ["cin", "query_no"] if "query_no" in records.columns else ["cin"]
    rows = found.join(records, keys)
    text = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("query_no"))).alias(c)
    flag = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("query_no"))).alias(c)
    names = F.transform(F.array_sort(F.collect_list(F.struct("query_no", "former_names"))), lambda s: F.coalesce(s["former_names"], F.array().cast("array<string>")))
    return rows.groupBy("request_id", "cin").agg(
        F.min("place").alias("place"), F.bool_or("by_name").alias("by_name"), F.bool_or(~F.col("by_name")).alias("by_cin"), F.min_by("legal_name", "query_no").alias("legal_name"),
        F.array_distinct(F.flatten(names)).alias("former_names"), *map(text, ("company_type", "status", "state", "summary")), *map(flag, ("active", "listed")),
    )


def generate(requests: DataFrame, disclosures: DataFrame, answers: DataFrame, records: DataFrame, signals: DataFrame, hints: DataFrame, most: int = 20, provider: str = "fixture") -> DataFrame:
    """The ranked candidates of every request.

    request_id, cin, legal_name, former_names, company_class, listed, domain,
    facts (one boolean each), positive_total, negative_total, score, label,
    conflicts, brand_names, related_reason, evidence (ids by factor), code, rank. A
    request without candidates has no row: it needs a name or a number. Answers, merged
    records and names are written once, as each is read several times.
    """
    steps = Steps(requests.sparkSession, "candidates")
    found = steps.write(ingested(answers, most), "found")
    merged = merged_records(found, records)
    wanted = requests.select("request_id", state_key(F.col("state")).alias("_wanted"), F.col("root_url"))
    merged = merged.join(wanted, "request_id").filter(F.col("_wanted").isNull() | (state_key(F.col("state")) == F.col("_wanted")))
    merged = steps.write(merged, "merged")
    named = steps.write(handles(merged, merged), "handles")
    said = site_facts(named, merged, disclosures)
    told = signal_facts(named, signals)
    facts = said.unionByName(told).unionByName(provider_facts(found, records, provider)).groupBy("request_id", "cin").agg(F.collect_set("fact").alias("_facts"), F.collect_set(F.struct("fact", "evidence_id")).alias("_ids"))
    df = merged.join(facts, ["request_id", "cin"], "left").join(hinted(hints, named), ["request_id", "cin"], "left")
    has = lambda f: F.coalesce(F.array_contains("_facts", f), F.lit(False))
    exact = has("name") & has("cin")
    signalled = {f: has(f) for f in SIGNAL_FACTORS.values()}
    linked = exact | has("address_match") | signalled["official_regulator_exchange_links_domain"] | signalled["directors_promoters_business_match"] | signalled["credible_corroboration"]
    df = df.withColumns(signalled | {
        "exact_legal_name_and_cin_on_domain": exact,
        "address_contact_matches_master_data": has("address_match"),
        "company_controlled_legal_page": has("legal_page"),
        "inactive_status": F.coalesce(~F.col("active"), F.lit(False)) | I.inactive(F.col("status")),
        "conflicting_registered_office": signalled["conflicting_registered_office"] | has("address_conflict"),
        "name_only_match": F.col("by_name") & ~F.col("by_cin") & ~linked,
    })
    df = score(df)
    kind = I.company_class(F.col("cin"), F.col("company_type"), F.col("listed"))
    code = F.coalesce("code", F.when(kind.isNull(), "candidate_company_type_unsupported"))
    on_site = has("name") | has("legal_page") | has("cin") | has("address_match") | has("address_conflict")
    empty = F.array().cast("array<string>")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), F.lower("legal_name"), "cin"))
    return df.select(
        "request_id", "cin", "legal_name", "former_names", kind.alias("company_class"), (kind == "listed").alias("listed"), F.when(on_site, root_host(F.col("root_url"))).alias("domain"), *WEIGHTS,
        "positive_total", "negative_total", "score", "label", conflict_messages().alias("conflicts"), F.coalesce("brand_names", empty).alias("brand_names"), "related_reason", "state",
        factor_evidence().alias("evidence"), code.alias("code"), rank.alias("rank"),
    )


def factor_evidence(most: int = 20) -> Column:
    """factor -> sorted evidence ids, for factors that apply, from pairs of fact and evidence id."""
    of = lambda *facts: F.slice(F.array_sort(F.array_distinct(F.transform(F.filter("_ids", lambda p: p["fact"].isin(*facts)), lambda p: p["evidence_id"]))), 1, most)
    parts = {f: (f,) for f in SIGNAL_FACTORS.values()} | {
        "exact_legal_name_and_cin_on_domain": ("name", "cin"), "address_contact_matches_master_data": ("address_match", "provider"), "company_controlled_legal_page": ("legal_page",),
        "conflicting_registered_office": ("address_conflict", "conflicting_registered_office", "provider"), "inactive_status": ("provider",), "name_only_match": ("provider",),
    }
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.when(F.col(f), of(*names)).alias("value")) for f, names in parts.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def candidate_id(request_id: Column, cin: Column, legal_name: Column, state: Column) -> Column:
    return uuid5(CANDIDATES_NAMESPACE, F.concat_ws("|", request_id, cin, legal_name_key(legal_name), F.coalesce(state, F.lit(""))))
