"""Files on a shared path: fixtures with a manifest, test cases, requirement tables, test reports, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
SAFE_PATH = r"^(?!/)(?!.*(?:^|/)\.{1,2}(?:/|$))(?!.*//)[^\\:\x00]+$"
STATUSES = ("Specified", "In progress", "Implemented", "Verified", "Blocked")
REQUIREMENT = "^([A-Z][A-Z0-9]*-[0-9]{2})(?:\\s|$)"
MATRIX_TAG = r"\bAT-([A-Z][A-Z0-9]*-[0-9]{2})\b"
TEST_TAG = r"(?i)(?<![A-Z0-9])AT[-_]([A-Z][A-Z0-9]*)[-_]([0-9]{2})(?![A-Z0-9])"


def safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its folder."""
    return F.coalesce(path.rlike(SAFE_PATH), F.lit(False))


def manifest_errors(manifest: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(rule, value) for a manifest (fixture_id, capability, backend, path) against what must be there (capability, backend)."""
    again = lambda col, rule: manifest.groupBy(col).count().filter("count > 1").select(F.lit(rule).alias("rule"), c(col).alias("value"))
    lacking = capabilities.join(manifest, "capability", "left_anti").select(F.lit("capability_missing").alias("rule"), c("capability").alias("value"))
    extra = manifest.join(capabilities, "capability", "left_anti").select(F.lit("capability_unknown").alias("rule"), c("capability").alias("value"))
    wrong = manifest.alias("m").join(capabilities.alias("w"), "capability").filter("m.backend <> w.backend").select(F.lit("backend_mismatch").alias("rule"), c("capability").alias("value"))
    unsafe = manifest.filter(~safe_path(c("path"))).select(F.lit("path_unsafe").alias("rule"), c("path").alias("value"))
    return again("fixture_id", "id_not_unique").unionByName(again("capability", "capability_not_unique")).unionByName(lacking).unionByName(extra).unionByName(wrong).unionByName(unsafe)


def fixture_payloads(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (fixture_id, path, sha256) with their files' text and a code: missing, other digest, no object."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1].rstrip("/")
    files = files.select(F.regexp_replace("path", f"^[a-z]+:/*(?=/){base.replace('.', '[.]')}/", "").alias("path"), "content")
    text = F.decode("content", "UTF-8")
    both = manifest.join(files, "path", "left").withColumn("payload", text)
    code = F.when(c("content").isNull(), "fixture_missing").when(F.sha2("content", 256) != c("sha256"), "fixture_digest_mismatch").when(~F.coalesce(F.trim("payload").startswith("{") & F.try_parse_json("payload").isNotNull(), F.lit(False)), "fixture_not_an_object")
    return both.withColumn("code", code).withColumn("payload", F.when(code.isNull(), c("payload"))).drop("content")


def case_files(spark: SparkSession, root: str, wanted: list[str], most_bytes: int = 64 * 1024) -> DataFrame:
    """Test cases (case_id, payload, code) of a folder's JSON files: each small, an object, named by its own caseId, and all ``wanted`` there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("case_id"), "length", F.decode("content", "UTF-8").alias("payload"))
    names = spark.createDataFrame([(w,) for w in wanted], "case_id string").withColumn("_wanted", F.lit(True))
    both = names.join(files, "case_id", "full_outer")
    code = (
        F.when(c("payload").isNull(), "case_missing").when(c("_wanted").isNull(), "case_unexpected").when(c("length") > most_bytes, "case_too_large")
        .when(F.try_parse_json("payload").isNull(), "case_not_json").when(~F.coalesce(F.get_json_object("payload", "$.caseId") == c("case_id"), F.lit(False)), "case_id_mismatch")
    )
    return both.select("case_id", F.when(code.isNull(), c("payload")).alias("payload"), code.alias("code"))


def acceptance_tags(label: Column) -> Column:
    """Distinct tags of a test's label, in one spelling."""
    part = lambda k: F.regexp_extract_all(label, F.lit(TEST_TAG), F.lit(k))
    return F.array_distinct(F.zip_with(part(1), part(2), lambda a, b: F.concat(F.lit("AT-"), F.upper(a), F.lit("-"), b)))


def requirements(lines: DataFrame) -> DataFrame:
    """Requirement rows (line_no, requirement_id, summary, acceptance, status, code) of a Markdown table's lines (line_no, value)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\|+", ""), r"\|+$", "")
    cells = F.transform(F.split(bare, r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.col("value").startswith("|")).withColumn("_c", cells).filter(F.size("_c") == 7)
    rows = rows.withColumn("requirement_id", F.regexp_extract(c("_c")[0], REQUIREMENT, 1)).filter("requirement_id <> ''")
    own = F.array_contains(F.regexp_extract_all(c("_c")[4], F.lit(MATRIX_TAG), F.lit(1)), c("requirement_id"))
    known = F.array_contains(F.array(*map(F.lit, STATUSES)), c("_c")[6])
    again = F.row_number().over(_by("requirement_id", "line_no")) > 1
    code = F.when(again, "requirement_duplicate").when(~known, "requirement_status_unknown").when(~own, "requirement_tag_missing")
    return rows.select("line_no", "requirement_id", c("_c")[1].alias("summary"), c("_c")[4].alias("acceptance"), c("_c")[6].alias("status"), code.alias("code"))


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(keys[0]).orderBy(*keys[1:])


def unknown_tags(rows: DataFrame) -> DataFrame:
    """(requirement_id, tag) for tags in acceptance cells that no requirement has."""
    tags = rows.select("requirement_id", F.explode(F.array_distinct(F.regexp_extract_all("acceptance", F.lit(MATRIX_TAG), F.lit(1)))).alias("tag"))
    return tags.join(rows.select(c("requirement_id").alias("tag")).distinct(), "tag", "left_anti").select("requirement_id", "tag")


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases (label, tags, passed) of JUnit XML files."""
    schema = "_classname string, _name string, _file string, failure string, error string, skipped string"
    rows = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(schema).load(path)
    given = lambda n: F.when(c(n) != "", c(n))
    label = F.concat_ws(" :: ", given("_classname"), given("_name"), given("_file"))
    label = F.when(label == "", "unnamed testcase").otherwise(label)
    passed = c("failure").isNull() & c("error").isNull() & c("skipped").isNull()
    return rows.select(label.alias("label"), passed.alias("passed")).withColumn("tags", acceptance_tags(c("label")))


def traceability(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Requirements with the passing tests of their tag, and a code for a verified one that has none."""
    tagged = tests.filter("passed").select("label", F.explode("tags").alias("tag"))
    per = tagged.groupBy("tag").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    both = rows.withColumn("tag", F.concat(F.lit("AT-"), "requirement_id")).join(per, "tag", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return both.select("requirement_id", "status", "tag", "labels", F.when((c("status") == "Verified") & (F.size("labels") == 0), "verified_without_test").alias("code"))


def stray_tags(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """(label, tag) for tests that name a requirement which isn't there."""
    known = rows.select(F.concat(F.lit("AT-"), "requirement_id").alias("tag")).distinct()
    return tests.select("label", F.explode("tags").alias("tag")).join(known, "tag", "left_anti").select("label", "tag")


def report_lines(traced: DataFrame, tests: DataFrame) -> DataFrame:
    """(ord, line): a Markdown report of statuses, verified requirements and passing tags."""
    plain = lambda v: F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    counts = traced.agg(F.count("*").alias("Requirements"), *[F.count_if(c("status") == s).alias(s) for s in STATUSES])
    cases = tests.agg(F.count("*").alias("Test cases"), F.count_if(F.size("tags") > 0).alias("Tagged test cases"))
    lines = lambda df, names, start: df.select(F.posexplode(F.array(*[F.concat(F.lit(f"| {n} | "), c(f"`{n}`"), F.lit(" |")) for n in names])).alias("k", "line")).select(F.concat(F.lit("1-"), F.lpad((c("k") + start).cast("string"), 3, "0")).alias("ord"), "line")
    summary = lines(counts, ["Requirements", *STATUSES], 0).unionByName(lines(cases, ["Test cases", "Tagged test cases"], 1 + len(STATUSES)))
    verified = traced.filter("status = 'Verified'").select(F.concat(F.lit("2-"), "requirement_id").alias("ord"), F.concat(F.lit("| "), "requirement_id", F.lit(" | "), "tag", F.lit(" | "), plain(F.array_join("labels", "; ")), F.lit(" |")).alias("line"))
    passing = tests.filter("passed").select(F.explode("tags").alias("tag"), "label").groupBy("tag").agg(F.count_distinct("label").alias("n"))
    passing = passing.select(F.concat(F.lit("3-"), "tag").alias("ord"), F.concat(F.lit("| "), "tag", F.lit(" | "), "n", F.lit(" |")).alias("line"))
    return summary.unionByName(verified).unionByName(passing)


def selected_adapters(wanted: DataFrame, settings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each capability's backend: the setting if it is allowed, ``unconfigured`` if there is none, a code if it isn't allowed."""
    both = wanted.join(settings, "capability", "left").join(allowed.withColumn("_ok", F.lit(True)), ["capability", "backend"], "left")
    return both.select("capability", F.coalesce("backend", F.lit("unconfigured")).alias("backend"), F.when(c("backend").isNotNull() & c("_ok").isNull(), "adapter_not_allowlisted").alias("code"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Appends rows of model runs to a Parquet log."""
    runs.write.mode("append").parquet(path)


def write_results(rows: DataFrame, path: str, key: str) -> None:
    """Writes a completion's rows in one commit, by key; a batch that is run again replaces what it wrote before."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
