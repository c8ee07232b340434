"""Readers of the stored tables and of the files people keep."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import strip
from postmill.operators.dedup import last_value_first_position
from postmill.schema import PAY_DDL, POSTING, REQUIRED, STATUS

# Stored postings hold the pay union in one field: an object or a text.
UNION = T.StructType(
    [f if f.name != "compensation" else T.StructField("compensation", T.StringType())
     for f in POSTING if f.name != "compensation_raw"]
)


def split_pay_union(text: Column | str) -> tuple[Column, Column]:
    """(structured, raw) of a pay field read as text."""
    c = F.col(text) if isinstance(text, str) else text
    is_object = F.startswith(F.ltrim(c), F.lit("{"))
    return F.when(is_object, F.from_json(c, PAY_DDL)), F.when(~is_object, c)


def _postings(raw: DataFrame) -> DataFrame:
    pay, text = split_pay_union("compensation")
    checked = [
        F.when(F.col(c).isNull(), F.raise_error(F.lit(f"posting without {c}"))).otherwise(F.col(c)).alias(c)
        for c in REQUIRED
    ]
    return raw.select(
        *checked, F.coalesce("last_seen_at", F.lit("")).alias("last_seen_at"), "team", "posted",
        pay.alias("compensation"), text.alias("compensation_raw"), "location", "ord",
    )


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings as JSON lines; malformed lines and missing fields are errors.

    Rows written without ``ord`` are numbered in file order.
    """
    raw = spark.read.schema(UNION).json(path, mode="FAILFAST")
    return _postings(
        raw.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()))
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Retained postings: last record per hash; a missing path is an empty store."""
    try:
        return last_value_first_position(read_postings(spark, path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POSTING)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log with line numbers; corrupt lines are dropped."""
    return (
        spark.read.schema(schema).json(path, mode="DROPMALFORMED")
        .withColumn("line_no", F.monotonically_increasing_id())
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STATUS).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATUS)


def read_training(spark: SparkSession, path: str, fingerprint: str, schema) -> DataFrame:
    """Training rows of one fingerprint; any other fingerprint yields none."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return gated(table, fingerprint)


def gated(training: DataFrame, fingerprint: str | Column) -> DataFrame:
    """Training rows that belong to the current fingerprint."""
    fp = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return training.filter(F.col("fingerprint") == fp).drop("fingerprint")


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, content) of a directory of ``<canonical>.md`` documents."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return files.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("canonical"),
        strip("value").alias("content"),
    )


# --- contact exports -------------------------------------------------------
# Fixed values of the export format.
HEADER_START = "First Name,"
NBSP = "\u00a0"
# Possessive, so that long records and fields are matched without recursion.
RECORD = r'[^"\n]*+(?:"[^"]*+"[^"\n]*+)*+'
FIELD = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


def _fields(record: Column) -> Column:
    found = F.regexp_extract_all(record, F.lit(FIELD), F.lit(1))
    return F.transform(
        found,
        lambda f: F.when(
            F.startswith(f, F.lit('"')),
            F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(f),
    )


def parse_contacts(files: DataFrame) -> DataFrame:
    """Contacts of export files given as (person, content) rows.

    A preamble before the header row is skipped. First name, company and url are
    required. The header is looked up by name, so column order does not matter.
    """
    text = F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), r"\r\n?", "\n")
    cut = F.regexp_replace(text, rf"(?s)^.*?(?:^|\n)(?={HEADER_START})", "")
    records = F.array_remove(F.regexp_extract_all(cut, F.lit(RECORD), F.lit(0)), "")
    other = [c for c in files.columns if c != "content"]
    # The header is taken before the records are spread, so that no row carries the whole file.
    rows = (
        files.select(*other, records.alias("records"))
        .withColumn("header", _fields(F.get("records", F.lit(0))))
        .select(*other, "header", F.posexplode_outer("records").alias("ord", "record"))
        .filter("ord > 0")
        .withColumn("fields", _fields(F.col("record")))
    )

    def named(column: str) -> Column:
        at = F.array_position("header", F.lit(column)).cast("int") - 1
        return F.coalesce(strip(F.get("fields", at)), F.lit(""))

    first, last = named("First Name"), named("Last Name")
    return rows.select(
        *other, F.col("ord").cast("bigint").alias("ord"), first.alias("_first"),
        strip(F.concat(first, F.lit(NBSP), last)).alias("name"),
        named("URL").alias("url"), named("Company").alias("company"),
    ).filter("_first <> '' and company <> '' and url <> ''").drop("_first")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Own contacts of one export file."""
    files = spark.read.text(path, wholetext=True)
    return parse_contacts(files.select(F.lit("").alias("person"), F.col("value").alias("content")))


PERSON = "first_name string, last_name string, linkedin_profile_url string"


def with_via(contacts: DataFrame, persons: DataFrame) -> DataFrame:
    """Adds the intermediary's name and url; the directory name is the fallback."""
    name = strip(F.concat(
        F.coalesce("first_name", F.lit("")), F.lit(NBSP), F.coalesce("last_name", F.lit(""))
    ))
    info = persons.select(
        "person", name.alias("via_name"),
        F.coalesce("linkedin_profile_url", F.lit("")).alias("via_url"),
    )
    return (
        contacts.join(info, "person", "left")
        .withColumn("via_name", F.coalesce("via_name", "person"))
        .withColumn("via_url", F.coalesce("via_url", F.lit("")))
    )


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Contacts of intermediaries: ``<path>/<person>/Connections.csv``.

    An optional ``Person.json`` beside it names the intermediary.
    """
    person = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    decoded = F.url_decode(F.replace(person, F.lit("+"), F.lit("%2B")))
    exports = spark.read.text(f"{path}/*/Connections.csv", wholetext=True)
    contacts = parse_contacts(
        exports.select(decoded.alias("person"), F.col("value").alias("content"))
    )
    try:
        infos = spark.read.text(f"{path}/*/Person.json", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        infos = spark.createDataFrame([], f"person string, {PERSON}")
    else:
        infos = infos.select(
            decoded.alias("person"), F.from_json("value", PERSON).alias("p")
        ).select("person", "p.*")
    return with_via(contacts, infos)
