"""Posting-shaped views of the given tables, in Spark and in SQL.

Every view covers its whole table. The two forms of a view are the same
expressions, so a registered query and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.pay import pay_struct
from postmill.functions.text import WHITESPACE, job_hash
from postmill.schema import POSTING_FIELDS

AS_OF = "2026-04-19T12:00:00"
EVENTS_AS_OF = 1706572800.0  # 2024-01-30T00:00:00

WS = WHITESPACE


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores where its scan has fewer tasks."""
    df, cores = table(spark, sf, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sql_hash(title: str, company: str, description: str) -> str:
    text = f"{title} || chr(10) || {company} || chr(10) || {description}"
    return f"sha256(trim(lower({text}), '{WS}'))"


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as postings; pay, stamps and urls follow from their numbers."""
    d = texts(spark, sf, "documents")
    n, size = F.col("doc_id"), F.col("n_chars")
    kind = n % 4
    amount = pay_struct(
        F.when(kind != 2, size * 50), F.when(kind != 1, size * 80),
        F.when(n % 3 == 0, F.lit("EUR")).when(n % 3 == 1, F.lit("USD")),
        F.when(n % 5 == 0, F.lit("hourly")).when(n % 5 == 1, F.lit("annual"))
        .when(n % 5 == 2, F.lit("monthly")).when(n % 5 == 3, F.lit("weekly")),
        n % 7 == 0, n % 11 == 0,
    )
    out = d.select(
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
        F.concat(F.lit("NATION_"), (size % 25).cast("string")).alias("company"),
        F.concat(F.lit("https://x/"), F.floor(n / 3).cast("string")).alias("url"),
        F.col("text").alias("description"), "source",
        F.date_format(F.date_sub(F.lit("2026-04-19").cast("date"), (n % 12).cast("int")),
                      "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen_at"),
        F.lit(None).cast("string").alias("team"),
        F.date_sub(F.lit("2026-04-19").cast("date"), (n % 500).cast("int")).cast("string").alias("posted"),
        F.when(kind < 3, amount).alias("compensation"),
        F.when((kind == 3) & (n % 8 == 3), F.lit("Competitive")).alias("compensation_raw"),
        F.col("lang").alias("location"), n.alias("ord"),
    )
    return out.withColumn("hash", job_hash("title", "company", "description")).select(*POSTING_FIELDS)


FRESH_SOURCES = ("src0", "src1", "src2", "src3", "src4")


def fresh(spark: SparkSession, sf: str) -> DataFrame:
    """What a run observed that covered some sources; descriptions may be edited."""
    edited = F.when(F.col("ord") % 5 == 0, F.concat("description", F.lit(" (edited)"))).otherwise(
        F.col("description")
    )
    return (
        postings(spark, sf).filter(F.col("source").isin(*FRESH_SOURCES))
        .withColumn("description", edited)
        .withColumn("hash", job_hash("title", "company", "description"))
        .withColumn("last_seen_at", F.lit(""))
    )


def store(spark: SparkSession, sf: str) -> DataFrame:
    from postmill.operators.dedup import last_value_first_position

    return last_value_first_position(postings(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two scores per labelled document, by posting hash; copies keep the first."""
    from postmill.operators.dedup import first_per_key

    p, labels = postings(spark, sf), table(spark, sf, "labels")
    i = (F.col("quality") * 60 + F.col("doc_id") % 41).cast("int")
    f = ((1 - F.col("toxic")) * 50 + F.col("doc_id") % 51).cast("int")
    rows = p.select("hash", "ord").join(labels, F.col("ord") == F.col("doc_id")).select(
        "hash", "ord", i.alias("interest_score"), f.alias("fit_score")
    )
    return first_per_key(rows, [F.col("hash")], [F.col("ord")]).drop("ord")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as run outcomes of a source per user."""
    e = table(spark, sf, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("user_id").cast("string").alias("source"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("run_at"),
        ok.alias("ok"), F.floor("value").alias("jobs"),
        F.when(~ok, F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"),
        F.col("event_id").alias("n"),
    )


def cache_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cache records; some lack a key, some live forever."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("_key"),
        F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
        .cast("double").alias("_ts"),
        F.when(k % 3 != 0, (k * 7200).cast("double")).alias("_ttl"),
        F.col("props").alias("value"), F.col("event_id").alias("line_no"),
    )


def first_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as own contacts at a nation."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"),
        F.concat(F.lit("https://p/"), (F.col("s_suppkey") * 7).cast("string")).alias("url"),
        F.concat(F.lit(" Nation_"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("company"),
    )


def network_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as contacts of intermediaries, one per market segment."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_mktsegment").alias("person"), F.initcap("c_mktsegment").alias("via_name"),
        F.concat(F.lit("https://p/"), F.lower("c_mktsegment")).alias("via_url"),
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"),
        F.concat(F.lit("https://p/"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("url"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("company"),
    )


def context(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as context documents, named like their canonical company."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 5 <> 4")
    return joined.select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("canonical"),
        F.concat("n_name", F.lit(" lies in "), "r_name").alias("content"),
    )


def sources(spark: SparkSession, sf: str, platform: str) -> DataFrame:
    """Suppliers as the boards of one platform."""
    s = table(spark, sf, "supplier")
    extra = F.create_map(F.lit("instance"), F.lit("wd5"), F.lit("site"), F.lit("careers"))
    return s.select(
        F.lit(platform).alias("platform"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"),
        F.col("s_name").alias("name"), extra.alias("extra"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(2_000_000.0)).alias("cache_ttl"),
    )


_AMOUNT = """CASE WHEN doc_id % 4 < 3 THEN {{
    'min_amount': CASE WHEN doc_id % 4 <> 2 THEN n_chars * 50 END,
    'max_amount': CASE WHEN doc_id % 4 <> 1 THEN n_chars * 80 END,
    'currency': CASE doc_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END,
    'interval': CASE doc_id % 5 WHEN 0 THEN 'hourly' WHEN 1 THEN 'annual'
                WHEN 2 THEN 'monthly' WHEN 3 THEN 'weekly' END,
    'equity': doc_id % 7 = 0, 'bonus': doc_id % 11 = 0}} END""".replace("{{", "{").replace("}}", "}")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_postings": ((), f"""
        SELECT {sql_hash('title', 'company', 'description')} AS hash, * FROM (
          SELECT regexp_extract(text, '^[^.\n]*') AS title,
                 'NATION_' || (n_chars % 25) AS company,
                 'https://x/' || (doc_id // 3) AS url, text AS description, source,
                 strftime(DATE '2026-04-19' - CAST(doc_id % 12 AS INTEGER), '%Y-%m-%dT%H:%M:%S') AS last_seen_at,
                 CAST(NULL AS VARCHAR) AS team,
                 strftime(DATE '2026-04-19' - CAST(doc_id % 500 AS INTEGER), '%Y-%m-%d') AS posted,
                 {_AMOUNT} AS compensation,
                 CASE WHEN doc_id % 8 = 3 THEN 'Competitive' END AS compensation_raw,
                 lang AS location, doc_id AS ord
          FROM documents)"""),
    "v_fresh": (("v_postings",), f"""
        SELECT {sql_hash('title', 'company', 'description')} AS hash, * FROM (
          SELECT title, company, url,
                 CASE WHEN ord % 5 = 0 THEN description || ' (edited)' ELSE description END AS description,
                 source, team, posted, compensation, compensation_raw, location, ord
          FROM v_postings WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4'))"""),
    "v_store": (("v_postings",), """
        SELECT p.* REPLACE (k.first AS ord) FROM v_postings p
        JOIN (SELECT hash, min(ord) AS first, max(ord) AS last FROM v_postings GROUP BY hash) k
          ON p.ord = k.last"""),
    "v_scores": (("v_postings",), """
        SELECT hash, interest_score, fit_score FROM (
          SELECT p.hash, CAST(quality * 60 + doc_id % 41 AS INTEGER) AS interest_score,
                 CAST((1 - toxic) * 50 + doc_id % 51 AS INTEGER) AS fit_score,
                 row_number() OVER (PARTITION BY p.hash ORDER BY doc_id) AS rn
          FROM labels JOIN v_postings p ON p.ord = doc_id) WHERE rn = 1"""),
    "v_runs": ((), """
        SELECT CAST(user_id AS VARCHAR) AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS run_at,
               event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS jobs,
               CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error, event_id AS n
        FROM events"""),
    "v_cache": ((), """
        SELECT CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS _key,
               CAST(floor(epoch(ts)) AS DOUBLE) AS _ts,
               CASE WHEN k % 3 <> 0 THEN CAST(k * 7200 AS DOUBLE) END AS _ttl,
               props AS value, event_id AS line_no
        FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)"""),
    "v_first": ((), f"""
        SELECT lower(trim(' Nation_' || s_nationkey || ' ', '{WS}')) AS company_key, s_suppkey AS ord,
               s_name AS name, 'https://p/' || (s_suppkey * 7) AS url FROM supplier"""),
    "v_second": (("v_first",), """
        SELECT company_key, person, via_name, via_url, ord, name, url FROM (
          SELECT *, row_number() OVER (PARTITION BY company_key, url ORDER BY person, ord) AS rn FROM (
            SELECT 'nation_' || c_nationkey AS company_key, c_mktsegment AS person,
                   upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS via_name,
                   'https://p/' || lower(c_mktsegment) AS via_url, c_custkey AS ord, c_name AS name,
                   'https://p/' || (c_custkey // 2) AS url FROM customer)
          WHERE url NOT IN (SELECT url FROM v_first)) WHERE rn = 1"""),
    "v_context": ((), """
        SELECT 'nation-' || n_nationkey AS canonical, n_name || ' lies in ' || r_name AS content
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4"""),
}
