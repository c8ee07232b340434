"""Fixed schemas of the data model.

Times are ISO-8601 strings in the stored tables. The pay union (structured or
free text) is held as two columns of which at most one is non-null.
"""

from pyspark.sql import types as T

INTERVALS = ("annual", "hourly", "monthly", "weekly")

PAY = T.StructType([
    T.StructField("min_amount", T.LongType()),
    T.StructField("max_amount", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("equity", T.BooleanType()),
    T.StructField("bonus", T.BooleanType()),
])
PAY_DDL = (
    "struct<min_amount:bigint,max_amount:bigint,currency:string,"
    "interval:string,equity:boolean,bonus:boolean>"
)

REQUIRED = ("hash", "title", "company", "url", "description", "source")

POSTING = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("last_seen_at", T.StringType()),
    T.StructField("team", T.StringType()),
    T.StructField("posted", T.StringType()),
    T.StructField("compensation", PAY),
    T.StructField("compensation_raw", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("ord", T.LongType()),
])
POSTING_FIELDS = tuple(f.name for f in POSTING)

INTEREST_FIELDS = (
    "strengths_alignment", "growth_opportunities", "role_type_fit",
    "industry_alignment", "company_reputation", "compensation", "location",
    "summary",
)
FIT_FIELDS = (
    "demonstrated_experience", "institutional_credibility",
    "depth_vs_adjacency", "career_trajectory", "minimum_qualifications",
    "seniority_alignment", "location_visa", "summary",
)


def _assessment(fields: tuple[str, ...]) -> T.StructType:
    return T.StructType(
        [T.StructField(f, T.StringType()) for f in fields]
        + [T.StructField("score", T.IntegerType())]
    )


INTEREST = _assessment(INTEREST_FIELDS)
FIT = _assessment(FIT_FIELDS)
SCORE = T.StructType([
    T.StructField("interest", INTEREST),
    T.StructField("fit", FIT),
])

EXAMPLE = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("team", T.StringType()),
    T.StructField("comp", T.StringType()),
    T.StructField("interest_score", T.IntegerType()),
    T.StructField("fit_score", T.IntegerType()),
])
EXAMPLE_FIELDS = tuple(f.name for f in EXAMPLE)

STATUS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("last_run_at", T.StringType()),
    T.StructField("last_run_ok", T.BooleanType()),
    T.StructField("last_run_error", T.StringType()),
    T.StructField("last_run_jobs", T.LongType()),
    T.StructField("last_success_at", T.StringType()),
    T.StructField("last_success_jobs", T.LongType()),
])

SOURCES = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    T.StructField("cache_ttl", T.DoubleType()),
])

PAYLOAD = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("request_key", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("fetched_at", T.DoubleType()),
    T.StructField("ord", T.LongType()),
])

# Default parameters of the workflow.
PAYLOAD_TTL_SECONDS = 86_400
RETAIN_SECONDS = 7 * 86_400
WARN_SECONDS = 2 * 86_400
DEDUP_FIELDS = ("title", "company", "team", "description")
