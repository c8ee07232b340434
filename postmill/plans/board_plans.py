"""Queries that turn parts into platform payloads and normalise them again.

Every part becomes one listing payload with two postings (and, where the
platform has them, two detail payloads) on the board of a supplier.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import enrich
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.session import fresh_path
from postmill.sources import boards, custom, feeds

# --- the parts behind the payloads -----------------------------------------

ITEM_SQL = """
    SELECT p_partkey * 16777216 + i AS ord, p_partkey AS k, i, 's' || (p_partkey % (SELECT count(*) FROM supplier)) AS slug, s_name AS company,
      CASE i WHEN 0 THEN p_name ELSE p_brand || ' ' || p_name END AS title, p_type AS kind, p_size AS size,
      p_brand AS brand, CAST(floor(p_retailprice) AS BIGINT) AS price
    FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) CROSS JOIN (VALUES (0), (1)) t(i)"""


def board_of(spark, sf, number: str) -> Column:
    """The board a number falls to; numbers are dealt to all suppliers in turn."""
    boards_in_all = v.table(spark, sf, "supplier").agg(F.count("*")).scalar()
    return F.concat(F.lit("s"), (F.col(number) % boards_in_all).cast("string"))


def parts(spark, sf) -> DataFrame:
    return v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), board_of(spark, sf, "p_partkey").alias("slug"),
        "p_name", "p_brand", "p_type", "p_size", F.floor("p_retailprice").alias("price"),
    )


def title(i: int) -> Column:
    return F.col("p_name") if i == 0 else F.concat("p_brand", F.lit(" "), "p_name")


def key(i: int) -> Column:
    return F.concat(F.col("k").cast("string"), F.lit(f"-{i}"))


def day() -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size"))


DAY_SQL = "strftime(DATE '2026-01-01' + size, '%Y-%m-%d')"


def named(**columns) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in columns.items()])


def listing(spark, sf, platform: str, body: Column, request: Column | None = None) -> DataFrame:
    request = F.concat(F.lit("page "), F.col("k").cast("string")) if request is None else request
    return parts(spark, sf).select(
        F.lit(platform).alias("platform"), "slug", F.lit("listing").alias("kind"),
        request.alias("request_key"), body.alias("body"), F.lit(0.0).alias("fetched_at"), F.col("k").alias("ord"),
    )


def detail(spark, sf, platform: str, i: int, body: Column, request: Column | None = None, kind="detail") -> DataFrame:
    return parts(spark, sf).select(
        F.lit(platform).alias("platform"), "slug", F.lit(kind).alias("kind"),
        (request if request is not None else key(i)).alias("request_key"), body.alias("body"),
        F.lit(0.0).alias("fetched_at"), F.col("k").alias("ord"),
    )


def both(build) -> Column:
    return F.array(build(0), build(1))


def result(spark, sf, platform: str, payloads: DataFrame) -> DataFrame:
    postings, _ = boards.normalize(platform, payloads, v.sources(spark, sf, platform))
    c, blank = F.col("compensation"), F.lit("")
    return postings.select(
        "hash", "title", "company", "url", "description", "source", F.coalesce("team", blank).alias("team"),
        F.coalesce("posted", blank).alias("posted"), F.coalesce("location", blank).alias("location"),
        F.coalesce(c["min_amount"], F.lit(-1)).alias("low"), F.coalesce(c["max_amount"], F.lit(-1)).alias("high"),
        F.coalesce(c["currency"], blank).alias("currency"), F.coalesce(c["interval"], blank).alias("every"),
        F.coalesce("compensation_raw", blank).alias("raw"), "ord",
    )


#: What each platform's board sends, and what comes of it in SQL.
PAGES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def board(name: str, platform: str, sql: str, repeated: bool = False):
    """Register the payloads of a platform and the query that normalises them.

    Where a listing is ``repeated``, the second item lies one place further on.
    """

    def register(pages):
        PAGES[platform], EXPECTED[platform] = pages, sql

        @query(name, sql)
        def run(spark, sf):
            out = result(spark, sf, platform, pages(spark, sf))
            moved = F.when(F.lit(repeated) & (F.col("ord") % 16777216 == 2), 1).otherwise(0)
            return out.withColumn("ord", F.col("ord") - moved)

        return pages

    return register


def expect(platform: str, *, url: str, description: str, team="''", posted=DAY_SQL, location="''", low="-1",
           high="-1", currency="''", every="''", raw="''", where="TRUE", the_title="title", ord="ord") -> str:
    inner = f"""SELECT {the_title} AS title, company, {url} AS url, {description} AS description,
      '{platform}:' || slug AS source, {team} AS team, {posted} AS posted, {location} AS location,
      CAST({low} AS BIGINT) AS low, CAST({high} AS BIGINT) AS high, {currency} AS currency, {every} AS every,
      {raw} AS raw, {ord} AS ord FROM ({ITEM_SQL}) WHERE {where}"""
    return f"SELECT {v.sql_hash('title', 'company', 'description')} AS hash, * FROM ({inner})"


def html_body() -> Column:
    return F.concat(F.lit("&lt;p&gt;Make &lt;b&gt;"), "p_type", F.lit("&lt;/b&gt;&lt;/p&gt;&lt;p&gt;R&amp;amp;D&lt;/p&gt;"))
HTML_TEXT = "'Make' || chr(10) || kind || chr(10) || 'R&D'"
def plain() -> Column:
    return F.concat(F.lit("Plain "), "p_type")


PLAIN_SQL = "'Plain ' || kind"
LINK = "'https://j/' || k || '-' || i"


def link(i: int) -> Column:
    return F.concat(F.lit("https://j/"), key(i))


@board("nrm1_greenhouse", "greenhouse", expect(
    "greenhouse", url=LINK, description=HTML_TEXT, team="brand", location="kind",
    low="CASE WHEN size % 3 = 0 THEN -1 ELSE price END", high="CASE WHEN size % 3 = 1 THEN -1 ELSE price + 1 END",
    currency="CASE WHEN size % 2 = 0 THEN 'EUR' ELSE 'USD' END"))
def greenhouse(spark, sf):
    size = F.col("p_size")
    cents = named(
        min_cents=F.when(size % 3 != 0, F.col("price") * 100 + 99), max_cents=F.when(size % 3 != 1, F.col("price") * 100 + 199),
        currency_type=F.when(size % 2 == 0, "EUR").otherwise(""),
    )
    nothing = named(min_cents=F.lit(None).cast("bigint"), max_cents=F.lit(None).cast("bigint"), currency_type="GBP")

    def job(i):
        return named(
            title=title(i), content=html_body(), departments=F.array(named(name=F.col("p_brand")), named(name="other")),
            location=named(name=F.col("p_type")), absolute_url=link(i),
            updated_at=F.concat(day().cast("string"), F.lit("T10:00:00-04:00")), pay_input_ranges=F.array(nothing, cents),
        )

    return listing(spark, sf, "greenhouse", F.to_json(named(jobs=both(job))))


@board("nrm2_ashby", "ashby", expect(
    "ashby", url=LINK, description=PLAIN_SQL, team="CASE WHEN size % 2 = 0 THEN brand ELSE kind END", location="kind",
    low="CASE size % 4 WHEN 0 THEN price WHEN 1 THEN price * 1000 WHEN 2 THEN price ELSE -1 END",
    high="CASE size % 4 WHEN 0 THEN price + 1 WHEN 1 THEN price * 1000 + 2000 ELSE -1 END",
    currency="CASE size % 4 WHEN 0 THEN 'PLN' WHEN 1 THEN 'USD' WHEN 2 THEN 'USD' ELSE '' END",
    every="CASE size % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' WHEN 2 THEN 'hourly' ELSE '' END",
    raw="CASE WHEN size % 4 = 3 THEN 'CA$' || price || 'K' ELSE '' END"))
def ashby(spark, sf):
    size, price = F.col("p_size"), F.col("price").cast("string")
    summary = (
        F.when(size % 4 == 1, F.concat(F.lit("$"), price, F.lit("K – $"), (F.col("price") + 2).cast("string"), F.lit("K a year")))
        .when(size % 4 == 2, F.concat(F.lit("$"), price, F.lit(".75 per hour • Offers Equity")))
        .when(size % 4 == 3, F.concat(F.lit("CA$"), price, F.lit("K"))).otherwise("$1 - $2")
    )
    salary = named(compensationType="Salary", interval="1 MONTH", currencyCode="PLN",
                   minValue=F.col("price") + 0.5, maxValue=F.col("price") + 1.9)
    bonus = named(compensationType="Bonus", interval=F.lit(None).cast("string"), currencyCode=F.lit(None).cast("string"),
                  minValue=F.lit(None).cast("double"), maxValue=F.lit(None).cast("double"))
    pay = named(compensationTierSummary=summary,
                summaryComponents=F.when(size % 4 == 0, F.array(bonus, salary)).otherwise(F.array(bonus)))

    def job(i):
        return named(title=title(i), department=F.when(size % 2 == 0, F.col("p_brand")).otherwise(""), team=F.col("p_type"),
                     descriptionPlain=plain(), jobUrl=link(i), publishedAt=day().cast("string"), location=F.col("p_type"),
                     compensation=pay)

    return listing(spark, sf, "ashby", F.to_json(named(jobs=both(job))))


@board("nrm3_lever", "lever", expect(
    "lever", url=LINK, description=PLAIN_SQL, team="brand", location="kind",
    posted=f"CASE WHEN size % 5 = 0 THEN '' ELSE {DAY_SQL} END", low="price", high="price + 10",
    currency="'EUR'", every="CASE WHEN size % 2 = 0 THEN 'annual' ELSE '' END"))
def lever(spark, sf):
    days = F.date_diff(day(), F.lit("1970-01-01").cast("date")).cast("bigint")
    millis = F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(days * 86_400_000 + 86_399_999)

    def job(i):
        return named(
            text=title(i), categories=named(team=F.col("p_brand"), location=F.col("p_type")), descriptionPlain=plain(),
            hostedUrl=link(i), createdAt=millis,
            salaryRange=named(min=F.col("price") + 0.13, max=F.col("price") + 10.5, currency="EUR",
                              interval=F.when(F.col("p_size") % 2 == 0, "per-year-salary").otherwise("per-moon")),
        )

    return listing(spark, sf, "lever", F.to_json(both(job)))


@board("nrm4_gem", "gem", expect("gem", url=LINK, description=PLAIN_SQL, team="brand", location="kind"))
def gem(spark, sf):
    def job(i):
        return named(title=title(i), content_plain=plain(), absolute_url=link(i),
                     departments=F.array(named(name=F.col("p_brand"))), location=named(name=F.col("p_type")),
                     first_published_at=F.concat(day().cast("string"), F.lit("T01:02:03Z")))

    return listing(spark, sf, "gem", F.to_json(both(job)))


@board("nrm5_workable", "workable", expect(
    "workable", url="'https://apply.workable.com/' || slug || '/j/' || k || '-' || i || '/'", description=HTML_TEXT,
    team="brand", location="CASE WHEN size % 2 = 0 THEN kind || ', Land' ELSE kind || ', Region, Land' END"))
def workable(spark, sf):
    def job(i):
        return named(shortcode=key(i), title=title(i), department=F.array("p_brand"), published=day().cast("string"),
                     location=named(city=F.col("p_type"), region=F.when(F.col("p_size") % 2 == 0, "").otherwise("Region"),
                                    country="Land"))

    pages = listing(spark, sf, "workable", F.to_json(named(results=both(job))))
    for i in (0, 1):
        pages = pages.unionByName(detail(spark, sf, "workable", i, F.to_json(named(description=html_body()))))
    return pages


def pay_html() -> Column:
    return F.concat(
        F.lit("<p>Salary range: $"), F.format_number(F.col("price") * 100, 0), F.lit(" to $"),
        F.format_number(F.col("price") * 100 + 500, 0), F.lit(" per year</p>"),
    )



PAY_TEXT = "'Salary range: $' || format('{:,}', price * 100) || ' to $' || format('{:,}', price * 100 + 500) || ' per year'"
TEXT_PAY = dict(low="price * 100", high="price * 100 + 500", currency="'USD'", every="'annual'")


@board("nrm6_workday", "workday", expect(
    "workday", url="'https://' || slug || '.wd5.myworkdayjobs.com/careers/job/' || k || '-' || i",
    description=f"CASE WHEN i = 1 AND size % 4 = 0 THEN '' ELSE {PAY_TEXT} END",
    posted=f"CASE WHEN i = 1 AND size % 4 = 0 THEN '' ELSE {DAY_SQL} END",
    location="CASE WHEN i = 1 AND size % 4 = 0 THEN 'Anywhere' ELSE kind || '; ' || brand END",
    **{n: f"CASE WHEN i = 1 AND size % 4 = 0 THEN {d} ELSE {TEXT_PAY[n]} END" for n, d in
       (("low", "-1"), ("high", "-1"), ("currency", "''"), ("every", "''"))}))
def workday(spark, sf):
    """Listings repeat across pages; one detail in eight is missing or broken."""
    def path(i):
        return F.concat(F.lit("/job/"), key(i))

    def job(i):
        return named(title=title(i), externalPath=path(i), locationsText="Anywhere")

    info = named(jobDescription=pay_html(), startDate=day().cast("string"), location=F.col("p_type"),
                 additionalLocations=F.array(F.col("p_type"), F.lit(""), F.col("p_brand")))
    body = F.to_json(named(total=F.lit(2), jobPostings=F.array(job(0), job(1), job(0))))
    pages = listing(spark, sf, "workday", body)
    good = detail(spark, sf, "workday", 0, F.to_json(named(jobPostingInfo=info)), path(0))
    other = F.when(F.col("p_size") % 4 != 0, F.to_json(named(jobPostingInfo=info))).otherwise("{broken")
    pages = pages.unionByName(good).unionByName(detail(spark, sf, "workday", 1, other, path(1)))
    return pages


@board("nrm7_icims", "icims", expect(
    "icims", url=f"CASE WHEN size % 2 = 0 THEN {LINK} ELSE 'https://apply/' || k END",
    description=f"{PAY_TEXT} || CASE WHEN size % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Duties' END || chr(10) || chr(10) || 'Skills'",
    team="brand", location="CASE WHEN size % 2 = 0 THEN kind ELSE 'Short' END", **TEXT_PAY))
def icims(spark, sf):
    even = F.col("p_size") % 2 == 0

    def job(i):
        return named(data=named(
            title=title(i), description=pay_html(), qualifications="<ul><li>Skills</li></ul>",
            responsibilities=F.when(F.col("p_size") % 3 == 0, "").otherwise("<p>Duties</p>"),
            full_location=F.when(even, F.col("p_type")).otherwise(""), short_location="Short", location_name="Name",
            categories=F.array(named(name=F.col("p_brand"))), meta_data=named(canonical_url=F.when(even, link(i))),
            apply_url=F.concat(F.lit("https://apply/"), F.col("k").cast("string")), posted_date=day().cast("string"),
        ))

    return listing(spark, sf, "icims", F.to_json(named(jobs=both(job))))


@board("nrm8_phenom", "phenom", expect(
    "phenom", url="'https://' || slug || '/us/en/job/' || k || '-' || i", description=PAY_TEXT,
    team="CASE WHEN size % 2 = 0 THEN brand ELSE 'Dept' END", location="CASE WHEN size % 3 = 0 THEN kind ELSE 'City' END",
    **TEXT_PAY))
def phenom(spark, sf):
    def job(i):
        return named(title=title(i), location=F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(""), city="City",
                     category=F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), department="Dept", jobSeqNo=key(i),
                     postedDate=F.concat(day().cast("string"), F.lit("T00:00:00.000+0000")))

    pages = listing(spark, sf, "phenom", F.to_json(named(refineSearch=named(data=named(jobs=both(job))))))
    body = F.to_json(named(jobDetail=named(data=named(job=named(description=pay_html())))))
    for i in (0, 1):
        pages = pages.unionByName(detail(spark, sf, "phenom", i, body))
    return pages


@board("nrm9_rippling", "rippling", expect(
    "rippling", url=LINK, description="'Make' || chr(10) || kind || chr(10) || 'R&D' || chr(10) || chr(10) || 'Firm'",
    team="CASE WHEN size % 2 = 0 THEN brand ELSE 'Base' END", location="kind || ', Remote'",
    posted="strftime(DATE '2026-01-01' + size - 1, '%Y-%m-%d')", low="price", high="-1", currency="'GBP'", every="'weekly'"), repeated=True)
def rippling(spark, sf):
    pages = listing(spark, sf, "rippling", F.to_json(F.array(named(uuid=key(0)), named(uuid=key(0)), named(uuid=key(1)))))
    empty = named(rangeStart=F.lit(None).cast("double"), rangeEnd=F.lit(None).cast("double"), currency="USD", frequency="YEAR")
    paid = named(rangeStart=F.col("price") + 0.9, rangeEnd=F.lit(None).cast("double"), currency="GBP", frequency="WEEK")
    for i in (0, 1):
        pages = pages.unionByName(detail(spark, sf, "rippling", i, F.to_json(named(
            name=title(i), description=named(role=html_body(), company="<p>Firm</p>"),
            department=named(name=F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), base_department="Base"),
            workLocations=F.array(F.col("p_type"), F.lit("Remote")), url=link(i), payRangeDetails=F.array(empty, paid),
            createdOn=F.concat(day().cast("string"), F.lit("T01:00:00+05:30")),
        ))))
    return pages


@board("nrm10_smartrecruiters", "smartrecruiters", expect(
    "smartrecruiters", url=f"CASE WHEN i = 0 THEN {LINK} ELSE 'https://jobs.smartrecruiters.com/' || slug || '/' || k || '-1' END",
    description="CASE WHEN i = 0 THEN 'Make' || chr(10) || kind || chr(10) || 'R&D' || chr(10) || chr(10) || 'More' ELSE '' END",
    location="kind", low="-1", high="CASE WHEN i = 0 THEN price ELSE -1 END", currency="CASE WHEN i = 0 THEN 'EUR' ELSE '' END",
    every="CASE WHEN i = 0 THEN 'annual' ELSE '' END"))
def smartrecruiters(spark, sf):
    """Details of second items were not captured; their rows stay."""
    def job(i):
        return named(name=title(i), id=key(i), location=named(fullLocation=F.col("p_type")),
                     releasedDate=F.concat(day().cast("string"), F.lit("T00:00:00Z")))

    pages = listing(spark, sf, "smartrecruiters", F.to_json(named(totalFound=F.lit(2), content=both(job))))
    body = named(
        jobAd=named(sections=named(jobDescription=named(text=html_body()), qualifications=named(text=""),
                                   additionalInformation=named(text="<p>More</p>"))),
        postingUrl=link(0), compensation=named(min=F.lit(0), max=F.col("price"), currency="EUR", period="YEARLY"),
    )
    pages = pages.unionByName(detail(spark, sf, "smartrecruiters", 0, F.to_json(body)))
    return pages


@board("nrm11_src9_trakstar", "trakstar", expect(
    "trakstar", url=LINK, description=HTML_TEXT, team="CASE WHEN size % 2 = 0 THEN brand ELSE '' END",
    location="kind || ', Land'"))
def trakstar(spark, sf):
    def item(i):
        return F.concat(
            F.lit("<item><title>"), title(i), F.lit("</title><link>http://J/"), key(i), F.lit("</link><description>"),
            html_body(), F.lit("</description><pubDate>"), F.date_format(day(), "EEE, d MMM yyyy"),
            F.lit(" 00:00:00 +0530</pubDate><job:team>"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""),
            F.lit("</job:team><job:locationCity>"), "p_type",
            F.lit("</job:locationCity><job:locationState></job:locationState><job:locationCountry>Land</job:locationCountry></item>"),
        )

    body = F.concat(F.lit('<rss xmlns:job="https://recruiterbox.com/rss/job/"><channel><title>Feed</title>'),
                    item(0), item(1), F.lit("</channel></rss>"))
    return listing(spark, sf, "trakstar", body)


@board("nrm12_breezy", "breezy", expect(
    "breezy", url=LINK, description=HTML_TEXT, team="CASE WHEN size % 2 = 0 THEN brand ELSE '' END", location="kind"))
def breezy(spark, sf):
    def job(i):
        return named(name=title(i), url=link(i), department=F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""),
                     published_date=F.concat(day().cast("string"), F.lit("T00:00:00Z")), location=named(name=F.col("p_type")))

    pages = listing(spark, sf, "breezy", F.to_json(both(job)))
    data = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), html_body().alias("description")))
    page = F.concat(F.lit("<html><head><script type='application/ld+json'>"), data, F.lit("</script></head></html>"))
    for i in (0, 1):
        pages = pages.unionByName(detail(spark, sf, "breezy", i, page, link(i), "page"))
    return pages


@board("nrm13_kula", "kula", expect(
    "kula", url="'https://careers.kula.ai/' || slug || '/jobs/' || k", description=HTML_TEXT, team="brand", posted="''",
    location="CASE size % 3 WHEN 0 THEN kind || ' (Hybrid, Full time)' WHEN 1 THEN kind ELSE 'Hybrid' END",
    where="NOT (i = 1 AND size % 2 = 0)"))
def kula(spark, sf):
    third = F.col("p_size") % 3

    def job(i):
        return named(
            id=F.col("k"), title=F.concat(F.lit(" "), title(i), F.lit("\n")),
            listed=F.when(F.col("p_size") % 2 == 0, F.lit(i == 0)),
            ats_job=named(
                job_description="$a", ats_department=named(name=F.concat("p_brand", F.lit(" "))),
                offices=F.when(third != 2, F.array(named(location=F.col("p_type")))),
                workplace=F.when(third != 1, "Hybrid"), employment_type=F.when(third == 0, "Full time").otherwise(""),
            ),
        )

    refs = F.create_map(F.lit("$a"), html_body(), F.lit("$b"), F.lit("other"))
    return listing(spark, sf, "kula", F.to_json(named(jobs=both(job), refs=refs)))


# --- collection ------------------------------------------------------------


def gem_pages(spark, sf) -> DataFrame:
    """Gem pages of which those of size 13 arrived broken."""
    def job(i):
        return named(title=title(i), content_plain=plain(), absolute_url=link(i))

    body = F.when(F.col("p_size") == 13, F.lit('[{"title": ')).otherwise(F.to_json(both(job)))
    return listing(spark, sf, "gem", body)


@query("src10_failed_source_has_no_rows", f"""
    SELECT 'gem:' || slug AS source, title, ord FROM ({ITEM_SQL})
    WHERE slug NOT IN (SELECT DISTINCT 's' || (p_partkey % (SELECT count(*) FROM supplier)) FROM part WHERE p_size = 13 AND p_partkey % 10 IN (3, 7))""")
def failed_source(spark, sf):
    return boards.normalize("gem", partly_broken(spark, sf), v.sources(spark, sf, "gem"))[0].select("source", "title", "ord")


def partly_broken(spark, sf) -> DataFrame:
    def job(i):
        return named(title=title(i), content_plain=plain(), absolute_url=link(i))

    broken = (F.col("p_size") == 13) & (F.col("k") % 10).isin(3, 7)
    return listing(spark, sf, "gem", F.when(broken, F.lit('[{"title": ')).otherwise(F.to_json(both(job))))


@query("src10_errors", """
    SELECT source, min(error) AS error FROM (
    SELECT 'gem:s' || (p_partkey % (SELECT count(*) FROM supplier)) AS source, 'malformed listing page ' || p_partkey AS error
    FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) WHERE p_size = 13 AND p_partkey % 10 IN (3, 7)) GROUP BY source""")
def source_errors(spark, sf):
    return boards.normalize("gem", partly_broken(spark, sf), v.sources(spark, sf, "gem"))[1]


@query("src10_collect_two_platforms", f"""
    SELECT p || ':' || slug AS source, count(*) AS jobs FROM ({ITEM_SQL}), (VALUES ('gem'), ('lever')) t(p) GROUP BY ALL""")
def collect(spark, sf):
    def job(i):
        return named(title=title(i), content_plain=plain(), absolute_url=link(i))

    def post(i):
        return named(text=title(i), descriptionPlain=plain())

    pages = listing(spark, sf, "gem", F.to_json(both(job))).unionByName(
        listing(spark, sf, "lever", F.to_json(both(post)))
    )
    registry = v.sources(spark, sf, "gem").unionByName(v.sources(spark, sf, "lever"))
    postings, _ = boards.collect(pages, registry, ["gem", "lever"])
    return postings.groupBy("source").agg(F.count("*").alias("jobs"))


@query("src10_collect_all_platforms", "SELECT source, count(*) AS jobs, min(hash) AS first_hash, max(hash) AS last_hash FROM ("
       + " UNION ALL ".join(f"SELECT source, hash FROM ({sql})" for sql in EXPECTED.values()) + ") GROUP BY source")
def collect_all(spark, sf):
    """The boards of all platforms from one table of payloads."""
    pages = reduce(DataFrame.unionByName, [build(spark, sf) for build in PAGES.values()])
    registry = reduce(DataFrame.unionByName, [v.sources(spark, sf, platform) for platform in PAGES])
    postings, _ = boards.collect(pages, registry)
    return postings.groupBy("source").agg(
        F.count("*").alias("jobs"), F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash")
    )


@query("jon10_udx2_live_payloads", """
    SELECT slug, request_key, arg_max(body, n) AS body, min(n) AS ord FROM (
      SELECT 's' || (user_id % (SELECT count(*) FROM supplier)) AS slug, 'r' || user_id AS request_key, props AS body, event_id AS n, ts,
        CASE WHEN user_id % 2 = 0 THEN 2000000 ELSE 86400 END AS ttl
      FROM events JOIN supplier ON s_suppkey = user_id % (SELECT count(*) FROM supplier))
    WHERE 1706572800 - floor(epoch(ts)) <= ttl GROUP BY ALL""")
def live_payloads(spark, sf):
    e = v.table(spark, sf, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    log = e.select(
        F.lit("gem").alias("platform"), board_of(spark, sf, "user_id").alias("slug"),
        F.lit("listing").alias("kind"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("request_key"),
        F.col("props").alias("body"), seconds.cast("double").alias("fetched_at"), F.col("event_id").alias("ord"),
    )
    return boards.live_payloads(log, v.sources(spark, sf, "gem"), v.EVENTS_AS_OF).select("slug", "request_key", "body", "ord")


@query("jon11_listing_detail_outer", """
    SELECT l_orderkey AS k, l_linenumber AS n, coalesce(o_orderpriority, '') AS found
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey""")
def listing_detail(spark, sf):
    details = v.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"
    )
    joined = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(details, "l_orderkey", "left")
    return joined.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
                         F.coalesce("o_orderpriority", F.lit("")).alias("found"))


@query("jon11_missing_details", f"""
    SELECT 'workday:' || slug AS source, title, ord,
      CASE WHEN k % 3 = 0 OR (i = 1 AND size % 4 = 0) THEN 'Anywhere' ELSE kind || '; ' || brand END AS location FROM ({ITEM_SQL})""")
def missing_details(spark, sf):
    """Listings whose details never came keep what the listing says, here for one page in three."""
    met = (F.col("kind") == "listing") | (F.col("ord") % 3 != 0)
    pages = workday(spark, sf).filter(met)
    return result(spark, sf, "workday", pages).select("source", "title", "ord", "location")


@query("udx1_custom_source", """
    SELECT hash, ord, CAST(location AS VARCHAR) AS location, '' AS last_seen_at FROM v_postings""", ("v_postings",))
def custom_source(spark, sf):
    own = v.postings(spark, sf).select("hash", "title", "company", "url", "description", "source", "location", "ord")
    return custom.conform(own).select("hash", "ord", "location", "last_seen_at")


@query("udx1_data_source", """
    SELECT hash, title, url, source, CAST(location AS VARCHAR) AS location, length(description) AS n_chars
    FROM v_postings""", ("v_postings",))
def data_source(spark, sf):
    """Postings as files of JSON lines, each file a part of a feed read as a data source."""
    path = fresh_path(spark, "feed")
    own = v.postings(spark, sf).select("title", "company", "url", "description", "source", "location")
    own.repartition(4).write.json(path)
    feeds.register_feed(spark, "posting_lines", feeds.LinesFeed(path))
    return feeds.read_feed(spark, "posting_lines").select(
        "hash", "title", "url", "source", "location", F.length("description").cast("long").alias("n_chars")
    )


@query("jon10_source_settings", """
    SELECT p_partkey AS ord, s_name AS name, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2000000 ELSE 86400 END AS DOUBLE) AS cache_ttl
    FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)""")
def source_settings(spark, sf):
    pages = gem_pages(spark, sf)
    return enrich.with_sources(pages, v.sources(spark, sf, "gem"), 86400.0).select("ord", "name", "cache_ttl")
