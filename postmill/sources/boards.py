"""Platform payloads to postings: parse, explode, project.

Every platform is one ``Board``: schemas of its listing and detail bodies, where
the items are, how a listing finds its detail, and the posting columns. The
shared job does parsing, joins, hashing and failure isolation.

Payload tables hold one current body per (platform, slug, kind, request_key);
``live_payloads`` makes such a table from a capture log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.dates import date_prefix, epoch_millis_date, feed_date, utc_date
from postmill.functions.html import html_or_blank, html_to_text, json_ld_description
from postmill.functions.pay import (
    bounded_pay, extract_pay, first_bounded_pay, lookup, pay_struct, summary_pay,
)
from postmill.functions.text import first_non_empty, job_hash, join_non_empty, non_empty, or_blank, strip
from postmill.operators.dedup import first_per_key
from postmill.operators.enrich import with_sources
from postmill.operators.ranking import positions_in_folders
from postmill.schema import PAY_DDL, PAYLOAD_TTL_SECONDS, POSTING_FIELDS
from postmill.session import materialise

ITEM_BITS = 24  # items of one payload share the low bits of ``ord``
PAYLOADS = 1 << (63 - ITEM_BITS)

# --- Fixed values: interval names of the platforms -------------------------
ASHBY_INTERVALS = {"1 HOUR": "hourly", "1 WEEK": "weekly", "1 MONTH": "monthly", "1 YEAR": "annual"}
LEVER_INTERVALS = {
    "per-year-salary": "annual", "per-hour-wage": "hourly",
    "per-month-salary": "monthly", "per-week-salary": "weekly",
}
RIPPLING_INTERVALS = {"YEAR": "annual", "MONTH": "monthly", "WEEK": "weekly", "HOUR": "hourly"}
SMART_INTERVALS = {
    "ANNUAL": "annual", "YEARLY": "annual", "MONTHLY": "monthly",
    "WEEKLY": "weekly", "HOURLY": "hourly",
}


@dataclass(frozen=True)
class Board:
    """How one platform's payloads become postings.

    ``items`` names the array inside the listing body (None: the body is the
    array). ``detail_key`` links an item to the request key of its detail.
    ``strict`` fails a source on any malformed or missing body; otherwise such a
    body only costs its own rows or details.
    """

    listing: str
    columns: Callable[[], dict[str, Column]]
    items: str | None = None
    detail: str | None = None
    detail_kind: str = "detail"
    detail_key: str | None = None
    strict: bool = True
    first_page: str | None = None
    unique: str | None = None
    keep: Callable[[], Column] | None = None
    xml: bool = False
    keeps_listing: bool = False


def _parse(body: Column, schema: str, xml: bool = False) -> Column:
    options = {"columnNameOfCorruptRecord": "_bad"}
    if schema.startswith("array"):
        return F.from_json(body, schema, options)
    marked = schema.removesuffix(">") + ",_bad:string>"
    if xml:
        return F.from_xml(body, marked, options)
    return F.from_json(body, marked, options)


def _malformed(parsed: str, schema: str) -> Column:
    broken = F.col(parsed).isNull()
    return broken if schema.startswith("array") else broken | F.col(parsed)["_bad"].isNotNull()


def _item_text(name: str) -> Column:
    return or_blank(F.col("j")[name])


def _html_sections(*parts: Column) -> Column:
    """Text of the non-empty sections, in order, a blank line between them."""
    return F.concat_ws("\n\n", *[html_to_text(non_empty(p)) for p in parts])


def _greenhouse() -> dict[str, Column]:
    j = F.col("j")
    return {
        "title": _item_text("title"),
        "description": html_or_blank(j["content"]),
        "team": F.get(j["departments"], F.lit(0))["name"],
        "location": j["location"]["name"],
        "url": _item_text("absolute_url"),
        "posted": date_prefix(j["updated_at"]),
        "compensation": first_bounded_pay(
            j["pay_input_ranges"], "min_cents", "max_cents", "currency_type",
            cents=True, default_currency="USD",
        ),
    }


def component_pay(components: Column) -> Column:
    """Pay of the first Salary component, with bonus and equity flags folded in."""
    salary = F.get(F.filter(components, lambda c: c["compensationType"] == "Salary"), F.lit(0))

    def has(kind: str) -> Column:
        return F.exists(components, lambda c: F.coalesce(c["compensationType"] == kind, F.lit(False)))

    lo, hi = salary["minValue"].try_cast("double"), salary["maxValue"].try_cast("double")
    return F.when(
        lo.isNotNull() | hi.isNotNull(),
        pay_struct(
            lo, hi, non_empty(salary["currencyCode"]), lookup(salary["interval"], ASHBY_INTERVALS),
            has("EquityPercentage"), has("Bonus"),
        ),
    )


def tier_pay(comp: Column) -> tuple[Column, Column]:
    """(pay, raw text): structured components first, else the tier summary."""
    structured = component_pay(comp["summaryComponents"])
    pay, raw = summary_pay(comp["compensationTierSummary"])
    return F.coalesce(structured, pay), F.when(structured.isNull(), raw)


def _ashby() -> dict[str, Column]:
    j = F.col("j")
    pay, raw = tier_pay(j["compensation"])
    return {
        "title": _item_text("title"),
        "description": _item_text("descriptionPlain"),
        "team": F.coalesce(non_empty(j["department"]), j["team"]),
        "location": j["location"],
        "url": _item_text("jobUrl"),
        "posted": date_prefix(j["publishedAt"]),
        "compensation": pay,
        "compensation_raw": raw,
    }


def _lever() -> dict[str, Column]:
    j = F.col("j")
    return {
        "title": _item_text("text"),
        "description": _item_text("descriptionPlain"),
        "team": j["categories"]["team"],
        "location": j["categories"]["location"],
        "url": _item_text("hostedUrl"),
        "posted": epoch_millis_date(j["createdAt"].try_cast("double")),
        "compensation": bounded_pay(
            j["salaryRange"], "min", "max", "currency",
            lambda r: lookup(r["interval"], LEVER_INTERVALS),
        ),
    }


def _gem() -> dict[str, Column]:
    j = F.col("j")
    return {
        "title": _item_text("title"),
        "description": _item_text("content_plain"),
        "team": F.get(j["departments"], F.lit(0))["name"],
        "location": j["location"]["name"],
        "url": _item_text("absolute_url"),
        "posted": date_prefix(j["first_published_at"]),
    }


def _workable() -> dict[str, Column]:
    j = F.col("j")
    place = j["location"]
    return {
        "title": _item_text("title"),
        "description": html_or_blank(F.col("d")["description"]),
        "team": F.get(j["department"], F.lit(0)),
        "location": join_non_empty(", ", place["city"], place["region"], place["country"]),
        "url": F.concat(
            F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"),
            _item_text("shortcode"), F.lit("/"),
        ),
        "posted": date_prefix(j["published"]),
    }


def _workday() -> dict[str, Column]:
    j, d = F.col("j"), F.col("d")["jobPostingInfo"]
    extra = F.coalesce(d["additionalLocations"], F.array().cast("array<string>"))
    places = F.filter(F.concat(F.array(d["location"]), extra), lambda p: p != "")
    return {
        "title": _item_text("title"),
        "description": html_or_blank(d["jobDescription"]),
        "team": F.lit(None).cast("string"),
        "location": F.coalesce(
            non_empty(F.array_join(F.array_distinct(places), "; ")), j["locationsText"]
        ),
        "url": F.concat(
            F.lit("https://"), "slug", F.lit("."), F.col("extra")["instance"],
            F.lit(".myworkdayjobs.com/"), F.col("extra")["site"], _item_text("externalPath"),
        ),
        "posted": date_prefix(d["startDate"]),
        "pay_from_text": F.lit(True),
    }


def _icims() -> dict[str, Column]:
    j = F.col("j")["data"]
    return {
        "title": or_blank(j["title"]),
        "description": _html_sections(j["description"], j["responsibilities"], j["qualifications"]),
        "team": F.get(j["categories"], F.lit(0))["name"],
        "location": F.coalesce(
            first_non_empty(j["full_location"], j["short_location"]), j["location_name"]
        ),
        "url": F.coalesce(non_empty(j["meta_data"]["canonical_url"]), j["apply_url"], F.lit("")),
        "posted": date_prefix(j["posted_date"]),
        "pay_from_text": F.lit(True),
    }


def _phenom() -> dict[str, Column]:
    j = F.col("j")
    return {
        "title": _item_text("title"),
        "description": html_or_blank(F.col("d")["jobDetail"]["data"]["job"]["description"]),
        "team": F.coalesce(non_empty(j["category"]), j["department"]),
        "location": F.coalesce(non_empty(j["location"]), j["city"]),
        "url": F.concat(F.lit("https://"), "slug", F.lit("/us/en/job/"), _item_text("jobSeqNo")),
        "posted": date_prefix(j["postedDate"]),
        "pay_from_text": F.lit(True),
    }


def _rippling() -> dict[str, Column]:
    d = F.col("d")
    return {
        "title": or_blank(d["name"]),
        "description": _html_sections(d["description"]["role"], d["description"]["company"]),
        "team": F.coalesce(non_empty(d["department"]["name"]), d["department"]["base_department"]),
        "location": F.when(F.size(d["workLocations"]) > 0, F.array_join(d["workLocations"], ", ")),
        "url": or_blank(d["url"]),
        "posted": utc_date(d["createdOn"]),
        "compensation": first_bounded_pay(
            d["payRangeDetails"], "rangeStart", "rangeEnd", "currency",
            interval=lambda r: lookup(r["frequency"], RIPPLING_INTERVALS),
        ),
    }


def _smartrecruiters() -> dict[str, Column]:
    j, d = F.col("j"), F.col("d")
    sections = d["jobAd"]["sections"]
    return {
        "title": _item_text("name"),
        "description": _html_sections(
            sections["jobDescription"]["text"], sections["qualifications"]["text"],
            sections["additionalInformation"]["text"],
        ),
        "team": F.lit(None).cast("string"),
        "location": j["location"]["fullLocation"],
        "url": F.coalesce(
            non_empty(d["postingUrl"]),
            F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), _item_text("id")),
        ),
        "posted": date_prefix(j["releasedDate"]),
        "compensation": bounded_pay(
            d["compensation"], "min", "max", "currency",
            lambda r: lookup(r["period"], SMART_INTERVALS), zero_is_missing=True,
        ),
    }


def _trakstar() -> dict[str, Column]:
    j = F.col("j")
    return {
        "title": _item_text("title"),
        "description": html_or_blank(j["description"]),
        "team": non_empty(j["job:team"]),
        "location": join_non_empty(
            ", ", j["job:locationCity"], j["job:locationState"], j["job:locationCountry"]
        ),
        "url": F.lower(F.replace(_item_text("link"), F.lit("http://"), F.lit("https://"))),
        "posted": feed_date(j["pubDate"]),
    }


def _breezy() -> dict[str, Column]:
    j = F.col("j")
    return {
        "title": _item_text("name"),
        "description": json_ld_description("detail_body"),
        "team": non_empty(j["department"]),
        "location": non_empty(j["location"]["name"]),
        "url": _item_text("url"),
        "posted": date_prefix(j["published_date"]),
    }


def _kula() -> dict[str, Column]:
    j, ats = F.col("j"), F.col("j")["ats_job"]
    place = F.get(ats["offices"], F.lit(0))["location"]
    about = join_non_empty(", ", ats["workplace"], ats["employment_type"])
    return {
        "title": strip(_item_text("title")),
        "description": html_or_blank(
            F.try_element_at(F.col("listing")["refs"], or_blank(ats["job_description"]))
        ),
        "team": non_empty(strip(ats["ats_department"]["name"])),
        "location": F.when(
            about.isNotNull() & non_empty(place).isNotNull(),
            F.concat(place, F.lit(" ("), about, F.lit(")")),
        ).otherwise(F.coalesce(about, place)),
        "url": F.concat(
            F.lit("https://careers.kula.ai/"), "slug", F.lit("/jobs/"), _item_text("id")
        ),
        "posted": F.lit(None).cast("string"),
    }


NAMED = "struct<name:string>"
BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "struct<jobs:array<struct<title:string,content:string,departments:array<struct<name:string>>,"
        "location:struct<name:string>,absolute_url:string,updated_at:string,pay_input_ranges:"
        "array<struct<min_cents:string,max_cents:string,currency_type:string>>>>>",
        _greenhouse, items="jobs",
    ),
    "ashby": Board(
        "struct<jobs:array<struct<title:string,department:string,team:string,descriptionPlain:string,"
        "jobUrl:string,publishedAt:string,location:string,compensation:struct<"
        "compensationTierSummary:string,summaryComponents:array<struct<compensationType:string,"
        "interval:string,currencyCode:string,minValue:string,maxValue:string>>>>>>",
        _ashby, items="jobs",
    ),
    "lever": Board(
        "array<struct<text:string,categories:struct<team:string,location:string>,"
        "descriptionPlain:string,hostedUrl:string,createdAt:string,"
        "salaryRange:struct<min:string,max:string,currency:string,interval:string>>>",
        _lever,
    ),
    "gem": Board(
        "array<struct<title:string,content_plain:string,absolute_url:string,"
        f"departments:array<{NAMED}>,location:{NAMED},first_published_at:string>>",
        _gem,
    ),
    "workable": Board(
        "struct<results:array<struct<shortcode:string,title:string,department:array<string>,"
        "published:string,location:struct<city:string,region:string,country:string>>>>",
        _workable, items="results",
        detail="struct<description:string>", detail_key="shortcode",
    ),
    "workday": Board(
        "struct<jobPostings:array<struct<title:string,externalPath:string,"
        "locationsText:string>>>",
        _workday, items="jobPostings",
        detail="struct<jobPostingInfo:struct<jobDescription:string,startDate:string,"
        "location:string,additionalLocations:array<string>>>",
        detail_key="externalPath", strict=False, unique="externalPath",
    ),
    "icims": Board(
        "struct<jobs:array<struct<data:struct<title:string,description:string,qualifications:string,"
        "responsibilities:string,full_location:string,short_location:string,location_name:string,"
        f"categories:array<{NAMED}>,meta_data:struct<canonical_url:string>,apply_url:string,"
        "posted_date:string>>>>",
        _icims, items="jobs",
    ),
    "phenom": Board(
        "struct<refineSearch:struct<data:struct<jobs:array<struct<title:string,location:string,"
        "city:string,category:string,department:string,jobSeqNo:string,postedDate:string>>>>>",
        _phenom, items="refineSearch.data.jobs",
        detail="struct<jobDetail:struct<data:struct<job:struct<description:string>>>>",
        detail_key="jobSeqNo",
    ),
    "rippling": Board(
        "array<struct<uuid:string>>", _rippling,
        detail="struct<name:string,description:struct<role:string,company:string>,"
        "department:struct<name:string,base_department:string>,workLocations:array<string>,"
        "url:string,payRangeDetails:array<struct<rangeStart:string,rangeEnd:string,"
        "currency:string,frequency:string>>,createdOn:string>",
        detail_key="uuid", unique="uuid",
    ),
    "smartrecruiters": Board(
        "struct<content:array<struct<name:string,id:string,"
        "location:struct<fullLocation:string>,releasedDate:string>>>",
        _smartrecruiters, items="content",
        detail="struct<jobAd:struct<sections:struct<jobDescription:struct<text:string>,"
        "qualifications:struct<text:string>,additionalInformation:struct<text:string>>>,"
        "postingUrl:string,compensation:struct<min:string,max:string,currency:string,period:string>>",
        detail_key="id", strict=False, first_page="offset=0",
    ),
    "trakstar": Board(
        "struct<channel:struct<item:array<struct<title:string,link:string,description:string,"
        "pubDate:string,`job:team`:string,`job:locationCity`:string,`job:locationState`:string,"
        "`job:locationCountry`:string>>>>",
        _trakstar, items="channel.item", xml=True,
    ),
    "breezy": Board(
        f"array<struct<name:string,url:string,department:string,published_date:string,location:{NAMED}>>",
        _breezy, detail_kind="page", detail_key="url",
    ),
    "kula": Board(
        "struct<jobs:array<struct<id:string,title:string,listed:boolean,ats_job:struct<"
        f"job_description:string,ats_department:{NAMED},offices:array<struct<location:string>>,"
        "workplace:string,employment_type:string>>>,refs:map<string,string>>",
        _kula, items="jobs", keeps_listing=True, keep=lambda: F.coalesce(F.col("j")["listed"], F.lit(True)),
    ),
}


def _item_type(board: Board, listings: DataFrame) -> T.DataType:
    """Type of one listing item, as the body schema has it."""
    column = "listing" if board.items is None else f"listing.{board.items}"
    return listings.select(F.col(column).alias("j")).schema["j"].dataType.elementType


def _listed(board: Board, mine: DataFrame) -> DataFrame:
    """One row per listing item, and one row with an error per broken body.

    A broken body of a lenient platform only loses its own items.
    """
    listings = mine.filter("kind = 'listing'").withColumn(
        "listing", _parse(F.col("body"), board.listing, board.xml)
    )
    bad = _malformed("listing", board.listing)
    if board.listing.startswith("array"):
        # An object where a list is due is an error message, not a list of one.
        bad = bad | ~F.coalesce(F.startswith(F.ltrim("body"), F.lit("[")), F.lit(False))
    items = F.col("listing") if board.items is None else F.col(f"listing.{board.items}")
    element = _item_type(board, listings)
    entry = T.StructType([
        T.StructField("error", T.StringType()), T.StructField("at", T.IntegerType()),
        T.StructField("j", element),
    ])
    error = F.concat(F.lit("malformed listing "), "request_key")
    fatal = F.lit(board.strict)
    if board.first_page is not None:
        fatal = F.contains("request_key", F.lit(board.first_page))
    broken = F.array(F.struct(error.alias("error"), F.lit(-1).alias("at"), F.lit(None).cast(element).alias("j")))
    good = F.transform(
        items, lambda j, at: F.struct(F.lit(None).cast("string").alias("error"), at.alias("at"), j.alias("j"))
    )
    rows = F.when(bad & fatal, broken.cast(T.ArrayType(entry))).when(~bad, good.cast(T.ArrayType(entry)))
    carried = ["source", "slug", "name", "extra", "ord"]
    if board.keeps_listing:
        carried.append("listing")
    # The outer form keeps the bodies from being parsed twice, once to see
    # whether they hold any item.
    found = listings.select(*carried, F.explode_outer(rows).alias("r")).filter("r is not null")
    out = found.select(*carried, "r.error", "r.at", "r.j")
    fits = F.col("ord").between(0, PAYLOADS - 1)
    high = F.when(fits, F.shiftleft("ord", ITEM_BITS)).otherwise(F.raise_error(F.lit("payloads are not numbered densely")))
    return out.withColumn("ord", high + F.col("at")).drop("at")


def _with_details(board: Board, rows: DataFrame, mine: DataFrame) -> DataFrame:
    """Listing items with their detail; a strict platform needs every one."""
    details = mine.filter(F.col("kind") == board.detail_kind)
    keys = ["source", "request_key"]
    if board.detail is None:
        found = details.select(*keys, F.col("body").alias("detail_body"), F.lit(False).alias("_bad"))
    else:
        # Only what the postings need is shuffled: the parsed body, not the text.
        parsed = details.select(*keys, _parse(F.col("body"), board.detail).alias("d"))
        bad = _malformed("d", board.detail)
        found = parsed.select(*keys, F.when(~bad, F.col("d").dropFields("_bad")).alias("d"), bad.alias("_bad"))
    joined = rows.withColumn("request_key", _item_text(board.detail_key)).join(found, keys, "left")
    if not board.strict:
        return joined
    failed = F.when(F.col("_bad").isNull(), "missing detail ").when(F.col("_bad"), "malformed detail ")
    return joined.withColumn("error", F.coalesce("error", F.concat(failed, "request_key")))


def normalize(
    platform: str, payloads: DataFrame, sources: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(postings, errors) of one platform.

    ``errors`` has one row per failed source, and a failed source contributes no
    postings at all. Bodies are parsed in one pass whose rows, good and failed,
    are stored before they are separated.
    """
    board = BOARDS.get(platform)
    if board is None:
        raise ValueError(f"unknown platform: {platform}")
    mine = with_sources(payloads.filter(F.col("platform") == platform), sources, None).withColumn(
        "source", F.concat(F.lit(f"{platform}:"), "slug")
    )
    rows = _listed(board, mine)
    if board.keep is not None:
        rows = rows.filter(F.col("error").isNotNull() | board.keep())
    if board.unique is not None:
        rows = first_per_key(
            rows, [F.col("source"), F.col("error"), _item_text(board.unique)], [F.col("ord")]
        )
    if board.detail_key is not None:
        rows = _with_details(board, rows, mine)
    parsed = materialise(_project(board, rows), "parsed")
    errors = (
        parsed.filter("error is not null").groupBy("source").agg(F.min("error").alias("error"))
    )
    postings = parsed.filter("error is null").join(errors.select("source"), "source", "left_anti")
    return postings.select(*POSTING_FIELDS), errors


def _project(board: Board, rows: DataFrame) -> DataFrame:
    columns = board.columns()
    from_text = columns.pop("pay_from_text", None) is not None
    out = rows.select("error", "source", F.col("name").alias("company"), "ord",
                      *[c.alias(n) for n, c in columns.items()])
    if from_text:
        out = out.withColumn("compensation", extract_pay("description"))
    for column, kind in (("compensation", PAY_DDL), ("compensation_raw", "string")):
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None).cast(kind))
    return out.withColumn("hash", job_hash("title", "company", "description")).withColumn(
        "last_seen_at", F.lit("")
    )


def live_payloads(
    log: DataFrame, sources: DataFrame, as_of: float, ttl: float | None = PAYLOAD_TTL_SECONDS
) -> DataFrame:
    """Current body per request of a capture log, expired captures dropped.

    A source's own ttl in the registry beats the general one.
    """
    keys = ["platform", "slug", "kind", "request_key"]
    known = with_sources(log, sources, ttl)
    age = F.lit(float(as_of)) - F.col("fetched_at")
    live = known.filter(~F.coalesce(age > F.col("cache_ttl"), F.lit(False)))
    # The winner of a request is found without its body.
    won = live.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max("ord").alias("_last"), F.min("ord").alias("_first")
    )
    same = F.col("ord") == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return live.join(won, same).select(*keys, "body", "fetched_at", F.col("_first").alias("ord"))


def collect(
    payloads: DataFrame, sources: DataFrame, platforms: list[str] | None = None,
    custom: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(postings, errors) over all platforms plus custom postings.

    The payloads are numbered densely in their order, so that ``ord`` has room for the
    items, and stored in folders by platform and kind, of which a platform reads its own.
    """
    columns = payloads.columns
    order = ["ord", "platform", "slug", "kind", "request_key"]
    lines = payloads.withColumnRenamed("ord", "_line")
    payloads = positions_in_folders(
        lines, ["_line", *order[1:]], ["platform", "kind"], "body", "ord", start=0
    ).select(columns)
    postings, errors = custom, None
    for platform in platforms or sorted(BOARDS):
        p, e = normalize(platform, payloads, sources)
        postings = p if postings is None else postings.unionByName(p)
        errors = e if errors is None else errors.unionByName(e)
    return postings, errors
