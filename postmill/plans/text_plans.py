"""Queries on scalar functions and text-match predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates, html, match, pay, text
from postmill.operators.dedup import counted_stages, dedup_first, select_universe, stage_counts
from postmill.operators.state import store_place
from postmill.operators.report import parse_score
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.session import fresh_path
from postmill.schema import FIT_FIELDS, INTEREST_FIELDS

NOW = "TIMESTAMP '2026-04-19 12:00:00'"


@query("sca2_short_key", "SELECT ord, sha256(description)[1:16] AS short_key FROM v_postings", ("v_postings",))
def short_key(spark, sf):
    return v.postings(spark, sf).select("ord", text.short_key("description").alias("short_key"))


@query("sca3_canonicalize", """
    SELECT ord, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM v_postings""",
       ("v_postings",))
def canonicalize(spark, sf):
    return v.postings(spark, sf).select("ord", text.canonicalize("title").alias("slug"))


@query("sca4_company_key", f"""
    SELECT c_custkey AS k, lower(trim('  ' || c_name || chr(10), '{v.WS}')) AS company_key FROM customer""")
def company_key(spark, sf):
    c = v.table(spark, sf, "customer")
    name = F.concat(F.lit("  "), "c_name", F.lit("\n"))
    return c.select(F.col("c_custkey").alias("k"), text.company_key(name).alias("company_key"))


SQL_SUFFIX = """CASE {i} WHEN 'annual' THEN '/yr' WHEN 'hourly' THEN '/hr' WHEN 'monthly' THEN '/mo'
    WHEN 'weekly' THEN '/wk' ELSE '' END"""
SQL_PREFIX = "CASE WHEN {c} IS NULL THEN '' WHEN {c} = 'USD' THEN '$' ELSE {c} || ' ' END"


def sql_amount(n: str, thousands: str) -> str:
    return (f"CASE WHEN {thousands} THEN format('{{:,}}', ({n} + 500) // 1000) || 'k' "
            f"ELSE format('{{:,}}', {n}) END")


def sql_pay_text(p: str = "compensation", raw: str = "compensation_raw") -> str:
    lo, hi, c = f"{p}.min_amount", f"{p}.max_amount", f"{p}.currency"
    k = f"(coalesce({lo}, {hi}) >= 1000 AND coalesce({hi}, {lo}) >= 1000)"
    prefix, suffix = SQL_PREFIX.format(c=c), SQL_SUFFIX.format(i=f"{p}.interval")
    low, high = sql_amount(lo, k), sql_amount(hi, k)
    return f"""CASE WHEN {p} IS NULL THEN {raw} ELSE
      CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL
             THEN {prefix} || ({low}) || chr(8211) || (CASE WHEN {c} = 'USD' THEN '$' ELSE '' END) || ({high})
           WHEN {lo} IS NOT NULL THEN {prefix} || ({low}) || '+'
           WHEN {hi} IS NOT NULL THEN 'up to ' || {prefix} || ({high}) ELSE '' END
      || {suffix}
      || CASE WHEN {p}.equity AND {p}.bonus THEN ' (+equity, +bonus)' WHEN {p}.equity THEN ' (+equity)'
              WHEN {p}.bonus THEN ' (+bonus)' ELSE '' END END"""


@query("sca5_format_amount", f"""
    SELECT ord, CASE WHEN compensation.min_amount IS NULL THEN '' ELSE
      {SQL_PREFIX.format(c='compensation.currency')} ||
      ({sql_amount('compensation.min_amount', 'compensation.min_amount >= 1000')}) ||
      {SQL_SUFFIX.format(i='compensation.interval')} END AS amount FROM v_postings""", ("v_postings",))
def format_amount(spark, sf):
    c = F.col("compensation")
    shown = pay.format_amount(c["min_amount"], c["currency"], c["interval"])
    return v.postings(spark, sf).select("ord", shown.alias("amount"))


@query("sca6_format_pay", f"SELECT ord, coalesce({sql_pay_text()}, '') AS pay FROM v_postings", ("v_postings",))
def format_pay(spark, sf):
    shown = pay.format_pay("compensation", "compensation_raw")
    return v.postings(spark, sf).select("ord", F.coalesce(shown, F.lit("")).alias("pay"))


# Sentences over part prices: the anchor, the amounts and the interval vary.
SENTENCE_SQL = """
    SELECT p_partkey AS ord, lo, hi, kind, p_name || '. The ' ||
      CASE p_partkey % 4 WHEN 0 THEN 'base salary range' WHEN 1 THEN 'Pay Range' WHEN 2 THEN 'compensation: '
        ELSE 'reward' END
      || ' for a ' || p_type || ' is $' || format('{:,}', lo) || CASE WHEN p_size % 2 = 0 THEN ' - ' ELSE ' to ' END
      || '$' || format('{:,}', hi)
      || CASE kind WHEN 0 THEN ' per hour' WHEN 1 THEN ' (per year)' WHEN 2 THEN ' (weekly)' ELSE '.' END
      || ' ' || repeat('x', p_size) AS sentence
    FROM (SELECT *, p_size % 4 AS kind,
            CAST(floor(p_retailprice) AS BIGINT) * CASE WHEN p_size % 4 = 0 THEN 1 ELSE 50 END AS lo,
            CAST(floor(p_retailprice) AS BIGINT) * CASE WHEN p_size % 4 = 0 THEN 1 ELSE 50 END
              + p_size * 100 - 300 AS hi FROM part)"""


def sentences(spark, sf):
    p = v.table(spark, sf, "part")
    kind, size = F.col("p_size") % 4, F.col("p_size")
    lo = (F.floor("p_retailprice") * F.when(kind == 0, 1).otherwise(50)).cast("bigint")
    hi = (lo + size * 100 - 300).cast("bigint")
    anchor = (
        F.when(F.col("p_partkey") % 4 == 0, "base salary range").when(F.col("p_partkey") % 4 == 1, "Pay Range")
        .when(F.col("p_partkey") % 4 == 2, "compensation: ").otherwise("reward")
    )
    tail = F.when(kind == 0, " per hour").when(kind == 1, " (per year)").when(kind == 2, " (weekly)").otherwise(".")
    return p.select(F.col("p_partkey").alias("ord"), F.concat(
        "p_name", F.lit(". The "), anchor, F.lit(" for a "), "p_type", F.lit(" is $"), F.format_number(lo, 0),
        F.when(size % 2 == 0, " - ").otherwise(" to "), F.lit("$"), F.format_number(hi, 0), tail, F.lit(" "),
        F.repeat(F.lit("x"), size),
    ).alias("sentence"))


PAY_SQL = f"""
    SELECT ord, lo AS min_amount, hi AS max_amount,
      CASE WHEN said = 'hourly' AND lo > 1000 THEN 'annual' ELSE said END AS pay_interval
    FROM (SELECT *, CASE kind WHEN 0 THEN 'hourly' WHEN 1 THEN 'annual' WHEN 2 THEN 'weekly'
            ELSE CASE WHEN lo < 1000 THEN 'hourly' ELSE 'annual' END END AS said FROM ({SENTENCE_SQL}))
    WHERE ord % 4 <> 3 AND hi >= lo AND hi <= 10000000 AND NOT (said = 'annual' AND hi < 10000)"""


@query("sca7_pay_from_text", PAY_SQL)
def pay_from_text(spark, sf):
    found = sentences(spark, sf).select("ord", pay.extract_pay("sentence").alias("p")).filter("p is not null")
    return found.select("ord", "p.min_amount", "p.max_amount", F.col("p.interval").alias("pay_interval"))


@query("sca7_pay_from_documents", """
    SELECT doc_id, lo AS min_amount, hi AS max_amount FROM (
      SELECT doc_id, 20000 + n_chars AS lo, 20000 + 4 * n_chars AS hi FROM documents)""")
def pay_from_documents(spark, sf):
    d = v.texts(spark, sf, "documents")
    lo, hi = F.lit(20000) + F.col("n_chars"), F.lit(20000) + 4 * F.col("n_chars")
    posting = F.concat(
        "text", F.lit("\nThe base salary range here is $"), F.format_number(lo, 0), F.lit(" - $"),
        F.format_number(hi, 0), F.lit(" per year.\n"), "text",
    )
    found = d.select("doc_id", pay.extract_pay(posting).alias("p"))
    return found.select("doc_id", "p.min_amount", "p.max_amount")


WORDS_SQL = " ".join(
    f"WHEN {' OR '.join(f'contains(lower(w), {chr(39)}{word}{chr(39)})' for word in words)} THEN '{name}'"
    for name, words in pay.TEXT_INTERVALS
)
WINDOW_SQL = """SELECT o_orderkey AS ord, CAST(floor(o_totalprice) AS BIGINT) AS low,
    CASE o_orderkey % 5 WHEN 0 THEN 'Annual, per HOUR ' WHEN 1 THEN 'per year weekly ' WHEN 2 THEN '/mo. '
      WHEN 3 THEN 'a year ' ELSE '' END || o_orderpriority AS w FROM orders"""


@query("sca8_interval_inference", f"""
    SELECT ord, CASE {WORDS_SQL} ELSE CASE WHEN low < 1000 THEN 'hourly' ELSE 'annual' END END AS pay_interval
    FROM ({WINDOW_SQL})""")
def interval_inference(spark, sf):
    o = v.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    said = (
        F.when(k == 0, "Annual, per HOUR ").when(k == 1, "per year weekly ").when(k == 2, "/mo. ")
        .when(k == 3, "a year ").otherwise("")
    )
    return o.select(
        F.col("o_orderkey").alias("ord"),
        pay.infer_interval(F.concat(said, "o_orderpriority"), F.floor("o_totalprice")).alias("pay_interval"),
    )


def sql_time_ago(seconds: str) -> str:
    def words(n: str, unit: str) -> str:
        return f"({n}) || ' {unit}' || CASE WHEN ({n}) = 1 THEN '' ELSE 's' END || ' ago'"

    days = f"({seconds} // 86400)"
    return f"""CASE WHEN {seconds} < 3600 THEN {words(f'greatest({seconds} // 60, 1)', 'min')}
      WHEN {seconds} < 86400 THEN {words(f'{seconds} // 3600', 'hour')}
      WHEN {days} < 7 THEN {words(days, 'day')} WHEN {days} < 30 THEN {words(f'{days} // 7', 'week')}
      WHEN {days} < 365 THEN {words(f'{days} // 30', 'month')} ELSE {words(f'{days} // 365', 'year')} END"""


@query("sca9_time_ago", f"""
    SELECT event_id, {sql_time_ago('s')} AS ago FROM (
      SELECT event_id, CAST(trunc(epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events)""")
def time_ago(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", dates.time_ago(F.col("ts").cast("string"), "2024-01-30T00:00:00").alias("ago"))


@query("sca9_posted_ago", f"""
    SELECT ord, {sql_time_ago('s')} AS ago FROM (
      SELECT ord, CAST(epoch({NOW}) - epoch(CAST(posted AS TIMESTAMP)) AS BIGINT) AS s FROM v_postings)""",
       ("v_postings",))
def posted_ago(spark, sf):
    return v.postings(spark, sf).select("ord", dates.time_ago("posted", v.AS_OF).alias("ago"))


@query("sca10_epoch", """
    SELECT ord, CAST(epoch(CAST(last_seen_at AS TIMESTAMP)) AS BIGINT) AS seen, CAST(0 AS BIGINT) AS none FROM v_postings""",
       ("v_postings",))
def epoch(spark, sf):
    return v.postings(spark, sf).select(
        "ord", dates.epoch("last_seen_at").alias("seen"), dates.epoch("source").alias("none")
    )


@query("sca11_recent_flag", f"""
    SELECT ord, floor((epoch({NOW}) - epoch(CAST(posted AS TIMESTAMP))) / 86400) < 7 AS recent FROM v_postings""",
       ("v_postings",))
def recent_flag(spark, sf):
    return v.postings(spark, sf).select("ord", dates.is_recent("posted", v.AS_OF).alias("recent"))


@query("sca15_parse_iso", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS wall FROM events""")
def parse_iso(spark, sf):
    e = v.table(spark, sf, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return e.select("event_id", F.date_format(dates.parse_iso(stamp), "yyyy-MM-dd HH:mm").alias("wall"))


@query("sca16_dates", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS prefix, strftime(ts, '%Y-%m-%d') AS from_millis,
      strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d') AS utc, strftime(ts, '%Y-%m-%d') AS feed FROM events""")
def date_forms(spark, sf):
    e = v.table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    feed = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0530"))
    return e.select(
        "event_id", dates.date_prefix(iso).alias("prefix"), dates.epoch_millis_date(millis).alias("from_millis"),
        dates.utc_date(F.concat(iso, F.lit("+05:30"))).alias("utc"), dates.feed_date(feed).alias("feed"),
    )


@query("sca17_joined_parts", """
    SELECT p_partkey, concat_ws(', ', nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, ''), p_brand) AS place
    FROM part""")
def joined_parts(spark, sf):
    p = v.table(spark, sf, "part")
    first = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return p.select("p_partkey", text.join_non_empty(", ", first, F.lit(""), "p_brand").alias("place"))


@query("prj1_clip", """
    SELECT ord, length(left(description, 16000)) AS feature_chars, length(left(description, 8000)) AS listing_chars,
      sha256(left(description, 8000)) AS digest FROM v_postings""", ("v_postings",))
def clip(spark, sf):
    feature, listing = (text.clip("description", n) for n in (text.FEATURE_CHARS, text.LISTING_CHARS))
    return v.postings(spark, sf).select(
        "ord", F.length(feature).cast("bigint").alias("feature_chars"),
        F.length(listing).cast("bigint").alias("listing_chars"), F.sha2(listing, 256).alias("digest"),
    )


META_SQL = f"concat_ws(' ', title, company, nullif(location, ''), nullif(team, ''), nullif({sql_pay_text()}, ''))"


@query("prj2_meta_text", f"SELECT ord, {META_SQL} AS meta FROM v_postings", ("v_postings",))
def meta_text(spark, sf):
    shown = pay.format_pay("compensation", "compensation_raw")
    return v.postings(spark, sf).select(
        "ord", text.meta_text("title", "company", "location", "team", shown).alias("meta")
    )


LISTING_SQL = f"""'**' || title || '** at **' || company || '**' || chr(10) || 'Location: ' || location || chr(10)
    || 'Compensation: ' || coalesce({sql_pay_text()}, 'Not specified') || chr(10) || 'Team: '
    || coalesce(team, 'Not specified') || chr(10) || chr(10) || description"""


@query("prj3_listing_text", f"SELECT ord, sha256({LISTING_SQL}) AS digest FROM v_postings", ("v_postings",))
def listing_text(spark, sf):
    return v.postings(spark, sf).select("ord", F.sha2(text.listing_text(), 256).alias("digest"))


@query("prj5_score_document", """
    SELECT doc_id, CAST(quality * 60 + doc_id % 41 AS INTEGER) AS interest, CAST(doc_id % 51 AS INTEGER) AS fit
    FROM labels WHERE toxic = 0""")
def score_document(spark, sf):
    labels = v.table(spark, sf, "labels")
    words = [F.lit(f"about {f}").alias(f) for f in INTEREST_FIELDS]
    interest = F.struct(*words, (F.col("quality") * 60 + F.col("doc_id") % 41).cast("int").alias("score"))
    # A toxic row lacks one required field, so its document is dropped.
    last = F.when(F.col("toxic") == 0, F.lit("fine")).alias(FIT_FIELDS[-1])
    fit = F.struct(
        *[F.lit("x").alias(f) for f in FIT_FIELDS[:-1]], last, (F.col("doc_id") % 51).cast("int").alias("score")
    )
    document = F.to_json(F.struct(interest.alias("interest"), fit.alias("fit")))
    parsed = labels.select("doc_id", parse_score(document).alias("s")).filter("s is not null")
    return parsed.select("doc_id", F.col("s.interest.score").alias("interest"), F.col("s.fit.score").alias("fit"))


# --- HTML ------------------------------------------------------------------

PAGE_TEXT_SQL = r"""
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(
        regexp_replace(regexp_replace(regexp_replace(u,
          '<!--.*?-->', chr(1), 'gs'), '(?i)<(script|style|template)\b[^>]*>.*?</(script|style|template)\s*>', chr(1), 'gs'),
          '<[a-zA-Z/!][^>]*>', chr(1), 'gs'), chr(1)),
        lambda x: trim(x, '{ws}')), lambda x: x <> ''), chr(10)) AS page_text
    FROM (SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)),
            '&amp;', '&') AS u FROM pages)"""


@query("htm1_page_text", PAGE_TEXT_SQL.replace("{ws}", v.WS))
def page_text(spark, sf):
    pages = v.texts(spark, sf, "pages")
    return pages.select("page_id", html.html_to_text("html").alias("page_text"))


@query("htm2_json_ld", f"""
    SELECT doc_id, sha256(trim(text, '{v.WS}')) AS digest FROM documents""")
def json_ld(spark, sf):
    d = v.texts(spark, sf, "documents")
    # Escaped twice, once for the markup and once for the feed that holds it.
    escaped = F.col("text")
    for _ in range(2):
        escaped = F.replace(F.replace(escaped, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), escaped.alias("description")))
    page = F.concat(
        F.lit('<html><script type="application/ld+json">{oops</script>'
              '<script type="application/ld+json">{"@type":"Place","description":"no"}</script>'
              '<script type="application/ld+json">'),
        block, F.lit("</script></html>"),
    )
    return d.select("doc_id", F.sha2(html.json_ld_description(page), 256).alias("digest"))


# --- text match ------------------------------------------------------------

W = r"\p{L}\p{N}\p{Co}"


def sql_match(body: str, cols=match.COLUMNS, start: str = f"(^|[^{W}])", end: str = f"([^{W}]|$)") -> str:
    return "(" + " OR ".join(
        f"regexp_matches(strip_accents(lower({c})), '{start}{body}{end}')" for c in cols
    ) + ")"


def matched(spark, sf, predicate):
    return v.postings(spark, sf).filter(predicate).select("ord", "hash")


def match_query(name: str, sql: str, predicate) -> None:
    """Register a predicate over whole postings against its regular expression."""

    @query(name, f"SELECT ord, hash FROM v_postings WHERE {sql}", ("v_postings",))
    def run(spark, sf):
        return matched(spark, sf, predicate())


GAP = f"[^{W}]+"
match_query("mat1_term", sql_match("etre"), lambda: match.term("Être"))
match_query("mat1_term_in_column", sql_match("de", ("location",)), lambda: match.term("DE", "location"))
match_query("mat2_phrase", sql_match(f"of{GAP}the"), lambda: match.phrase("of the"))
match_query("mat3_prefix", sql_match("thea", end=""), lambda: match.prefix("thea"))
match_query("mat3_phrase_prefix", sql_match(f"the{GAP}an", end=""), lambda: match.phrase("the an", prefix=True))
match_query("mat4_initial", sql_match("the", ("title",), start=f"^[^{W}]*"), lambda: match.initial("the", "title"))
_ten = f"({GAP}[{W}]+){{0,10}}{GAP}"
match_query(
    "mat5_near", f"({sql_match(f'with{_ten}only', ('description',))} OR {sql_match(f'only{_ten}with', ('description',))})",
    lambda: match.near(["with", "only"], 10, "description"),
)
match_query(
    "mat6_boolean",
    f"(({sql_match('the')} AND {sql_match('(src1|en)')}) OR {sql_match('und')}) AND NOT {sql_match('nicht')}",
    lambda: ((match.term("the") & match.any_of([match.term("src1"), match.term("en")])) | match.term("und"))
    & ~match.term("nicht"),
)
match_query("mat6_adjacent_words", f"{sql_match('the')} AND {sql_match('nation')} AND {sql_match('en')}",
            lambda: match.words("the nation en"))
match_query("mat7_folding", sql_match(f"c{GAP}ndre", end="") + " OR " + sql_match("eon"), lambda: match.any_of(
    [match.phrase("c++ ndre", prefix=True), match.term("ÉÓN")]))


@query("mat8_empty_query", "SELECT ord, hash FROM v_postings", ("v_postings",))
def empty_query(spark, sf):
    return match.matching(v.postings(spark, sf), None).select("ord", "hash")


match_query("prj6_keyword_lines", f"{sql_match('avec')} OR {sql_match('nicht')}", lambda: match.any_of(
    [match.term(line) for line in match.keyword_lines("# languages\n\navec\n  nicht  \n")]))


#: Forty terms of four languages, looked for together.
MANY = {
    "en": ("the", "of", "and", "with", "by", "for", "that", "this", "was", "has"),
    "fr": ("le", "la", "les", "des", "une", "dans", "pour", "avec", "sur", "pas"),
    "de": ("der", "die", "das", "und", "nicht", "ein", "mit", "von", "ist", "auf"),
    "es": ("el", "los", "las", "una", "por", "con", "para", "que", "del", "como"),
}


def _many_sql(language: str) -> str:
    return "(" + " OR ".join(sql_match(t) for t in MANY[language]) + ")"


@query("mat6_prj6_many_keywords", f"""
    SELECT ord, hash FROM v_postings WHERE ({_many_sql('en')} AND NOT {_many_sql('fr')})
      OR ({sql_match('der')} AND {sql_match('nicht')} AND NOT {_many_sql('en')})
      OR ({_many_sql('es')} AND NOT {sql_match('una')} AND {sql_match('es', ('location',))})""", ("v_postings",))
def many_keywords(spark, sf):
    known = match.Keywords([t for terms in MANY.values() for t in terms] + ["es"])

    def tree(has):
        any_in = {k: match.any_of([has(t) for t in terms]) for k, terms in MANY.items()}
        return (
            (any_in["en"] & ~any_in["fr"])
            | (has("der") & has("nicht") & ~any_in["en"])
            | (any_in["es"] & ~has("una") & has("es", "location"))
        )

    return matched(spark, sf, known.predicate(tree))


match_query("prj6_any_keyword", f"{sql_match('avec')} OR {sql_match(f'of{GAP}the')} OR {sql_match('nicht')}",
            lambda: match.any_phrase(["avec", "of the", "NICHT"]))


UNIVERSE_SQL = f"""
    , unique_rows AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY title, company, team, description ORDER BY ord) AS rn
        FROM v_postings) WHERE rn = 1),
    kept AS (SELECT * FROM unique_rows WHERE {sql_match('the')}),
    forced AS (SELECT * FROM unique_rows WHERE {sql_match('der')})
    SELECT hash, ord, FALSE AS only_forced FROM kept
    UNION ALL SELECT hash, ord, TRUE FROM forced WHERE hash NOT IN (SELECT hash FROM kept)"""


@query("set1_universe", UNIVERSE_SQL, ("v_postings",))
def universe(spark, sf):
    chosen, _ = select_universe(v.postings(spark, sf), match.term("the"), match.term("der"))
    return chosen.select("hash", "ord", "only_forced")


@query("set1_forced", UNIVERSE_SQL.split("SELECT hash, ord, FALSE")[0] + "SELECT hash, ord FROM forced",
       ("v_postings",))
def forced_rows(spark, sf):
    return select_universe(v.postings(spark, sf), match.term("the"), match.term("der"))[1].select("hash", "ord")


@query("set1_fresh_wins", f"""
    SELECT hash, ord FROM (
        SELECT *, row_number() OVER (PARTITION BY title, company, team, description
                                     ORDER BY CAST(last_seen_at AS TIMESTAMP) DESC NULLS LAST, ord) AS rn
        FROM v_postings) WHERE rn = 1 AND {sql_match('the')}""", ("v_postings",))
def fresh_wins(spark, sf):
    chosen, _ = select_universe(v.postings(spark, sf), match.term("the"), order=store_place())
    return chosen.select("hash", "ord")


@query("agg9_filter_counts", f"""
    , unique_rows AS (SELECT DISTINCT ON (title, company, team, description) * FROM v_postings)
    SELECT (SELECT count(*) FROM v_postings) AS total, count(*) AS unique_rows,
           count(*) FILTER (WHERE {sql_match('the')}) AS matched FROM unique_rows""", ("v_postings",))
def filter_counts(spark, sf):
    return stage_counts(v.postings(spark, sf), match.term("the"))


@query("agg9_observed_counts", f"""
    , unique_rows AS (SELECT DISTINCT ON (title, company, team, description) * FROM v_postings)
    SELECT (SELECT count(*) FROM v_postings) AS total, count(*) AS unique_rows,
           count(*) FILTER (WHERE {sql_match('the')}) AS matched FROM unique_rows""", ("v_postings",))
def observed_counts(spark, sf):
    """The counts of `agg9_filter_counts`, taken while the selection is written."""
    chosen, counted = counted_stages(v.postings(spark, sf), match.term("the"))
    chosen.write.parquet(fresh_path(spark, "selection"))
    n = counted.counts()
    return spark.range(1).select(*[F.lit(n[s]).cast("long").alias(s) for s in ("total", "unique_rows", "matched")])
