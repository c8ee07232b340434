"""Queries on joins, contacts, cached results, orders, pages and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postmill.functions.text import listing_text, short_key
from postmill.models import surrogate
from postmill.models.learning import to_examples
from postmill.operators import enrich, ranking, report
from postmill.operators.dedup import dedup_first, unscored
from postmill.operators.state import fold_status, empty_status
from postmill.functions import match
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.plans.text_plans import LISTING_SQL, SQL_PREFIX, SQL_SUFFIX, sql_amount, sql_match, sql_pay_text, sql_time_ago
from postmill.session import fresh_path
from postmill.sources import readers, sinks
from postmill.sources.tables import Folder

NOW = "TIMESTAMP '2026-04-19 12:00:00'"


@query("jon3_scored_postings", """
    SELECT p.hash, p.ord, interest_score, fit_score FROM v_postings p JOIN v_scores USING (hash)""",
       ("v_postings", "v_scores"))
def scored(spark, sf):
    return report.scored_postings(v.postings(spark, sf), v.scores(spark, sf)).select(
        "hash", "ord", "interest_score", "fit_score"
    )


@query("flt2_unscored", """
    SELECT hash, ord FROM v_postings WHERE hash NOT IN (SELECT hash FROM v_scores)""", ("v_postings", "v_scores"))
def not_scored(spark, sf):
    return unscored(v.postings(spark, sf), v.scores(spark, sf)).select("hash", "ord")


@query("prj4_examples", f"""
    SELECT p.hash, p.ord, title, company, location, coalesce({sql_pay_text('p.compensation', 'p.compensation_raw')}, '') AS comp,
      interest_score, fit_score FROM v_postings p JOIN v_scores USING (hash)""", ("v_postings", "v_scores"))
def examples(spark, sf):
    return to_examples(v.postings(spark, sf), v.scores(spark, sf)).select(
        "hash", "ord", "title", "company", "location", F.coalesce("comp", F.lit("")).alias("comp"),
        "interest_score", "fit_score",
    )


@query("jon4_context", """
    SELECT p.ord, coalesce(content, '') AS context FROM v_postings p
    LEFT JOIN v_context ON canonical = trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-')""",
       ("v_postings", "v_context"))
def with_context(spark, sf):
    return enrich.with_context(v.postings(spark, sf), v.context(spark, sf)).select("ord", "context")


def contacts(spark, sf):
    first = enrich.first_degree(v.first_contacts(spark, sf))
    return first, enrich.second_degree(v.network_contacts(spark, sf), first)


@query("agg4_first_degree", "SELECT company_key, ord, name, url FROM v_first", ("v_first",))
def first_degree(spark, sf):
    return enrich.first_degree(v.first_contacts(spark, sf))


@query("ded3_second_degree", "SELECT * FROM v_second", ("v_second",))
def second_degree(spark, sf):
    return contacts(spark, sf)[1]


@query("agg5_second_degree_groups", """
    SELECT company_key, person, via_name, via_url, count(*) AS connections FROM v_second GROUP BY ALL""",
       ("v_second",))
def second_degree_groups(spark, sf):
    return enrich.second_degree_groups(contacts(spark, sf)[1])


@query("jon7_known_urls_left_out", """
    SELECT c_custkey AS ord FROM customer WHERE 'https://p/' || (c_custkey // 2) NOT IN (SELECT url FROM v_first)""",
       ("v_first",))
def known_urls_left_out(spark, sf):
    first = enrich.first_degree(v.first_contacts(spark, sf))
    return enrich.not_known(v.network_contacts(spark, sf), first).select("ord")


@query("jon5_jon6_contact_counts", """
    SELECT p.ord, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM v_postings p
    LEFT JOIN (SELECT company_key, count(*) AS n1 FROM v_first GROUP BY 1) a ON a.company_key = lower(company)
    LEFT JOIN (SELECT company_key, count(*) AS n2 FROM v_second GROUP BY 1) b ON b.company_key = lower(company)""",
       ("v_postings", "v_first", "v_second"))
def contact_counts(spark, sf):
    return enrich.with_contacts(v.postings(spark, sf), *contacts(spark, sf)).select("ord", "n1", "n2")


@query("jon5_jon6_contacts_of_page", """
    , page AS (SELECT DISTINCT lower(company) AS k FROM (SELECT * FROM v_postings ORDER BY ord LIMIT 50))
    SELECT company_key, 1 AS degree, '' AS via, ord, name, url FROM v_first WHERE company_key IN (SELECT k FROM page)
    UNION ALL
    SELECT company_key, 2, via_name, ord, name, url FROM v_second WHERE company_key IN (SELECT k FROM page)""",
       ("v_postings", "v_first", "v_second"))
def contacts_of_page(spark, sf):
    shown = ranking.page(v.postings(spark, sf), 0, ["ord"], key="ord")
    return enrich.contacts_of(shown, *contacts(spark, sf)).select(
        "company_key", "degree", F.coalesce("via_name", F.lit("")).alias("via"), "ord", "name", "url"
    )


@query("src4_contact_exports", """
    SELECT c_custkey AS k, 'First ' || c_custkey || chr(160) || c_name AS name, 'https://p/' || c_custkey AS url,
      c_mktsegment || ', "Inc"' AS company FROM customer WHERE c_acctbal > 0""")
def contact_exports(spark, sf):
    c = v.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    url = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://p/"), key)).otherwise("")
    content = F.concat(
        F.lit('\ufeffNotes:\n"Export of, contacts\nwith a preamble"\n\nFirst Name,Last Name,URL,Email,Company\nFirst '),
        key, F.lit(", "), "c_name", F.lit(" ,"), url, F.lit(',"a@b, c","'), "c_mktsegment", F.lit(', ""Inc"""\n'),
        F.lit('NoUrl,X,,,Y\n'),
    )
    files = c.select(key.alias("person"), content.alias("content"))
    return readers.parse_contacts(files).select(F.col("person").cast("bigint").alias("k"), "name", "url", "company")


@query("src5_intermediaries", """
    SELECT c_custkey AS ord, CASE WHEN c_mktsegment < 'F' THEN c_mktsegment
      ELSE 'Via' || chr(160) || c_mktsegment END AS via_name,
      CASE WHEN c_mktsegment < 'F' THEN '' ELSE 'https://p/' || c_mktsegment END AS via_url FROM customer""")
def intermediaries(spark, sf):
    rows = v.network_contacts(spark, sf).select("person", "ord")
    segments = rows.select("person").distinct().filter("person >= 'F'")
    persons = segments.select(
        "person", F.lit("Via").alias("first_name"), F.col("person").alias("last_name"),
        F.concat(F.lit("https://p/"), "person").alias("linkedin_profile_url"),
    )
    return readers.with_via(rows, persons).select("ord", "via_name", "via_url")


@query("src5_network_directories", """
    SELECT c_custkey AS k, 'First ' || c_custkey || chr(160) || c_name AS name, 'https://p/' || c_custkey AS url,
      'NATION_' || c_nationkey AS company, c_mktsegment AS person,
      CASE WHEN c_mktsegment < 'F' THEN c_mktsegment ELSE 'Via' || chr(160) || c_mktsegment END AS via_name,
      CASE WHEN c_mktsegment < 'F' THEN '' ELSE 'https://p/' || c_mktsegment END AS via_url FROM customer""")
def network_directories(spark, sf):
    """Exports of all intermediaries, written as directories and read again."""
    c = v.table(spark, sf, "customer")
    number = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("First "), number, F.lit(","), "c_name", F.lit(",https://p/"), number, F.lit(",NATION_"),
                    F.col("c_nationkey").cast("string"))
    segments = c.select("c_mktsegment").distinct()
    header = segments.select("c_mktsegment", F.lit(-1).alias("at"), F.lit("First Name,Last Name,URL,Company").alias("value"))
    lines = header.unionByName(c.select("c_mktsegment", F.col("c_custkey").alias("at"), line.alias("value")))
    path = fresh_path(spark, "network")
    lines.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "at").select(
        "value", F.col("c_mktsegment").alias("person")).write.partitionBy("person").text(path)
    folder = Folder(spark, path)
    for name in folder.names():  # one directory for each segment
        if name.startswith("person="):
            person = name.removeprefix("person=")
            part = next(p for p in folder.names(name) if p.startswith("part-"))
            folder.rename(f"{name}/{part}", f"{person}/Connections.csv")
            if person >= "F":
                folder.publish(f"{person}/Person.json", json.dumps(
                    {"first_name": "Via", "last_name": person, "linkedin_profile_url": f"https://p/{person}"}))
    read = readers.read_network(spark, path)
    return read.select(
        F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("k"), "name", "url", "company", "person", "via_name", "via_url"
    )


@query("src6_context_directory", "SELECT canonical, content FROM v_context", ("v_context",))
def context_directory(spark, sf):
    """Context documents, one file for each company, written and read again."""
    folder = Folder(spark, fresh_path(spark, "context"))
    for row in v.context(spark, sf).collect():  # as many files as there are companies
        folder.publish(f"{row.canonical}.md", f"\n {row.content}\n\n")
    return readers.read_context(spark, folder.path)


CACHED_SQL = f"""
    , keyed AS (SELECT ord, source, sha256({LISTING_SQL})[1:16] AS key FROM v_postings),
    cached AS (SELECT DISTINCT key FROM keyed WHERE source < 'src5')"""


@query("jon9_cached_results", CACHED_SQL + """
    SELECT ord, CASE WHEN key IN (SELECT key FROM cached) THEN 'cached ' ELSE 'new ' END || key AS payload FROM keyed""",
       ("v_postings",))
def cached_results(spark, sf):
    p = v.postings(spark, sf)
    key = short_key(listing_text())
    cache = p.filter("source < 'src5'").select(key.alias("key")).distinct().withColumn(
        "payload", F.concat(F.lit("cached "), "key")
    )
    done, _ = enrich.cached_enrich(p, cache, key, lambda rows: rows.select("key", F.concat(F.lit("new "), "key").alias("payload")))
    return done.select("ord", "payload")


@query("jon9_new_entries", CACHED_SQL + """
    SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM cached)""", ("v_postings",))
def new_entries(spark, sf):
    p = v.postings(spark, sf)
    key = short_key(listing_text())
    cache = p.filter("source < 'src5'").select(key.alias("key")).distinct().withColumn("payload", F.lit("old"))
    return enrich.cached_enrich(p, cache, key, lambda rows: rows.select("key", F.lit("new").alias("payload")))[1].select("key")


@query("src11_source_selection", "SELECT 's' || s_suppkey AS slug FROM supplier WHERE s_suppkey NOT IN (1, 3)")
def source_selection(spark, sf):
    return enrich.select_sources(v.sources(spark, sf, "gem"), exclude={"s1", "s3"}).select("slug")


# --- orders ----------------------------------------------------------------

PRIORITY = "(interest_score / 100.0) * (fit_score / 100.0)"


@query("rnk1_priority_order", f"""
    SELECT p.ord, round({PRIORITY}, 6) AS priority, row_number() OVER (ORDER BY {PRIORITY} DESC, p.ord) AS rank
    FROM v_postings p JOIN v_scores USING (hash)""", ("v_postings", "v_scores"))
def priority_order(spark, sf):
    rows = report.scored_postings(v.postings(spark, sf), v.scores(spark, sf))
    placed = ranking.with_position(rows, report.ranked_order(), "rank", key="ord")
    return placed.select("ord", F.round("priority", 6).alias("priority"), "rank")


@query("rnk2_top_n", """
    SELECT hash, n_chars AS score FROM (SELECT hash, length(description) AS n_chars FROM v_store)
    ORDER BY n_chars DESC, hash LIMIT 25""", ("v_store",))
def top_n(spark, sf):
    rows = v.store(spark, sf).select("hash", F.length("description").cast("bigint").alias("score"))
    return ranking.top_n(rows, "score", 25)


@query("agg10_best_and_cutoff", """
    SELECT max(s) AS best, min(s) AS cutoff FROM (SELECT CAST(length(description) AS DOUBLE) AS s, hash FROM v_store
    ORDER BY s DESC, hash LIMIT 25)""", ("v_store",))
def best_and_cutoff(spark, sf):
    rows = v.store(spark, sf).select("hash", F.length("description").cast("double").alias("score"))
    return ranking.best_and_cutoff(ranking.top_n(rows, "score", 25), "score")


SPEARMAN_SQL = """
    , pairs AS ({pairs}),
    ranks AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                     rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pairs)
    SELECT count(*) AS n, round(corr(rx, ry), 4) AS rho FROM ranks"""


@query("rnk3_spearman", SPEARMAN_SQL.replace("{pairs}", "SELECT interest_score AS x, fit_score AS y FROM v_scores"),
       ("v_scores",))
def spearman(spark, sf):
    return ranking.spearman(v.scores(spark, sf), "interest_score", "fit_score")


@query("rnk3_spearman_lineitem", "WITH one AS (SELECT 1)" + SPEARMAN_SQL.replace(
    "{pairs}", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem"))
def spearman_lineitem(spark, sf):
    return ranking.spearman(v.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("jon8_agreement", SPEARMAN_SQL.replace("{pairs}", f"""
    SELECT {PRIORITY} AS x, length(p.description) AS y FROM v_store p JOIN v_scores USING (hash)""")
    .replace("AS n,", "AS agreement_n,").replace("AS rho", "AS agreement_spearman"), ("v_store", "v_scores"))
def agreement(spark, sf):
    guesses = v.store(spark, sf).select("hash", F.length("description").cast("double").alias("surrogate_score"))
    return surrogate.agreement(v.scores(spark, sf), guesses)


@query("rnk4_text_column_order", """
    SELECT ord, row_number() OVER (ORDER BY lower(source), ord) AS rank FROM v_postings""", ("v_postings",))
def text_column_order(spark, sf):
    rows = v.postings(spark, sf)
    return ranking.with_position(rows, report.column_order(rows, "source"), "rank", key="ord").select("ord", "rank")


@query("rnk4_number_column_order", """
    SELECT p.ord, row_number() OVER (ORDER BY fit_score DESC, p.ord) AS rank
    FROM v_postings p JOIN v_scores USING (hash)""", ("v_postings", "v_scores"))
def number_column_order(spark, sf):
    rows = report.scored_postings(v.postings(spark, sf), v.scores(spark, sf))
    return ranking.with_position(rows, report.column_order(rows, "fit_score", False), "rank", key="ord").select("ord", "rank")


@query("rnk5_page_numbers", """
    SELECT ord, (row_number() OVER (ORDER BY posted DESC, ord) - 1) // 50 AS page FROM v_postings""", ("v_postings",))
def page_numbers(spark, sf):
    return ranking.with_page(v.postings(spark, sf), [F.desc("posted"), F.asc("ord")], key="ord").select("ord", "page")


@query("rnk5_last_page", """
    SELECT ord FROM v_postings ORDER BY posted DESC, ord
    OFFSET (SELECT ((count(*) - 1) // 50) * 50 FROM v_postings)""", ("v_postings",))
def last_page(spark, sf):
    return ranking.page(v.postings(spark, sf), 10**9, [F.desc("posted"), F.asc("ord")], key="ord").select("ord")


@query("rnk6_sources_by_name", """
    SELECT slug, row_number() OVER (ORDER BY slug) AS rank FROM (SELECT 's' || s_suppkey AS slug FROM supplier)""")
def sources_by_name(spark, sf):
    return ranking.with_position(v.sources(spark, sf, "gem").select("slug"), ["slug"], "rank")


# --- report ----------------------------------------------------------------

SCORE = "sqrt(CAST(interest_score * fit_score AS DOUBLE))"
CELL = "{prefix} || ({amount}) || {suffix}"


def sql_cell(side: str) -> str:
    c = "p.compensation"
    amount = f"{c}.{side}"
    shown = CELL.format(prefix=SQL_PREFIX.format(c=f"{c}.currency"), suffix=SQL_SUFFIX.format(i=f"{c}.interval"),
                        amount=sql_amount(amount, f"{amount} >= 1000"))
    return f"CASE WHEN {amount} IS NULL THEN '' ELSE {shown} END"


REPORT_SQL = f"""
    SELECT p.ord, p.hash, round({SCORE}, 6) AS score, CAST(round_even({SCORE}, 0) AS INTEGER) AS score_shown,
      CASE WHEN {SCORE} >= 70 THEN 'green' WHEN {SCORE} >= 40 THEN 'yellow' ELSE 'red' END AS score_class,
      CASE WHEN fit_score >= 70 THEN 'green' WHEN fit_score >= 40 THEN 'yellow' ELSE 'red' END AS fit_class,
      CAST(epoch(CAST(posted AS TIMESTAMP)) AS BIGINT) AS posted_epoch,
      {sql_time_ago(f'(CAST(epoch({NOW}) - epoch(CAST(posted AS TIMESTAMP)) AS BIGINT))')} AS posted_ago,
      epoch({NOW}) - epoch(CAST(posted AS TIMESTAMP)) < 7 * 86400 AS is_recent,
      epoch({NOW}) - epoch(CAST(last_seen_at AS TIMESTAMP)) > 172800 AS is_stale,
      coalesce({sql_pay_text('p.compensation', 'p.compensation_raw')}, '') AS pay_text,
      {sql_cell('min_amount')} AS pay_min_text, {sql_cell('max_amount')} AS pay_max_text,
      coalesce(p.compensation.min_amount, -1) AS pay_min, coalesce(p.compensation.max_amount, -1) AS pay_max
    FROM v_postings p JOIN v_scores USING (hash)"""


def report_rows(spark, sf):
    return report.report_table(report.scored_postings(v.postings(spark, sf), v.scores(spark, sf)), v.AS_OF)


@query("sca12_sca13_sca14_report_table", REPORT_SQL, ("v_postings", "v_scores"))
def report_table(spark, sf):
    blank = F.lit("")
    return report_rows(spark, sf).select(
        "ord", "hash", F.round("score", 6).alias("score"), "score_shown", "score_class", "fit_class",
        "posted_epoch", "posted_ago", "is_recent", "is_stale", "pay_text",
        F.coalesce("pay_min_text", blank).alias("pay_min_text"), F.coalesce("pay_max_text", blank).alias("pay_max_text"),
        F.coalesce("pay_min", F.lit(-1)).alias("pay_min"), F.coalesce("pay_max", F.lit(-1)).alias("pay_max"),
    )


@query("flt5_search", f"""
    SELECT p.ord FROM v_postings p JOIN v_scores USING (hash) WHERE contains(
      lower(title || ' ' || company || ' ' || coalesce(team, '') || ' ' || location || ' ' ||
            coalesce({sql_pay_text('p.compensation', 'p.compensation_raw')}, '')), 'nation_1')
      AND contains(lower(title || ' ' || company || ' ' || coalesce(team, '') || ' ' || location || ' ' ||
            coalesce({sql_pay_text('p.compensation', 'p.compensation_raw')}, '')), 'the')""",
       ("v_postings", "v_scores"))
def search(spark, sf):
    return report.search(report_rows(spark, sf), " THE  Nation_1 ").select("ord")


@query("status_report_table", f"""
    , status AS (SELECT source, max(run_at) AS last_run_at FROM v_runs GROUP BY source)
    SELECT source, {sql_time_ago("(CAST(trunc(epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(CAST(last_run_at AS TIMESTAMP))) AS BIGINT))")}
      AS last_run_ago FROM status""", ("v_runs",))
def status_report(spark, sf):
    status = fold_status(empty_status(spark), v.runs(spark, sf), F.col("n"))
    return report.status_table(status, "2024-01-30T00:00:00").select("source", "last_run_ago")


@query("snk2_rounded_scores", """
    SELECT p.ord, p.hash, round(length(p.description) / 7.0, 6) AS surrogate_score,
      row_number() OVER (ORDER BY p.ord) AS rank FROM v_store p""", ("v_store",))
def rounded_scores(spark, sf):
    path = fresh_path(spark, "scores")
    p = v.store(spark, sf)
    guesses = p.select("hash", (F.length("description") / F.lit(7.0)).alias("surrogate_score"))
    sinks.write_surrogate(p, guesses, path, key="ord")
    return spark.read.parquet(path).select("ord", "hash", "surrogate_score", "rank")


@query("snk3_metrics_append", """
    SELECT t AS "timestamp", count(*) AS n_examples FROM labels, (VALUES ('one'), ('two')) x(t) GROUP BY t""")
def metrics_append(spark, sf):
    path = fresh_path(spark, "metrics")
    metrics = v.table(spark, sf, "labels").agg(F.count("*").alias("n_examples"))
    for stamp in ("one", "two"):
        sinks.append_metrics(metrics, path, stamp)
    return spark.read.schema("timestamp string, n_examples bigint").json(path)


FLAGSHIP_SQL = f"""
    , unique_rows AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY title, company, team, description ORDER BY ord) AS rn
        FROM v_postings) WHERE rn = 1)
    SELECT p.hash, p.title, p.company, p.url, interest_score, fit_score, round({PRIORITY}, 6) AS priority
    FROM unique_rows p JOIN v_scores USING (hash)
    WHERE ({sql_match('the')} OR {sql_match('les')}) AND NOT {sql_match('nicht')}
    ORDER BY {PRIORITY} DESC, p.ord LIMIT 100"""


@query("ranked_selection", FLAGSHIP_SQL, ("v_postings", "v_scores"))
def flagship(spark, sf):
    """Keep-first deduplication, boolean text match, priority order, first hundred."""
    wanted = (match.term("the") | match.term("les")) & ~match.term("nicht")
    chosen = match.matching(dedup_first(v.postings(spark, sf)), wanted)
    return report.ranked(chosen, v.scores(spark, sf)).limit(100).select(
        "hash", "title", "company", "url", "interest_score", "fit_score", F.round("priority", 6).alias("priority")
    )
