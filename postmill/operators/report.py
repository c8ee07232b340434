"""Ranked postings and the tables behind the reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import epoch, is_recent, is_stale, time_ago
from postmill.functions.pay import format_amount, format_pay
from postmill.schema import FIT_FIELDS, INTEREST_FIELDS, SCORE, WARN_SECONDS

SEARCHED = ("title", "company", "team", "location", "pay_text")


def parse_score(text: Column | str) -> Column:
    """Score document as a struct; null unless every field is present."""
    parsed = F.from_json(F.col(text) if isinstance(text, str) else text, SCORE)
    needed = [parsed["interest"][f] for f in (*INTEREST_FIELDS, "score")]
    needed += [parsed["fit"][f] for f in (*FIT_FIELDS, "score")]
    return F.when(reduce(and_, [c.isNotNull() for c in needed]), parsed)


def priority(interest: Column | str, fit: Column | str) -> Column:
    """Product of both scores as fractions."""
    i = F.col(interest) if isinstance(interest, str) else interest
    f = F.col(fit) if isinstance(fit, str) else fit
    return (i / F.lit(100.0)) * (f / F.lit(100.0))


def scored_postings(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Postings with their scores; postings without one are left out."""
    return postings.join(scores.select("hash", "interest_score", "fit_score"), "hash").withColumn(
        "priority", priority("interest_score", "fit_score")
    )


def ranked_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("ord").asc()]


def ranked(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored postings, highest priority first, input order among equals."""
    return scored_postings(postings, scores).orderBy(*ranked_order())


def score_class(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 70, "green").when(s >= 40, "yellow").otherwise("red")


def report_score(interest: Column | str, fit: Column | str) -> Column:
    i = F.col(interest) if isinstance(interest, str) else interest
    f = F.col(fit) if isinstance(fit, str) else fit
    return F.sqrt(i * f)


def pay_cells(pay: Column | str) -> dict[str, Column]:
    p = F.col(pay) if isinstance(pay, str) else pay
    money = {
        side: format_amount(p[side], p["currency"], p["interval"])
        for side in ("min_amount", "max_amount")
    }
    return {
        "pay_min": p["min_amount"], "pay_min_text": money["min_amount"],
        "pay_max": p["max_amount"], "pay_max_text": money["max_amount"],
    }


def report_table(scored: DataFrame, as_of, warn_seconds: int = WARN_SECONDS) -> DataFrame:
    """Derived report columns of scored postings."""
    whole = report_score("interest_score", "fit_score")
    return scored.withColumns({
        "score": whole,
        "score_shown": F.bround(whole, 0).cast("int"),
        "score_class": score_class(whole),
        "interest_class": score_class("interest_score"),
        "fit_class": score_class("fit_score"),
        "posted_epoch": epoch("posted"),
        "posted_ago": time_ago("posted", as_of),
        "is_recent": is_recent("posted", as_of),
        "is_stale": is_stale("last_seen_at", as_of, warn_seconds),
        "seen_ago": time_ago("last_seen_at", as_of),
        "pay_text": F.coalesce(format_pay("compensation", "compensation_raw"), F.lit("")),
        **pay_cells("compensation"),
    })


def search(report: DataFrame, text: str) -> DataFrame:
    """Rows holding every whitespace-separated part in the searched columns."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in SEARCHED]))
    parts = [F.contains(joined, F.lit(p)) for p in text.lower().split()]
    return report.filter(reduce(and_, parts)) if parts else report


def column_order(report: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """Order of a report column: numbers by value, text by locale."""
    value = F.col(column)
    if report.schema[column].dataType.typeName() == "string":
        value = F.collate(F.coalesce(value, F.lit("")), "UNICODE")
    return [value.asc() if ascending else value.desc(), F.col("ord").asc()]


def status_table(status: DataFrame, as_of) -> DataFrame:
    """Status rows with ages, ordered by source."""
    return status.withColumns({
        "last_run_ago": time_ago("last_run_at", as_of),
        "last_success_ago": time_ago("last_success_at", as_of),
        "last_success_epoch": epoch("last_success_at"),
    }).orderBy("source")
