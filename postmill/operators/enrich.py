"""Context documents, contacts and cached results joined to postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import canonicalize, company_key
from postmill.operators.dedup import first_per_key
from postmill.session import materialise


def with_context(postings: DataFrame, context: DataFrame) -> DataFrame:
    """Adds ``context``, the document of the canonical company name, or ''.

    No broadcast is forced: the planner broadcasts the documents when their
    measured size allows it and otherwise splits a hot company at run time.
    """
    docs = context.select(F.col("canonical").alias("_canonical"), "content")
    return (
        postings.withColumn("_canonical", canonicalize("company"))
        .join(docs, "_canonical", "left")
        .withColumn("context", F.coalesce("content", F.lit("")))
        .drop("_canonical", "content")
    )


def first_degree(contacts: DataFrame) -> DataFrame:
    """Own contacts by company: (company_key, ord, name, url), in input order.

    The relation stays in long form: a list per company would put every contact
    of a large company into one row.
    """
    return contacts.select(company_key("company").alias("company_key"), "ord", "name", "url")


def not_known(contacts: DataFrame, first: DataFrame) -> DataFrame:
    """Contacts whose url is no own contact's, at whatever company that one is known."""
    return contacts.join(first.select("url").distinct(), "url", "left_anti")


def second_degree(contacts: DataFrame, first: DataFrame) -> DataFrame:
    """Contacts of contacts by company and intermediary, each url once per company.

    ``contacts`` carries (person, via_name, via_url, ord, name, url, company).
    Urls of own contacts are left out everywhere, not only at the company where
    they are known. A url stays with the first intermediary in person order.
    """
    keyed = contacts.withColumn("company_key", company_key("company"))
    return first_per_key(
        not_known(keyed, first), [F.col("company_key"), F.col("url")], [F.col("person"), F.col("ord")]
    ).select("company_key", "person", "via_name", "via_url", "ord", "name", "url")


def second_degree_groups(second: DataFrame) -> DataFrame:
    """Contacts per company and intermediary."""
    return second.groupBy("company_key", "person", "via_name", "via_url").agg(
        F.count("*").alias("connections")
    )


def contact_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """(company_key, n1, n2) in one aggregation over both relations."""
    one = first.select("company_key", F.lit(1).alias("_1"), F.lit(0).alias("_2"))
    two = second.select("company_key", F.lit(0).alias("_1"), F.lit(1).alias("_2"))
    return one.unionByName(two).groupBy("company_key").agg(
        F.sum("_1").alias("n1"), F.sum("_2").alias("n2")
    )


def with_contacts(postings: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Adds ``n1`` and ``n2``, the numbers of contacts at the company.

    Counts are joined, not contacts, so postings and contacts of one company
    never multiply. ``contacts_of`` lists them for the rows of a page.
    """
    return (
        postings.withColumn("company_key", company_key("company"))
        .join(contact_counts(first, second), "company_key", "left")
        .withColumn("n1", F.coalesce("n1", F.lit(0)))
        .withColumn("n2", F.coalesce("n2", F.lit(0)))
        .drop("company_key")
    )


def contacts_of(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Contacts of the companies in ``rows``, one row per contact."""
    wanted = rows.select(company_key("company").alias("company_key")).distinct()
    own = first.select(
        "company_key", F.lit(1).alias("degree"), F.lit(None).cast("string").alias("person"),
        F.lit(None).cast("string").alias("via_name"), "ord", "name", "url",
    )
    far = second.select("company_key", F.lit(2).alias("degree"), "person", "via_name",
                        "ord", "name", "url")
    return own.unionByName(far).join(wanted, "company_key", "left_semi")


def with_sources(payloads: DataFrame, sources: DataFrame, default_ttl: float | None) -> DataFrame:
    """Registry name, extra settings and effective ttl for every payload."""
    registry = sources.select("platform", "slug", "name", "extra", "cache_ttl")
    ttl = F.coalesce("cache_ttl", F.lit(default_ttl).cast("double"))
    return payloads.join(registry, ["platform", "slug"]).withColumn("cache_ttl", ttl)


def select_sources(
    sources: DataFrame, only: set[str] | None = None, exclude: set[str] | None = None
) -> DataFrame:
    """Registry rows to collect; include and exclude cannot be combined."""
    if only is not None and exclude is not None:
        raise ValueError("only and exclude are mutually exclusive")
    named = sorted(only or exclude or ())
    if not named:
        return sources
    known = {r.slug for r in sources.filter(F.col("slug").isin(named)).select("slug").collect()}
    unknown = [n for n in named if n not in known]
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    inside = F.col("slug").isin(named)
    return sources.filter(inside if only is not None else ~inside)


def cached_enrich(
    df: DataFrame, cache: DataFrame, key: Column, fn: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """(enriched, new entries): results by content key, computed only on a miss.

    ``cache`` and the result of ``fn`` have (key, payload). ``fn`` gets one row
    per missing key; its result is stored once, since it is both appended to the
    cache and joined back. Rows without a result are kept with a null payload.
    """
    keyed = df.withColumn("key", key)
    missing = first_per_key(
        keyed.join(cache.select("key"), "key", "left_anti"), [F.col("key")], [F.col("ord")]
    )
    new = materialise(fn(missing).select("key", "payload"), "enriched")
    known = cache.select("key", "payload").unionByName(new)
    return keyed.join(known, "key", "left"), new
