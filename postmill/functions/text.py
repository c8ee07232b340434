"""Text keys and derived text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.pay import format_pay

# Every character str.strip() removes; all of them lie below U+3001.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The customary clip lengths of feature text and listing text.
FEATURE_CHARS = 16_000
LISTING_CHARS = 8_000
UNSPECIFIED = "Not specified"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    """Unicode strip of both ends, linear in the text length."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def non_empty(c: Column | str) -> Column:
    """The value, or null where it is the empty string."""
    return F.nullif(as_col(c), F.lit(""))


def first_non_empty(*cols: Column | str) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols])


def or_blank(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def join_non_empty(sep: str, *cols: Column | str) -> Column:
    """Non-empty parts joined in order; null when none is left."""
    return non_empty(F.concat_ws(sep, *[non_empty(c) for c in cols]))


def job_hash(title: Column | str, company: Column | str, description: Column | str) -> Column:
    """Exact-text identity of a posting: sha256 hex of the folded text."""
    text = F.concat(
        or_blank(title), F.lit("\n"), or_blank(company), F.lit("\n"), or_blank(description)
    )
    return F.sha2(strip(F.lower(text)), 256)


def short_key(text: Column | str) -> Column:
    """16 hex digits of the sha256 of a text: content and prompt keys."""
    return F.substring(F.sha2(as_col(text), 256), 1, 16)


def fingerprint(first: Column | str, second: Column | str) -> Column:
    """Key of the pair of documents a training set depends on."""
    return short_key(F.concat(as_col(first), F.lit("\n"), as_col(second)))


def canonicalize(name: Column | str) -> Column:
    """Slug of a company name: lower case, runs of other characters to '-'."""
    slug = F.regexp_replace(F.lower(as_col(name)), "[^a-z0-9]+", "-")
    return F.btrim(slug, F.lit("-"))


def company_key(name: Column | str) -> Column:
    """Join key of contacts: stripped, lower-cased company name."""
    return F.lower(strip(name))


def clip(text: Column | str, max_chars: int | None) -> Column:
    """The first ``max_chars`` characters, or the whole text for None."""
    return as_col(text) if max_chars is None else F.substring(as_col(text), 1, max_chars)


def meta_text(
    title: Column | str, company: Column | str, location: Column | str,
    team: Column | str, pay_text: Column | str,
) -> Column:
    """Metadata text of a posting; optional parts only where non-empty."""
    return F.concat_ws(
        " ", or_blank(title), or_blank(company),
        non_empty(location), non_empty(team), non_empty(pay_text),
    )


def listing_text(max_chars: int | None = None) -> Column:
    """The text block a scorer reads, from the posting columns.

    The body is whole by default; pass LISTING_CHARS for the customary clip.
    """
    unspecified = F.lit(UNSPECIFIED)
    pay = F.when(
        F.col("compensation").isNotNull() | non_empty("compensation_raw").isNotNull(),
        format_pay("compensation", "compensation_raw"),
    ).otherwise(unspecified)
    return F.concat(
        F.lit("**"), or_blank("title"), F.lit("** at **"), or_blank("company"), F.lit("**\n"),
        F.lit("Location: "), F.coalesce(non_empty("location"), unspecified), F.lit("\n"),
        F.lit("Compensation: "), pay, F.lit("\n"),
        F.lit("Team: "), F.coalesce(non_empty("team"), unspecified), F.lit("\n\n"),
        clip(or_blank("description"), max_chars),
    )
