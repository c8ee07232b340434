"""Pay: bounds from payload fields, ranges from text, and display text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.schema import PAY_DDL

# --- Fixed values: display ------------------------------------------------
EN_DASH = "–"
SUFFIX = {"annual": "/yr", "hourly": "/hr", "monthly": "/mo", "weekly": "/wk"}

# --- Fixed values: pay ranges in running text -----------------------------
ANCHOR = (
    r"(?:(?:annual|base|hourly|u\.?s\.?|usd)?\s*"
    r"(?:salary|pay|compensation|wage)\s+range"
    r"|range\s+for\s+this\s+role"
    r"|compensation\s*:)"
)
AMOUNT = r"(?<![A-Za-z])\$\s*([\d,]+(?:\.\d+)?)\s*([KkMm]?)"
SEPARATOR = r"\s*(?:-|–|to)\s*"
RANGE_IN_ASCII = rf"(?i){ANCHOR}[^$\n]{{0,120}}{AMOUNT}\$?{SEPARATOR}{AMOUNT}"
RANGE_IN_TEXT = RANGE_IN_ASCII.replace("(?i)", "(?iU)", 1)
ANCHOR_PARTS = ("range", "compen")  # every anchor holds one of them
TEXT_WINDOW = 60
TEXT_INTERVALS = (
    ("hourly", ("an hour", "per hour", "/hr", "/hour", "hourly")),
    ("weekly", ("per week", "/wk", "weekly")),
    ("monthly", ("per month", "/mo", "monthly")),
    ("annual", ("per year", "/yr", "/year", "a year", "annual")),
)
HIGHEST_PAY = 10_000_000
LOWEST_ANNUAL_MAX = 10_000
HOURLY_LIMIT = 1_000

# --- Fixed values: pay tier summaries -------------------------------------
NUMBER = r"[\d,]+(?:\.\d+)?"
DOLLAR = r"(?<![A-Za-z])\$"
SUMMARY_RANGE = (
    rf"(?iU){DOLLAR}({NUMBER})(K)?\s*[–-]\s*{DOLLAR}?({NUMBER})(K)?"
)
SUMMARY_SINGLE = rf"(?iU){DOLLAR}({NUMBER})(K)?"
SUMMARY_INTERVALS = (
    ("hour", "hourly"), ("week", "weekly"), ("month", "monthly"),
    ("year", "annual"), ("annual", "annual"),
)
EQUITY_TEXT = "Offers Equity"
BONUS_TEXT = "Offers Bonus"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit("")))


def pay_struct(
    low: Column, high: Column, currency: Column, interval: Column,
    equity: Column | None = None, bonus: Column | None = None,
) -> Column:
    no = F.lit(False)
    return F.struct(
        low.cast("bigint").alias("min_amount"),
        high.cast("bigint").alias("max_amount"),
        currency.cast("string").alias("currency"),
        interval.cast("string").alias("interval"),
        F.coalesce(equity if equity is not None else no, no).alias("equity"),
        F.coalesce(bonus if bonus is not None else no, no).alias("bonus"),
    )


def bounded_pay(
    item: Column, low: str, high: str, currency: str,
    interval: Callable[[Column], Column] | None = None,
    *, cents: bool = False, zero_is_missing: bool = False,
    default_currency: str | None = None,
) -> Column:
    """Pay of one object carrying a pair of bounds; null without any bound."""

    def bound(name: str) -> Column:
        value = item[name].try_cast("double")
        if zero_is_missing:
            value = F.nullif(value, F.lit(0.0))
        return F.floor(value / 100) if cents else value

    lo, hi = bound(low), bound(high)
    code = F.nullif(item[currency], F.lit(""))
    if default_currency is not None:
        code = F.coalesce(code, F.lit(default_currency))
    every = interval(item) if interval else F.lit(None)
    return F.when(lo.isNotNull() | hi.isNotNull(), pay_struct(lo, hi, code, every))


def first_bounded_pay(items: Column, low: str, high: str, currency: str, **kw) -> Column:
    """Pay of the first array element that has any bound."""
    found = F.filter(
        items, lambda r: r[low].try_cast("double").isNotNull() | r[high].try_cast("double").isNotNull()
    )
    return bounded_pay(F.get(found, F.lit(0)), low, high, currency, **kw)


def _amount_text(n: Column, thousands: Column) -> Column:
    short = F.concat(F.format_number(F.floor((n + 500) / 1000), 0), F.lit("k"))
    return F.when(thousands, short).otherwise(F.format_number(n, 0))


def _currency_prefix(currency: Column) -> Column:
    return (
        F.when(currency.isNull(), F.lit(""))
        .when(currency == "USD", F.lit("$"))
        .otherwise(F.concat(currency, F.lit(" ")))
    )


def _interval_suffix(interval: Column) -> Column:
    return F.coalesce(lookup(interval, SUFFIX), F.lit(""))


def format_amount(
    amount: Column | str, currency: Column | str, interval: Column | str
) -> Column:
    """One bound as text; '' for a missing amount."""
    n = _col(amount)
    text = F.concat(
        _currency_prefix(_col(currency)), _amount_text(n, n >= 1000),
        _interval_suffix(_col(interval)),
    )
    return F.when(n.isNull(), F.lit("")).otherwise(text)


def format_pay(pay: Column | str, raw: Column | str) -> Column:
    """Display text of the pay union; null when both sides are null."""
    p = _col(pay)
    lo, hi, currency = p["min_amount"], p["max_amount"], p["currency"]
    prefix = _currency_prefix(currency)
    thousands = (F.coalesce(lo, hi) >= 1000) & (F.coalesce(hi, lo) >= 1000)
    low, high = _amount_text(lo, thousands), _amount_text(hi, thousands)
    # The dollar sign is repeated, other codes appear once.
    second = F.when(currency == "USD", prefix).otherwise(F.lit(""))
    body = (
        F.when(lo.isNotNull() & hi.isNotNull(),
               F.concat(prefix, low, F.lit(EN_DASH), second, high))
        .when(lo.isNotNull(), F.concat(prefix, low, F.lit("+")))
        .when(hi.isNotNull(), F.concat(F.lit("up to "), prefix, high))
        .otherwise(F.lit(""))
    )
    extras = F.concat_ws(
        ", ", F.when(p["equity"], F.lit("+equity")), F.when(p["bonus"], F.lit("+bonus"))
    )
    tail = F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(F.lit(""))
    shown = F.concat(body, _interval_suffix(p["interval"]), tail)
    return F.when(p.isNotNull(), shown).otherwise(_col(raw))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def infer_interval(window: Column, low: Column) -> Column:
    """Interval named in the text around a range, else by magnitude."""
    folded = F.lower(window)
    chain = None
    for interval, words in TEXT_INTERVALS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(folded, F.lit(word))
        chain = (chain.when if chain is not None else F.when)(hit, F.lit(interval))
    return chain.otherwise(F.when(low < 1000, F.lit("hourly")).otherwise(F.lit("annual")))


def extract_pay(text: Column | str) -> Column:
    """USD pay range announced in running text, null when there is none.

    The match is found once. Nothing in the pattern looks before its start, so
    the first occurrence of the matched text is the match itself; that gives the
    window around it without a second search.
    """
    t = _col(text)

    def amount(match: Column, value: int, unit: int) -> Column:
        u = F.lower(F.regexp_extract(match, RANGE_IN_TEXT, unit))
        factor = F.when(u == "k", 1_000.0).when(u == "m", 1_000_000.0).otherwise(1.0)
        return F.floor(_number(F.regexp_extract(match, RANGE_IN_TEXT, value)) * factor)

    def found(match: Column) -> Column:
        start = F.instr(t, match)
        before = F.least(start - 1, F.lit(TEXT_WINDOW))
        window = F.substr(
            t, start - before, before + F.length(match) + F.lit(TEXT_WINDOW)
        )
        parts = F.struct(
            amount(match, 1, 2).alias("lo"), amount(match, 3, 4).alias("hi"),
            window.alias("window"),
        )
        return F.when(match != "", _once(parts, decide))

    def decide(r: Column) -> Column:
        lo, hi = r["lo"], r["hi"]
        said = infer_interval(r["window"], lo)
        every = F.when((said == "hourly") & (lo > HOURLY_LIMIT), F.lit("annual")).otherwise(said)
        valid = (
            (lo > 0) & (hi > 0) & (hi >= lo) & (hi <= HIGHEST_PAY)
            & ~((said == "annual") & (hi < LOWEST_ANNUAL_MAX))
        )
        return F.when(valid, pay_struct(lo, hi, F.lit("USD"), every))

    folded = F.lower(t)
    anchored = F.contains(folded, F.lit(ANCHOR_PARTS[0])) | F.contains(folded, F.lit(ANCHOR_PARTS[1]))
    ascii_text = F.octet_length(t) == F.char_length(t)
    matched = F.when(ascii_text, F.regexp_extract(t, RANGE_IN_ASCII, 0)).otherwise(
        F.regexp_extract(t, RANGE_IN_TEXT, 0)
    )
    return F.when(F.contains(t, F.lit("$")) & anchored, _once(matched, found)).otherwise(
        F.lit(None).cast(PAY_DDL)
    )


def summary_pay(summary: Column) -> tuple[Column, Column]:
    """(pay, raw text) of a pay tier summary such as '$81K - $87K'."""
    is_range = F.rlike(summary, F.lit(SUMMARY_RANGE))
    is_single = F.rlike(summary, F.lit(SUMMARY_SINGLE))

    def amount(pattern: str, group: int) -> Column:
        k = F.regexp_extract(summary, pattern, group + 1) != ""
        number = _number(F.regexp_extract(summary, pattern, group))
        return F.floor(number * F.when(k, 1000.0).otherwise(1.0))

    folded = F.lower(summary)
    every = F.lit(None).cast("string")
    for word, interval in reversed(SUMMARY_INTERVALS):
        every = F.when(F.contains(folded, F.lit(word)), F.lit(interval)).otherwise(every)
    pay = F.when(
        is_range | is_single,
        pay_struct(
            F.when(is_range, amount(SUMMARY_RANGE, 1)).otherwise(amount(SUMMARY_SINGLE, 1)),
            F.when(is_range, amount(SUMMARY_RANGE, 3)),
            F.lit("USD"), every,
            F.contains(summary, F.lit(EQUITY_TEXT)), F.contains(summary, F.lit(BONUS_TEXT)),
        ),
    )
    raw = F.when(~is_range & ~is_single, F.nullif(summary, F.lit("")))
    return pay, raw
