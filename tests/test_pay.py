from pyspark.sql import functions as F

from postmill.functions.pay import extract_pay, format_amount, format_pay
from postmill.schema import PAY
from postmill.sources.boards import tier_pay


def pay(lo, hi, currency="USD", interval=None, equity=False, bonus=False):
    return (lo, hi, currency, interval, equity, bonus)


SHOWN = [
    (pay(165200, 224800), None, "$165k–$225k"),
    (pay(92000, 115000, "EUR"), None, "EUR 92k–115k"),
    (pay(900, 115000), None, "$900–$115,000"),
    (pay(2500, None), None, "$3k+"),
    (pay(None, 80000, None, "annual"), None, "up to 80k/yr"),
    (pay(30, 45, "USD", "hourly"), None, "$30–$45/hr"),
    (pay(1000, 1200, "GBP", "weekly", True, True), None, "GBP 1k–1k/wk (+equity, +bonus)"),
    (pay(4000, None, "USD", "monthly", False, True), None, "$4k+/mo (+bonus)"),
    (pay(None, None, "USD", None, True), None, " (+equity)"),
    (None, "Competitive", "Competitive"),
    (None, None, None),
]


def test_format_pay(spark):
    df = spark.createDataFrame([(p, r) for p, r, _ in SHOWN], "p " + PAY.simpleString() + ", r string")
    got = [x.t for x in df.select(format_pay("p", "r").alias("t")).collect()]
    assert got == [t for _, _, t in SHOWN]


def test_format_amount(spark):
    df = spark.createDataFrame(
        [(None, "USD", None), (999, "USD", "hourly"), (1500, "EUR", "annual"), (165200, None, None)],
        "n bigint, c string, i string",
    )
    got = [x.t for x in df.select(format_amount("n", "c", "i").alias("t")).collect()]
    assert got == ["", "$999/hr", "EUR 2k/yr", "165k"]


TEXTS = [
    ("The base salary range for this job is $120,000 - $150,500 per year.", (120000, 150500, "annual")),
    ("Compensation: $45 to $60 an hour plus tips", (45, 60, "hourly")),
    ("pay range $1.5M–$2M", (1500000, 2000000, "annual")),
    ("US salary range: $90K - $110K", (90000, 110000, "annual")),
    ("Hourly rate and wage range of $80,000-$95,000", (80000, 95000, "annual")),
    ("RANGE FOR THIS ROLE is $700 - $900 per week", (700, 900, "weekly")),
    ("compensation : $5,000 - $6,000 per month", (5000, 6000, "monthly")),
    ("x" * 500 + " salary range $50,000 - $70,000 " + "y" * 500, (50000, 70000, "annual")),
    ("salary range $20 - $30", (20, 30, "hourly")),
    # The unit letter may follow a space, so this reads as six billion.
    ("compensation: $5,000 - $6,000 monthly", None),
    ("", None),
    ("salary range to be agreed", None),
    ("we raised $50,000,000 - $60,000,000", None),
    ("salary range $90,000 - $50,000", None),
    ("salary range CA$90,000 - CA$95,000", None),
    ("salary range $5,000 - $6,000 yearly", None),
    ("salary range $50,000,000 - $60,000,000", None),
    ("salary range $, - $50", None),
]


def test_extract_pay(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", extract_pay("t").alias("p")).orderBy("i").collect()
    got = [None if r.p is None else (r.p.min_amount, r.p.max_amount, r.p.interval) for r in rows]
    assert got == [want for _, want in TEXTS]


def test_window_is_sixty_characters(spark):
    near = "per hour" + "." * 40 + "pay range $90 - $120"
    far = "per hour" + "." * 60 + "pay range $11 - $12 per week"
    df = spark.createDataFrame([(near,), (far,)], "t string")
    got = [r.p.interval if r.p else None for r in df.select(extract_pay("t").alias("p")).collect()]
    assert got == ["hourly", "weekly"]


TIER = (
    "struct<compensationTierSummary:string,summaryComponents:array<struct<compensationType:string,"
    "interval:string,currencyCode:string,minValue:double,maxValue:double>>>"
)
TIERS = [
    (("$81K – $87K • Offers Equity", None), (81000, 87000, "USD", None, True, False), None),
    (("$30.50 per hour", []), (30, None, "USD", "hourly", False, False), None),
    (("$1,200.75 - $1,300 monthly, Offers Bonus", None), (1200, 1300, "USD", "monthly", False, True), None),
    (("CA$90K - CA$100K", None), None, "CA$90K - CA$100K"),
    (("Competitive", None), None, "Competitive"),
    (("", None), None, None),
    ((None, None), None, None),
    (("$1 - $2", [("Bonus", None, None, None, None), ("Salary", "1 YEAR", "EUR", 50000.9, None),
                  ("EquityPercentage", None, None, None, None)]),
     (50000, None, "EUR", "annual", True, True), None),
    (("$70K", [("Bonus", None, None, None, None)]), (70000, None, "USD", None, False, False), None),
    (("$70K", [("Salary", "1 DECADE", "", None, 90.0)]), (None, 90, None, None, False, False), None),
]


def test_tier_pay(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(TIERS)], f"i int, c {TIER}")
    p, raw = tier_pay(F.col("c"))
    rows = df.select("i", p.alias("p"), raw.alias("raw")).orderBy("i").collect()
    assert [(None if r.p is None else tuple(r.p), r.raw) for r in rows] == [(p, r) for _, p, r in TIERS]

