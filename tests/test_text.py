import hashlib
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from postmill.functions import dates, html, match, text
from tests.rows import posting, postings

AS_OF = "2026-04-19T12:00:00"


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r.v for r in df.select(column.alias("v")).collect()]


def test_job_hash_equals_plain_python(spark):
    cases = [("Title", "Co", " Body\n"), (" A", "B", "École  "), ("", "", ""), ("x", None, "\x1c")]
    df = spark.createDataFrame(cases, "t string, c string, d string")
    got = [r.h for r in df.select(text.job_hash("t", "c", "d").alias("h")).collect()]
    want = [
        hashlib.sha256("\n".join(p or "" for p in c).lower().strip().encode()).hexdigest()
        for c in cases
    ]
    assert got == want


def test_keys(spark):
    assert values(spark, text.canonicalize("x"), ["Acme, Inc.", "--A b--", "é", "A1"]) == [
        "acme-inc", "a-b", "", "a1"]
    assert values(spark, text.company_key("x"), ["  Acme Co\n"]) == ["acme co"]
    want = hashlib.sha256(b"a\nb").hexdigest()[:16]
    assert values(spark, text.fingerprint(F.lit("a"), F.lit("b")), ["-"]) == [want]


def test_listing_text(spark):
    df = postings(spark, posting("a", description="abcdef", location="", team="Core"),
                  posting("b", compensation_raw="DOE", location="Oslo"))
    got = [r.v for r in df.select(text.listing_text(3).alias("v")).collect()]
    assert got[0] == ("**Role a** at **Acme**\nLocation: Not specified\nCompensation: Not specified\n"
                      "Team: Core\n\nabc")
    assert "Compensation: DOE\n" in got[1] and "Location: Oslo\n" in got[1]


def test_parse_iso_drops_the_offset(spark):
    got = values(spark, dates.parse_iso("x").cast("string"),
                 ["2026-01-02T03:04:05+05:00", "2026-01-02", "2026-01-02T03:04:05Z", "junk", "", "2026"])
    assert got == ["2026-01-02 03:04:05", "2026-01-02 00:00:00", "2026-01-02 03:04:05", None, None, None]


def test_time_ago(spark):
    rows = ["2026-04-19T11:59:40", "2026-04-19T11:00:01", "2026-04-19T11:00:00", "2026-04-18T12:00:01",
            "2026-04-18T12:00:00", "2026-04-12", "2026-03-21T12:00:00", "2026-03-20", "2025-04-19",
            "2023-01-01", "2027-01-01", "soon", "", None]
    assert values(spark, dates.time_ago("x", AS_OF), rows) == [
        "1 min ago", "59 mins ago", "1 hour ago", "23 hours ago", "1 day ago", "1 week ago", "4 weeks ago",
        "1 month ago", "1 year ago", "3 years ago", "1 min ago", "soon", "", ""]


def test_dates(spark):
    assert values(spark, dates.epoch("x"), ["1970-01-02", "", "bad", None]) == [86400, 0, 0, 0]
    assert values(spark, dates.epoch_millis_date("x"), [1767225599999, 0, None], "x bigint") == [
        "2025-12-31", None, None]
    assert values(spark, dates.utc_date("x"), [
        "2026-01-01T01:00:00+05:30", "2025-12-31T23:30:00-01:00", "2026-01-01T00:00:00Z", "2026-01-01", "no",
    ]) == ["2025-12-31", "2026-01-01", "2026-01-01", "2026-01-01", None]
    assert values(spark, dates.feed_date("x"), [
        "Thu, 26 Mar 2026 00:00:00 +0530", "Mon, 1 Dec 2025", "Mon, 1 Foo 2025", "1 Dec 2025", None,
    ]) == ["2026-03-26", "2025-12-01", None, None, None]
    assert values(spark, dates.is_recent("x", AS_OF), ["2026-04-12T12:00:01", "2026-04-12T12:00:00", "2027-01-01", "x"]) == [
        True, False, True, False]


def test_html_to_text(spark):
    got = values(spark, html.html_to_text("x"), [
        "<p>One <b>two</b> three</p>", "&lt;p&gt;A &amp;amp; B&lt;/p&gt;",
        "<style>p{}</style><script>var a='</p>'</script>x<!-- c -->y<br/>z", "plain", "", None,
        "<template>no</template><div> a\nb </div>",
    ])
    assert got == ["One\ntwo\nthree", "A & B", "x\ny\nz", "plain", "", None, "a\nb"]


def test_json_ld(spark):
    page = (
        '<script type="application/ld+json">{bad</script>'
        '<script type="application/ld+json">["JobPosting"]</script>'
        '<script type="application/ld+json">{"@type":"Organization","description":"no"}</script>'
        '<script type="application/ld+json">{"@type":"JobPosting","description":"&lt;p&gt;yes&lt;/p&gt;"}</script>'
        '<script type="application/ld+json">{"@type":"JobPosting","description":"later"}</script>'
    )
    assert values(spark, html.json_ld_description("x"), [page, "<p>none</p>", "",
                  '<script type="application/ld+json">{"@type":"JobPosting"}</script>']) == ["yes", "", "", ""]


# --- text match ------------------------------------------------------------

def rows(spark):
    return postings(
        spark,
        posting("a", title="Senior Élan Engineer", description="build the eclipse engine", location=None),
        posting("b", title="snake_case C++", description="one two three four five six seven eight nine ten eleven twelve"),
        posting("c", title="Data", description="engineer of things", company="Écoles Ltd", location="Oslo"),
        posting("d", title="Engineers", description="élan VITAL", location="São Paulo"),
    )


def hits(spark, predicate):
    return {r.hash for r in rows(spark).filter(predicate).collect()}


def test_terms(spark):
    assert hits(spark, match.term("engineer")) == {"a", "c"}
    assert hits(spark, match.term("elan")) == {"a", "d"}
    assert hits(spark, match.term("ÉLAN", "title")) == {"a"}
    assert hits(spark, match.term("snake")) == {"b"}
    assert hits(spark, match.term("c")) == {"b"}
    assert hits(spark, match.term("sao")) == {"d"}
    assert hits(spark, match.prefix("engin")) == {"a", "c", "d"}
    assert hits(spark, match.initial("engineer")) == {"c"}
    assert hits(spark, match.initial("engineer", "title")) == set()
    assert hits(spark, match.term("engineer", match.excluding("title"))) == {"c"}


def test_phrases(spark):
    assert hits(spark, match.phrase("élan engineer")) == {"a"}
    assert hits(spark, match.phrase("Data engineer")) == set()
    assert hits(spark, match.words("Data engineer")) == {"c"}
    assert hits(spark, match.phrase("the ecl", prefix=True)) == {"a"}
    assert hits(spark, match.phrase("++ --")) == set()
    assert hits(spark, match.phrase("snake case")) == {"b"}


def test_near(spark):
    assert hits(spark, match.near(["one", "twelve"])) == {"b"}
    assert hits(spark, match.near(["twelve", "one"], 10)) == {"b"}
    assert hits(spark, match.near(["one", "twelve"], 9)) == set()
    assert hits(spark, match.near(["one two", "twelve"], 9)) == {"b"}
    assert hits(spark, match.near(["one", "five", "nine"], 7)) == {"b"}
    assert hits(spark, match.near(["data", "engineer"])) == set()


def test_boolean_and_guards(spark):
    assert hits(spark, match.term("engineer") & ~match.term("senior")) == {"c"}
    assert hits(spark, match.any_of([match.term("oslo"), match.term("case")])) == {"b", "c"}
    assert match.matching(rows(spark), None).count() == 4
    assert match.keyword_lines("# all\n\n a OR b \n#x\nc") == ["a OR b", "c"]
    for bad in (lambda: match.term("x", "body"), lambda: match.near(["a"])):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("expected a ValueError")


# --- many keywords at once -------------------------------------------------

MANY = ["engineer", "Élan", "data", "data engineer", "build the eclipse", "build", "sao paulo", "c", "snake", "twelve", "of things of"]


def test_keywords_found_together_equal_single_terms(spark):
    known = match.Keywords(MANY, prefixes=["engin", "the ecl", "ecol"])
    scanned = known.scan(rows(spark)).cache()
    for cols in (None, "title", ("description", "company")):
        for text in MANY:
            assert {r.hash for r in scanned.filter(known.has(text, cols)).collect()} == hits(spark, match.term(text, cols)), text
        for text in ("engin", "the ecl", "ecol"):
            assert {r.hash for r in scanned.filter(known.has(text, cols, prefix=True)).collect()} == hits(spark, match.prefix(text, cols)), text
    assert {r.hash for r in scanned.filter(known.any()).collect()} == hits(
        spark, match.any_of([match.term(t) for t in MANY] + [match.prefix(p) for p in ("engin", "the ecl", "ecol")]))
    tree = lambda has: has("engineer") & ~has("data engineer") | has("ecol", "company", prefix=True)
    assert hits(spark, known.predicate(tree)) == hits(
        spark, match.term("engineer") & ~match.phrase("data engineer") | match.prefix("ecol", "company"))
    assert hits(spark, match.any_phrase(["vital", "c++", "twelve nine"])) == hits(spark, match.any_of([match.term("vital"), match.term("c")]))
    assert hits(spark, match.any_phrase([])) == hits(spark, match.any_phrase(["++"])) == set()


def test_a_prefix_is_no_whole_term(spark):
    known = match.Keywords(["eng", "engine"], prefixes=["eng"])
    df = known.scan(postings(spark, posting("x", title="engines", description="engineering eng-ine")))
    got = df.select(known.has("eng"), known.has("eng", prefix=True), known.has("engine"), known.has("eng", "title")).first()
    assert tuple(got) == (True, True, False, False)


def test_keywords_refuse_what_they_do_not_know(spark):
    known = match.Keywords(["a"], cols="title")
    for call in (lambda: known.has("b"), lambda: known.has("a", "company"), lambda: match.Keywords(["a"], cols="nope")):
        try:
            call()
        except ValueError:
            continue
        raise AssertionError("expected a ValueError")


def test_fragments_of_a_batch_are_not_all_python_texts():
    raw = pa.array([None, "", *["<p>" + "a b" * 2000 + f"</p>{n}" for n in range(2000)]])
    tracemalloc.start()
    got = html.fragment_texts(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2002 and got[:2].to_pylist() == [None, ""] and got[2001].as_py() == "a b" * 2000 + "\n1999"
    assert peak < raw.nbytes / 3
    assert len(html.fragment_texts(pa.array([], pa.string()))) == 0
