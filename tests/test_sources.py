import json
import re

import pytest
from pyspark.sql import functions as F

from postmill.functions.text import short_key
from postmill.operators import enrich, ranking, report
from postmill.schema import EXAMPLE, PAYLOAD, POSTING, SOURCES, STATUS
from postmill.sources import boards, custom, readers, sinks
from tests.rows import NOW, column, posting, postings


def registry(spark, platform, *slugs, extra=None, ttl=None):
    return spark.createDataFrame([(platform, s, s.title(), extra or {}, ttl) for s in slugs], SOURCES)


def payloads(spark, platform, *rows):
    """rows: (slug, kind, request key, body)."""
    return spark.createDataFrame(
        [(platform, s, k, r, b if isinstance(b, str) else json.dumps(b), 0.0, n) for n, (s, k, r, b) in enumerate(rows)],
        PAYLOAD,
    )


def run(spark, platform, *rows, extra=None):
    slugs = sorted({r[0] for r in rows})
    good, errors = boards.normalize(platform, payloads(spark, platform, *rows), registry(spark, platform, *slugs, extra=extra))
    return good.orderBy("ord").collect(), {r.source: r.error for r in errors.collect()}


def test_missing_fields_and_empty_listing(spark):
    rows, errors = run(spark, "greenhouse", ("a", "listing", "p", {"jobs": [{}]}), ("b", "listing", "p", {"jobs": []}),
                       ("c", "listing", "p", {}))
    assert errors == {}
    row = rows[0]
    assert len(rows) == 1
    assert (row.title, row.description, row.url, row.team, row.posted, row.location, row.compensation) == (
        "", "", "", None, None, None, None)
    assert (row.company, row.source, row.last_seen_at) == ("A", "greenhouse:a", "")


def test_a_failed_source_has_one_error_and_no_rows(spark):
    rows, errors = run(spark, "gem", ("a", "listing", "1", [{"title": "x"}]), ("a", "listing", "2", "{nope"),
                       ("a", "listing", "3", "{no"), ("b", "listing", "1", [{"title": "y"}]))
    assert [r.source for r in rows] == ["gem:b"]
    assert set(errors) == {"gem:a"}


def test_strict_details(spark):
    page = {"results": [{"shortcode": "A", "title": "x"}, {"shortcode": "B", "title": "y"}]}
    rows, errors = run(spark, "workable", ("a", "listing", "1", page), ("a", "detail", "A", {"description": "<p>d</p>"}))
    assert rows == [] and errors == {"workable:a": "missing detail B"}
    rows, errors = run(spark, "workable", ("a", "listing", "1", page), ("a", "detail", "A", {"description": "<p>d</p>"}),
                       ("a", "detail", "B", "{bad"))
    assert rows == [] and errors == {"workable:a": "malformed detail B"}
    rows, errors = run(spark, "workable", ("a", "listing", "1", page), ("a", "detail", "A", {"description": "<p>d</p>"}),
                       ("a", "detail", "B", {}))
    assert [(r.description, r.url) for r in rows] == [
        ("d", "https://apply.workable.com/a/j/A/"), ("", "https://apply.workable.com/a/j/B/")]


def test_lenient_platforms_keep_rows(spark):
    extra = {"instance": "wd1", "site": "jobs"}
    page = {"total": 2, "jobPostings": [{"title": "x", "externalPath": "/a", "locationsText": "L"},
                                        {"title": "x again", "externalPath": "/a"}]}
    rows, errors = run(spark, "workday", ("a", "listing", "1", page), ("a", "listing", "2", "{bad"), extra=extra)
    assert errors == {}
    assert [(r.title, r.description, r.location, r.url) for r in rows] == [
        ("x", "", "L", "https://a.wd1.myworkdayjobs.com/jobs/a")]
    first = {"totalFound": 1, "content": [{"name": "n", "id": "7"}]}
    rows, errors = run(spark, "smartrecruiters", ("a", "listing", "limit=100&offset=0", first),
                       ("a", "listing", "limit=100&offset=100", "{bad"), ("b", "listing", "limit=100&offset=0", "{bad"))
    assert [(r.title, r.url) for r in rows] == [("n", "https://jobs.smartrecruiters.com/a/7")]
    assert set(errors) == {"smartrecruiters:b"}


def test_bound_pairs(spark):
    def pay(salary):
        rows, _ = run(spark, "lever", ("a", "listing", "1", [{"text": "t", "salaryRange": salary}]))
        return None if rows[0].compensation is None else tuple(rows[0].compensation)

    assert pay({"min": 37.02, "max": 40.99, "currency": "USD", "interval": "per-hour-wage"}) == (37, 40, "USD", "hourly", False, False)
    assert pay({"min": None, "max": 5, "currency": "", "interval": "x"}) == (None, 5, None, None, False, False)
    assert pay({"currency": "USD"}) is None
    assert pay(None) is None


def test_smart_zero_bounds(spark):
    page = {"totalFound": 2, "content": [{"name": "n", "id": i} for i in "12"]}
    rows, _ = run(spark, "smartrecruiters", ("a", "listing", "offset=0", page),
                  ("a", "detail", "1", {"compensation": {"min": 0, "max": 90, "period": "HOURLY", "currency": "EUR"}}),
                  ("a", "detail", "2", {"compensation": {"min": 0, "max": 0}}))
    assert [r.compensation and tuple(r.compensation) for r in rows] == [(None, 90, "EUR", "hourly", False, False), None]


def test_unknown_platform_and_collect(spark):
    with pytest.raises(ValueError):
        boards.normalize("nope", payloads(spark, "x"), registry(spark, "x", "a"))
    both = payloads(spark, "gem", ("a", "listing", "1", [{"title": "x"}])).unionByName(
        payloads(spark, "lever", ("b", "listing", "1", "bad")))
    sources = registry(spark, "gem", "a").unionByName(registry(spark, "lever", "b"))
    own = custom.conform(postings(spark, posting("own")))
    rows, errors = boards.collect(both, sources, ["gem", "lever"], own)
    assert sorted(column(rows, "source")) == ["gem:a", "s"]
    assert column(errors, "source") == ["lever:b"]


def test_live_payloads(spark):
    log = spark.createDataFrame([
        ("gem", "a", "listing", "1", "old", 10.0, 0), ("gem", "a", "listing", "1", "new", 90.0, 1),
        ("gem", "b", "listing", "1", "gone", 10.0, 2), ("gem", "c", "listing", "1", "unknown source", 99.0, 3),
    ], PAYLOAD)
    sources = registry(spark, "gem", "a", ttl=1000.0).unionByName(registry(spark, "gem", "b"))
    assert column(boards.live_payloads(log, sources, 100.0, 50.0), "body") == ["new"]


# --- readers and sinks -----------------------------------------------------

def test_posting_round_trip(spark, tmp_path):
    df = postings(
        spark, posting("a", compensation=(1, 2, "USD", "annual", True, False), ord=5),
        posting("b", compensation_raw="Competitive", team="T", ord=2), posting("c", ord=9))
    path = str(tmp_path / "rows")
    sinks.write_postings(df, path)
    back = readers.read_postings(spark, path)
    rows = back.orderBy("ord").collect()
    assert [r.hash for r in rows] == ["b", "a", "c"] and [r.ord for r in rows] == [0, 1, 2]
    assert tuple(rows[1].compensation) == (1, 2, "USD", "annual", True, False)
    assert (rows[0].compensation, rows[0].compensation_raw) == (None, "Competitive")
    assert back.columns == POSTING.names


def test_store_scan(spark, tmp_path):
    path = tmp_path / "store.json"
    line = {"hash": "a", "title": "t", "company": "c", "url": "u", "description": "d", "source": "s", "other": 1}
    path.write_text("\n".join(json.dumps({**line, "team": t}) for t in ("1", "2")) + "\n")
    row = readers.read_store(spark, str(path)).head()
    assert (row.team, row.last_seen_at) == ("2", "")
    assert readers.read_store(spark, str(tmp_path / "absent")).count() == 0
    path.write_text('{"hash": "a"}\n')
    with pytest.raises(Exception, match="posting without"):
        readers.read_postings(spark, str(path)).collect()
    path.write_text("{bad\n")
    with pytest.raises(Exception):
        readers.read_postings(spark, str(path)).collect()


def test_log_scan_drops_corrupt_lines(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"_key":"a","_ts":1.5,"value":"x"}\n{"_key":\n{"value":"y"}\n')
    rows = readers.read_log(spark, str(path), "_key string, _ts double, _ttl double, value string").collect()
    assert [(r._key, r._ts, r.value) for r in rows] == [("a", 1.5, "x"), (None, None, "y")]


def test_contacts(spark, tmp_path):
    (tmp_path / "Connections.csv").write_text(
        '﻿Notes:\n"about, this"\n\nFirst Name,Last Name,URL,Company,Position\n'
        'Ann,Lee,https://p/1," Acme, Inc ","a ""b"""\nBob,,https://p/2,Acme,x\n,No,https://p/3,Acme,x\n'
        'Cy,NoUrl,,Acme,x\nDi,NoCo,https://p/4,,x\n', encoding="utf-8")
    rows = readers.read_contacts(spark, str(tmp_path / "Connections.csv")).orderBy("ord").collect()
    assert [(r.name, r.url, r.company) for r in rows] == [
        ("Ann Lee", "https://p/1", "Acme, Inc"), ("Bob", "https://p/2", "Acme")]


def test_network(spark, tmp_path):
    head = "First Name,Last Name,URL,Company\n"
    for person, info, lines in (
        ("kim b", {"first_name": "Kim", "last_name": "Bo", "linkedin_profile_url": "https://p/k"}, "A,A,https://p/1,Acme\nB,B,https://p/2,Acme\n"),
        ("lou", None, "A,A,https://p/1,ACME\nC,C,https://p/3,Acme\nD,D,https://p/9,Acme\nA,A,https://p/1,Other\n"),
    ):
        (tmp_path / person).mkdir()
        (tmp_path / person / "Connections.csv").write_text(head + lines)
        if info:
            (tmp_path / person / "Person.json").write_text(json.dumps(info))
    contacts = readers.read_network(spark, str(tmp_path))
    first = enrich.first_degree(spark.createDataFrame([(" Elsewhere", 1, "Me", "https://p/9")], "company string, ord bigint, name string, url string"))
    second = enrich.second_degree(contacts, first).orderBy("company_key", "person", "ord").collect()
    assert [(r.company_key, r.via_name, r.via_url, r.url) for r in second] == [
        ("acme", "Kim Bo", "https://p/k", "https://p/1"), ("acme", "Kim Bo", "https://p/k", "https://p/2"),
        ("acme", "lou", "", "https://p/3"), ("other", "lou", "", "https://p/1")]


def test_context(spark, tmp_path):
    (tmp_path / "acme-inc.md").write_text("\n# About\n")
    (tmp_path / "note.txt").write_text("no")
    context = readers.read_context(spark, str(tmp_path))
    rows = enrich.with_context(postings(spark, posting("a", company="Acme, Inc."), posting("b", company="Other")), context)
    assert {r.hash: r.context for r in rows.collect()} == {"a": "# About", "b": ""}


def test_training_gate(spark, tmp_path):
    path = str(tmp_path / "training")
    assert readers.read_training(spark, path, "x", EXAMPLE).count() == 0
    row = spark.createDataFrame([("a", "t", "d", "c", None, None, None, 1, 2)], EXAMPLE)
    sinks.append_training(row, path, "x")
    sinks.append_training(row, path, "x")
    assert readers.read_training(spark, path, "x", EXAMPLE).count() == 2
    assert readers.read_training(spark, path, "y", EXAMPLE).count() == 0


def test_metrics_errors_status(spark, tmp_path):
    metrics = spark.createDataFrame([(3, None)], "n_examples bigint, agreement_spearman double")
    for stamp in ("1", "2"):
        sinks.append_metrics(metrics, str(tmp_path / "m"), stamp)
    assert sorted(r.timestamp for r in spark.read.schema("timestamp string").json(str(tmp_path / "m")).collect()) == ["1", "2"]
    none = spark.createDataFrame([], "source string, error string")
    assert sinks.write_errors(none, str(tmp_path / "e"), NOW) is False and not (tmp_path / "e").exists()
    assert sinks.write_errors(spark.createDataFrame([("a", "x")], none.schema), str(tmp_path / "e"), NOW)
    status = spark.createDataFrame([("a", "1", None, None, None, None, None)], STATUS)
    sinks.write_status(status, str(tmp_path / "s"))
    assert readers.read_status(spark, str(tmp_path / "s")).collect() == status.collect()
    assert readers.read_status(spark, str(tmp_path / "none")).count() == 0


def test_surrogate_output(spark, tmp_path):
    df = postings(spark, posting("a", ord=3), posting("b", ord=1))
    guess = spark.createDataFrame([("a", 0.123456789), ("b", 0.5)], "hash string, surrogate_score double")
    sinks.write_surrogate(df, guess, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s")).orderBy("rank").collect()
    assert [(r.hash, r.surrogate_score, r["rank"]) for r in rows] == [("b", 0.5, 1), ("a", 0.123457, 2)]


def test_custom_sources(spark):
    custom.register_source("mine", lambda s: postings(s, posting("a", source="mine")))
    with pytest.raises(ValueError):
        custom.register_source("mine", lambda s: None)
    assert column(custom.custom_postings(spark, ["mine"])) == ["a"]
    with pytest.raises(ValueError):
        custom.custom_postings(spark, ["other"])
    with pytest.raises(ValueError, match="title"):
        custom.conform(postings(spark, posting("a")).drop("title"))


def test_source_selection(spark):
    sources = registry(spark, "gem", "a", "b", "c")
    assert column(enrich.select_sources(sources, only={"a"}), "slug") == ["a"]
    assert column(enrich.select_sources(sources, exclude={"a"}), "slug") == ["b", "c"]
    assert enrich.select_sources(sources).count() == 3
    with pytest.raises(ValueError):
        enrich.select_sources(sources, only={"a"}, exclude={"b"})
    with pytest.raises(ValueError, match="z"):
        enrich.select_sources(sources, only={"a", "z"})


# --- joins, cache, report --------------------------------------------------

def test_cached_enrich_computes_each_miss_once(spark):
    df = postings(spark, posting("a", title="x"), posting("b", title="x"), posting("c", title="y"), posting("d", title="z"))
    cache = spark.createDataFrame([("y", "old")], "key string, payload string")
    asked = []

    def fn(rows):
        asked.append(sorted(r.key for r in rows.collect()))
        return rows.filter("key <> 'z'").select("key", F.lit("new").alias("payload"))

    out, new = enrich.cached_enrich(df, cache, F.col("title"), fn)
    assert asked == [["x", "z"]]
    assert {r.hash: r.payload for r in out.collect()} == {"a": "new", "b": "new", "c": "old", "d": None}
    assert column(new, "key") == ["x"]
    assert short_key(F.lit("x")) is not None


def test_contact_counts(spark):
    first = spark.createDataFrame([("acme", 1, "n", "u1"), ("acme", 2, "m", "u2")], "company_key string, ord bigint, name string, url string")
    second = spark.createDataFrame([("acme", "p", "P", "", 1, "x", "u3")],
                                   "company_key string, person string, via_name string, via_url string, ord bigint, name string, url string")
    df = postings(spark, posting("a", company=" ACME "), posting("b", company="Other"))
    assert {r.hash: (r.n1, r.n2) for r in enrich.with_contacts(df, first, second).collect()} == {"a": (2, 1), "b": (0, 0)}
    assert enrich.contacts_of(df, first, second).count() == 3


def scores(spark, *rows):
    return spark.createDataFrame(rows, "hash string, interest_score int, fit_score int")


def test_ranked(spark):
    df = postings(spark, posting("a"), posting("b"), posting("c"), posting("d"), posting("e"))
    out = report.ranked(df, scores(spark, ("a", 0, 100), ("b", 80, 50), ("c", 100, 100), ("d", 50, 80)))
    assert [(r.hash, round(r.priority, 6)) for r in out.collect()] == [("c", 1.0), ("b", 0.4), ("d", 0.4), ("a", 0.0)]


def test_pages(spark):
    df = spark.range(120).withColumnRenamed("id", "n")
    assert column(ranking.page(df, 1, ["n"]), "n") == list(range(50, 100))
    assert column(ranking.page(df, 99, ["n"]), "n") == list(range(100, 120))
    assert column(ranking.page(df, -5, ["n"]), "n") == list(range(50))
    assert ranking.page(df.filter("false"), 0, ["n"]).count() == 0
    assert [r["count"] for r in ranking.with_page(df, ["n"]).groupBy("page").count().orderBy("page").collect()] == [50, 50, 20]


def test_late_pages_come_from_positions(spark):
    df = spark.range(120).withColumnRenamed("id", "n")
    assert column(ranking.page(df, 1, [F.desc("n")]), "n") == list(range(69, 19, -1))
    assert column(ranking.page(df, 2, [F.desc("n")]), "n") == list(range(19, -1, -1))


def test_report_table_and_search(spark):
    df = postings(
        spark,
        posting("a", title="Data Engineer", posted="2026-04-18", last_seen_at="2026-04-10T00:00:00",
                compensation=(100000, None, "USD", "annual", False, False)),
        posting("b", title="Cook", posted="", compensation_raw="Fair", location="Oslo"))
    out = report.report_table(report.scored_postings(df, scores(spark, ("a", 81, 100), ("b", 49, 1))), NOW)
    rows = {r.hash: r for r in out.collect()}
    a, b = rows["a"], rows["b"]
    assert (a.score, a.score_class, a.posted_ago, a.is_recent, a.is_stale) == (90.0, "green", "1 day ago", True, True)
    assert (a.pay_text, a.pay_min, a.pay_min_text, a.pay_max, a.pay_max_text) == ("$100k+/yr", 100000, "$100k/yr", None, "")
    assert (b.score_class, b.posted_ago, b.posted_epoch, b.is_recent, b.is_stale, b.pay_text) == ("red", "", 0, False, False, "Fair")
    assert column(report.search(out, "oslo  FAIR")) == ["b"]
    assert report.search(out, " ").count() == 2
    assert [r.hash for r in out.orderBy(*report.column_order(out, "title")).collect()] == ["b", "a"]
    assert [r.hash for r in out.orderBy(*report.column_order(out, "score", False)).collect()] == ["a", "b"]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (5.0, 9.0), (None, 1.0)], "a double, b double")
    row = ranking.spearman(df, "a", "b").head()
    assert (row.n, row.rho) == (4, round(3.75 / 4.5, 4))


def test_long_records_of_contact_exports(spark):
    long = "x" * (1 << 20)
    text = f'Notes\n\nFirst Name,Last Name,URL,Company\nAda,"{long}""q""",u1,Acme\nBob,{long},u2,"A, B"\n\nlone " quote\n'
    got = readers.parse_contacts(spark.createDataFrame([("", text)], "person string, content string")).collect()
    assert [(r.url, r.company, len(r.name)) for r in got] == [("u1", "Acme", len(long) + 7), ("u2", "A, B", len(long) + 4)]


def _payload(platform, body, kind="listing", key="", slug="s", ord=0):
    return (platform, slug, kind, key, body, 0.0, ord)


CAPTURE = "platform string, slug string, kind string, request_key string, body string, fetched_at double, ord bigint"


def _registry(spark, platforms):
    return spark.createDataFrame(
        [(p, "s", "Acme", None, None) for p in platforms],
        "platform string, slug string, name string, extra map<string,string>, cache_ttl double",
    )


def test_an_error_object_fails_its_source(spark):
    for platform in ("lever", "gem"):
        body = '{"ok": false, "error": "Document not found"}'
        df = spark.createDataFrame([_payload(platform, body)], CAPTURE)
        rows, errors = boards.normalize(platform, df, _registry(spark, [platform]))
        assert rows.count() == 0 and [r.source for r in errors.collect()] == [f"{platform}:s"]


def test_bad_numbers_are_null_and_fractions_floored(spark):
    body = """{"jobs": [{"title": "a", "content": "x", "absolute_url": "u", "pay_input_ranges": [
        {"min_cents": 500050.5, "max_cents": "many", "currency_type": "USD"}]}]}"""
    df = spark.createDataFrame([_payload("greenhouse", body)], CAPTURE)
    rows, errors = boards.normalize("greenhouse", df, _registry(spark, ["greenhouse"]))
    pay = rows.first().compensation
    assert errors.count() == 0 and (pay.min_amount, pay.max_amount) == (5000, None)


def test_payloads_of_late_partitions_keep_their_order(spark):
    bodies = ['[{"text": "%s", "hostedUrl": "u%s"}]' % (k, k) for k in range(3)]
    lines = [5 + (64 << 33), 5 + (128 << 33), 5 + (5000 << 33)]
    df = spark.createDataFrame(
        [_payload("lever", b, slug="s", key=str(k), ord=o) for k, (b, o) in enumerate(zip(bodies, lines))], CAPTURE
    )
    rows, errors = boards.collect(df, _registry(spark, ["lever"]), ["lever"])
    assert errors.count() == 0
    assert [r.title for r in rows.orderBy("ord").collect()] == ["0", "1", "2"]


def test_rows_of_an_export_do_not_carry_its_records(spark):
    lines = "First Name,Last Name,URL,Company\n" + "".join(f"F{n},L,https://p/{n},C\n" for n in range(2000))
    read = readers.parse_contacts(spark.createDataFrame([("", lines)], "person string, content string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    carried = re.search(r"Generate posexplode\(records#\d+\), \[([^\]]*)\]", plan).group(1)
    assert "header#" in carried and "records#" not in carried
    assert read.count() == 2000


def test_parts_of_payloads_follow_their_size(spark, monkeypatch):
    taken, normalize = [], boards.normalize
    monkeypatch.setattr(ranking, "PART_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(boards, "normalize", lambda p, df, s: taken.append(df) or normalize(p, df, s))
    text = "x" * 500
    bodies = [(n, platform, '[{"%s": "%s", "descriptionPlain": "%s"}]' % (title, n, text))
              for n in range(300) for platform, title in (("gem", "title"), ("lever", "text"))]
    df = spark.createDataFrame([_payload(p, b, key=str(n), ord=n << 40) for n, p, b in reversed(bodies)], CAPTURE)
    rows, errors = boards.collect(df, _registry(spark, ["gem", "lever"]), ["gem", "lever"])
    assert errors.count() == 0
    found = [(r.source, r.title, r.ord >> boards.ITEM_BITS) for r in rows.orderBy("ord").collect()]
    assert found == [(f"{p}:s", str(n), 2 * n + (p == "lever")) for n, p, _ in bodies]
    # What a task sorts is bounded: a part holds about 100 of the rows, in either folder half of them.
    files = [f for f in taken[0].inputFiles() if "/kind=" in f]
    assert max(r["count"] for r in spark.read.parquet(*files).groupBy(F.input_file_name()).count().collect()) < 100


def test_positions_of_no_payloads(spark):
    df = spark.createDataFrame([], CAPTURE)
    rows, errors = boards.collect(df, _registry(spark, ["gem"]), ["gem"])
    assert rows.count() == 0 and errors.count() == 0
