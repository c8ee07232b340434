"""Literal posting rows for the tests."""

from postmill.schema import POSTING

NOW = "2026-04-19T12:00:00+00:00"


def posting(name, **values):
    row = {
        "hash": name, "title": f"Role {name}", "company": "Acme",
        "url": f"https://jobs.test/{name}", "description": "text", "source": "s",
        "last_seen_at": "", "team": None, "posted": None, "compensation": None,
        "compensation_raw": None, "location": None, "ord": 0,
    }
    row.update(values)
    return row


def postings(spark, *rows):
    numbered = [{**r, "ord": r["ord"] or n} for n, r in enumerate(rows)]
    return spark.createDataFrame(
        [tuple(r[f] for f in POSTING.names) for r in numbered], POSTING
    )


def column(df, name="hash"):
    return [r[name] for r in df.collect()]
