"""Posting feeds as Spark data sources, read as batches and as streams."""

import json

import pytest

from postmill.functions.text import job_hash
from postmill.schema import POSTING
from postmill.sources import custom, feeds


class Numbered(feeds.Feed):
    """Two parts of three postings each."""

    def parts(self):
        return 2

    def rows(self, part):
        for k in range(3):
            yield {"title": f"T{part}{k}", "company": "C", "url": f"u{part}{k}", "description": "d", "source": "own",
                   "team": None, "unknown": 1, "compensation": {"min_amount": k, "interval": "annual"} if k else "Competitive"}


def line(name, **more):
    return json.dumps({"title": name, "company": "c", "url": name, "description": "d", "source": "s", **more})


def test_a_batch_has_a_task_for_each_part(spark):
    feeds.register_feed(spark, "numbered", Numbered())
    raw = spark.read.format("numbered").load()
    assert raw.rdd.getNumPartitions() == 2 and raw.schema == POSTING
    rows = feeds.read_feed(spark, "numbered").orderBy("ord").collect()
    assert [r.title for r in rows] == ["T00", "T01", "T02", "T10", "T11", "T12"]
    assert rows[0].compensation is None and rows[0].compensation_raw == "Competitive"
    assert rows[4].compensation.min_amount == 1 and rows[4].compensation.currency is None
    assert len({r.ord for r in rows}) == 6 and {r.last_seen_at for r in rows} == {""}
    want = spark.createDataFrame([("T00", "C", "d")], "t string, c string, d string").select(job_hash("t", "c", "d")).first()[0]
    assert rows[0].hash == want
    assert custom.conform(feeds.read_feed(spark, "numbered")).columns == POSTING.names


def test_a_stream_takes_each_part_once_and_goes_on_after_a_restart(spark, tmp_path):
    inbox, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()
    feeds.register_feed(spark, "lines", feeds.LinesFeed(str(inbox)))

    def run():
        query = feeds.stream_feed(spark, "lines").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", ck).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.title for r in spark.read.schema(POSTING).parquet(out).collect())

    (inbox / "0.json").write_text(line("a") + "\n\n" + line("b", hash="own"))
    (inbox / "note.txt").write_text("not a part")
    assert run() == ["a", "b"]
    (inbox / "1.json").write_text(line("c") + "\n")
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    batch = feeds.read_feed(spark, "lines")
    assert sorted(r.title for r in batch.collect()) == ["a", "b", "c"]
    assert {r.hash for r in batch.filter("title = 'b'").collect()} == {"own"}


def test_a_feed_without_parts_and_a_row_without_fields(spark, tmp_path):
    feeds.register_feed(spark, "nothing", feeds.LinesFeed(str(tmp_path / "none")))
    assert feeds.read_feed(spark, "nothing").collect() == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "0.json").write_text('{"title": "t"}')
    feeds.register_feed(spark, "bad", feeds.LinesFeed(str(tmp_path / "bad")))
    with pytest.raises(Exception, match="posting lacks company"):
        feeds.read_feed(spark, "bad").collect()
