import json

from pyspark.sql import functions as F

from castweave.sources import feeds

RSS = b"""<?xml version="1.0"?><rss xmlns:itunes="http://x"><channel><title> Show </title><link>https://s</link><language>en</language>
<image><url>https://i</url></image>
<item><guid>g1</guid><title>One</title><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><enclosure url="https://e/1.mp3"/><itunes:explicit>yes</itunes:explicit></item>
<item><link>https://s/2</link><title>Two &amp; more</title></item><item><title>Three</title></item></channel></rss>"""


def test_parse(spark):
    payloads = spark.createDataFrame([(1, RSS), (2, b"<broken"), (3, None), (4, b"")], "feed_id long, payload binary")
    parsed = feeds.parse_feeds(payloads)
    rows = {r.feed_id: r for r in parsed.collect()}
    assert rows[1].title == "Show" and rows[1].image == "https://i" and len(rows[1]["items"]) == 3
    assert rows[2].error.startswith("parse") and rows[3].error == rows[4].error == "empty payload"
    episodes = {r.title: r for r in feeds.episodes_of(parsed).collect()}
    assert episodes["One"].guid == "g1" and episodes["One"].explicit is True and episodes["One"].enclosure_url == "https://e/1.mp3"
    assert episodes["Two & more"].guid == "https://s/2"
    assert episodes["Three"].guid.startswith("generated:")
    assert len(feeds.parse_feed(RSS, max_items=2)["items"]) == 2


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in feeds.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C"), (None, "n")}
    assert {tuple(r) for r in feeds.insert_missing(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "C"), (None, "n")}
    twice = new.unionByName(new.withColumn("v", F.lower("v")))
    assert {tuple(r) for r in feeds.latest_by_key(twice, ["k"], [F.col("v")]).collect()} == {(2, "b"), (3, "c")}


def test_snapshots(spark):
    payloads = spark.createDataFrame([(1, bytearray(b"x")), (1, bytearray(b"x")), (1, bytearray(b"y"))], "feed_id long, payload binary")
    none = spark.createDataFrame([], "feed_id long, content_hash string")
    first = feeds.snapshots(payloads, none)
    assert first.count() == 2 and first.first().path.startswith("rss/1/")
    assert feeds.snapshots(payloads, first.select("feed_id", "content_hash")).count() == 0


def test_charts(spark):
    rows = [("top", 0, "111"), ("top", 1, "222"), ("new", 2, "111"), ("new", 3, None), ("new", 4, " ")]
    ids = feeds.chart_ids(spark.createDataFrame(rows, "label string, position int, id string")).orderBy("position").collect()
    assert [(r.id, r.chart_sources) for r in ids] == [("111", ["new", "top"]), ("222", ["top"])]
    assert feeds.genre_ids({"1301": {"subgenres": {"1482": {}}}, "1303": {}}) == [1301, 1482, 1303]


def test_files(spark, tmp_path):
    edge = tmp_path / "edges.txt"
    edge.write_text("a\tb\t{'kind': 'host', 'date': '2020-01-02 00:00'}\nc\td\t{}\nbad line\n")
    got = {r.left: r for r in feeds.read_edge_list(spark, str(edge)).collect()}
    assert got["a"].kind == "host" and got["a"].active_start == "2020-01-02" and got["c"].kind == "guest" and got["c"].date is None
    fixture = tmp_path / "f.json"
    fixture.write_text(json.dumps([{"pk": 1, "model": "m", "fields": {"name": "x"}}]))
    assert tuple(feeds.read_fixture(spark, str(fixture), "name string").first()) == (1, "x")
    tsv = tmp_path / "s.tsv"
    tsv.write_text("idx\tavg\tdates\n0\t0.5\t2010-01-01\n")
    assert feeds.read_tsv(spark, str(tsv)).columns == ["avg", "dates"]


def test_requests_and_responses(spark):
    line = feeds.request_lines(spark.createDataFrame([(7, "hi")], "id long, prompt string"), F.col("id"), ["prompt"]).first().value
    assert json.loads(line) == {"custom_id": "episode-7", "body": {"prompt": "hi"}}
    body = {"output": [{"content": [{"type": "output_text", "text": json.dumps({"guests": [{"name": "A", "confidence": 0.9}]})}]}]}
    lines = [
        {"custom_id": "episode-7", "response": {"status_code": 200, "body": body}}, {"custom_id": "episode-8", "response": {"status_code": 500}},
        {"custom_id": "episode-9", "error": "late"}, {"custom_id": "odd", "response": {"status_code": 200, "body": {"output": []}}},
    ]
    rows = {r.episode_id: r for r in feeds.response_rows(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).collect()}
    assert rows[7].status == "succeeded" and rows[7].guests[0].name == "A"
    assert rows[8].status == rows[9].status == "failed" and rows[None].status == "unreadable"


def test_copy(spark):
    row = feeds.copy_clean(spark.createDataFrame([("a\0b", 1)], "t string, flag int"), ["flag"]).first()
    assert (row.t, row.flag) == ("ab", True)
