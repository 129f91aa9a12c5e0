import datetime as dt

from pyspark.sql import functions as F

from castweave.operators import evolution as V
from castweave.operators import relational as ops
from castweave.streaming import weekly

APP = "episode_id long, podcast_id long, published_at timestamp, person_id long, name string, role string"


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC) if text else None


def test_one_show_two_weeks(spark):
    rows = [(e, 1, at(d), p, str(p), r) for e, d in ((1, "2024-01-03"), (2, "2024-01-10"), (3, None)) for p, r in ((1, "host"), (2, "guest"))]
    new = {str(r.week): r for r in V.weekly_new(spark.createDataFrame(rows, APP)).collect()}
    first = new["2024-01-01"]
    assert (first.new_people, first.new_edges, first.new_podcasts, first.episodes) == (2, 1, 1, 1)
    assert (new["2024-01-08"].new_people, new["2024-01-08"].episodes) == (0, 1) and len(new) == 2
    total = V.weekly_cumulative(V.weekly_new(spark.createDataFrame(rows, APP))).orderBy("week").collect()
    assert [r.episodes for r in total] == [1, 2]


def test_weeks(spark):
    episode = spark.createDataFrame([(at("2024-01-03"),), (at("2024-01-24"),), (None,)], "published_at timestamp")
    none = spark.createDataFrame([], "week date")
    stored = spark.createDataFrame([(dt.date(2024, 1, 8),)], "week date")
    weeks = lambda *a, **k: [str(r.week) for r in V.weeks_missing(episode, *a, **k).orderBy("week").collect()]
    assert weeks(none, bootstrap=False) == []
    assert weeks(none) == ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
    assert weeks(stored) == ["2024-01-15", "2024-01-22"]
    assert weeks(stored, recompute=True, max_weeks=2) == ["2024-01-01", "2024-01-08"]
    cutoff = spark.createDataFrame([(dt.date(2024, 1, 1),)], "w date").select(V.week_cutoff(F.col("w"), "America/Denver").cast("string"))
    assert cutoff.first()[0] == "2024-01-08 07:00:00"


def test_cohosts(spark):
    episode = spark.createDataFrame([(i, 1) for i in range(10)], "id long, podcast_id long")
    app = lambda n: spark.createDataFrame([(i, 1, None, 5, "x", "guest") for i in range(n)], APP)
    assert ops.promote_cohosts(app(3), episode).select("role").distinct().first()[0] == "host"
    assert ops.promote_cohosts(app(2), episode).select("role").distinct().first()[0] == "guest"


def test_ranks_histogram_sample(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(40)], "id long, v long")
    ranked = ops.global_rank(df, "v", "id", "rank").orderBy("rank").collect()
    assert [r.id for r in ranked] == sorted(range(40), key=lambda i: (-(i % 5), str(i)))
    assert {r.bin: r["count"] for r in ops.histogram(df, "v", 4).collect()} == {0: 8, 1: 8, 2: 8, 3: 8}
    assert ops.histogram(df.limit(0), "v").count() == 0
    assert {r.bin for r in ops.histogram(df.where("v = 3"), "v").collect()} == {0}
    sample = ops.diverse_sample(df, "v", "id", 5, seed=1)
    assert sample.select("v").distinct().count() == 5


def test_stream_ignores_redelivery(spark, tmp_path):
    rows = [(1, at("2024-01-02"), "a"), (1, at("2024-01-02"), "a"), (2, at("2024-01-09"), "b")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "d"))
    out = weekly.run_once(spark, str(tmp_path / "d"), "*.parquet", lambda s: weekly.first_by_key(s, "ts", ["event_id"]), ["event_id"])
    assert out.count() == 2
    counts = weekly.run_once(spark, str(tmp_path / "d"), "*.parquet", lambda s: weekly.weekly_counts(s, "ts", "event_type"), ["w", "event_type"])
    assert {(str(r.w.start)[:10], r.events) for r in counts.collect()} == {("2024-01-01", 2), ("2024-01-08", 1)}


def test_hosts_prune_chunks(spark):
    episode = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "id long, podcast_id long")
    hosts = spark.createDataFrame([(9, 5)], "podcast_id long, person_id long")
    have = spark.createDataFrame([(1, 5, "host"), (2, 5, "guest")], "episode_id long, person_id long, role string")
    assert [tuple(r) for r in ops.host_appearances(hosts, episode, have).collect()] == [(2, 5)]
    person = spark.createDataFrame([(5, "Ann"), (6, "Ann Lee"), (7, None)], "id long, name string")
    kept, left = ops.prune_single_tokens(person, have.withColumn("person_id", F.lit(6)))
    assert [r.id for r in kept.collect()] == [6] and left.count() == 2
    assert sorted(r["count"] for r in ops.chunks(episode, "id", 2).groupBy("chunk").count().collect()) == [1, 2]


def test_stream_of_many_batches_counts_once(spark, tmp_path):
    for i in range(3):
        rows = [(10 * i + k, at("2024-01-02"), "a") for k in range(i + 1)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    build = lambda s: weekly.weekly_counts(s, "ts", "event_type")
    out = weekly.run_once(spark, str(tmp_path / "d"), "*.parquet", build, ["w", "event_type"], files_per_batch=1)
    assert [(str(r.w.start)[:10], r.events) for r in out.collect()] == [("2024-01-01", 6)]
