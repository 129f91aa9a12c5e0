"""Connection paths between people through shows, within a date window, with an explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castweave.functions import text
from castweave.functions.similarity import name_match_score
from castweave.runtime import cut


# Answers without a path.
UNKNOWN = "Sorry, we could not find {} in the database. Did you mean {}?"
UNCONNECTED = "No connection found between {} and {}."
#: Queries that are sent to all names at once.
QUERY_BLOCK = 1_000


def merge_edges(events: DataFrame) -> DataFrame:
    """Parallel edges of ``events(person, show, kind, date)`` merged to one per pair.

    One host event makes a host edge, whose active range spans every event's date; guest edges
    keep their sorted distinct dates.
    """
    host = F.max((F.col("kind") == "host").cast("int")) == 1
    dates = F.array_sort(F.collect_set("date"))
    merged = events.groupBy("person", "show").agg(
        F.when(host, "host").otherwise("guest").alias("kind"),
        F.when(~host, dates).otherwise(F.array().cast("array<date>")).alias("dates"),
        F.when(host, F.min("date")).alias("active_start"),
        F.when(host, F.max("date")).alias("active_end"),
    )
    return merged


def in_window(start: str | None, end: str | None) -> Column:
    """Guest edges need a date inside, host edges an overlapping active range; undated ones fail."""
    if start is None and end is None:
        return F.lit(True)
    low, high = F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")
    guest = F.exists("dates", lambda d: (d >= low) & (d <= high))
    host = F.coalesce((F.col("active_start") <= high) & (F.col("active_end") >= low), F.lit(False))
    return F.when(F.col("kind") == "host", host).otherwise(guest)


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``position, node`` of the best shortest path, or no rows; ``source = target`` gives one row.

    Among equally short paths one that leaves the source through a hosted show wins, then the
    smallest sequence of node names. ``edges`` is a merged edge frame.
    """
    spark = edges.sparkSession
    weight = (F.col("kind") != "host").cast("int").alias("late")
    steps = edges.select(F.col("person").alias("node"), F.col("show").alias("next"), weight).unionByName(
        edges.select(F.col("show").alias("node"), F.col("person").alias("next"), weight)
    )
    steps = cut(steps)
    front = spark.createDataFrame([(source, 0, [source])], "node string, first int, path array<string>")
    seen, level = front.select("node"), 0
    found = front.where(F.col("node") == target)
    while not front.isEmpty() and found.isEmpty():
        first = F.col("late") if level == 0 else F.col("first")
        reached = (
            front.join(steps, "node")
            .join(seen.withColumnRenamed("node", "next"), "next", "left_anti")
            .groupBy(F.col("next").alias("node"))
            .agg(F.min(F.struct(first.alias("first"), F.concat("path", F.array("next")).alias("path"))).alias("b"))
            .select("node", "b.first", "b.path")
        )
        front = cut(reached)
        seen = seen.unionByName(front.select("node"))
        found = front.where(F.col("node") == target)
        level += 1
    return found.select(F.posexplode("path").alias("position", "node"))


def explain_path(path: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """One row ``message`` for a path of node keys, none without a path; ``names(node, name)`` gives what is shown."""
    hop = path.select(F.col("position").alias("p"), F.col("node").alias("before"))
    pairs = path.join(hop, F.col("position") == F.col("p") + 1, "left").drop("p")
    is_show = F.col("node").startswith("show")
    keyed = pairs.withColumn("show", F.when(is_show, F.col("node")).otherwise(F.col("before"))).withColumn(
        "person", F.when(is_show, F.col("before")).otherwise(F.col("node"))
    )
    kinds = keyed.join(edges.select("person", "show", "kind"), ["person", "show"], "left").join(names, "node", "left")
    host, odd = F.col("kind") == "host", F.col("position") % 2 == 1
    link = (
        F.when(F.col("position") == 0, "")
        .when(F.col("position") == 1, F.when(host, " is a host of ").otherwise(" was a guest on "))
        .when(~odd, F.when(host, ", which is hosted by ").otherwise(", who had as a guest "))
        .otherwise(", who was a guest on ")
    )
    part = F.struct("position", F.concat(link, F.coalesce("name", "node")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "")
    end = F.when(F.count(F.lit(1)) == 1, " is the same person.").otherwise(".")
    return kinds.groupBy().agg(F.count(F.lit(1)).alias("n"), F.concat(whole, end).alias("message")).where("n > 0").select("message")


def connect(edges: DataFrame, names: DataFrame, source: str, target: str) -> DataFrame:
    """``found, message, suggestion`` for two typed names of people of ``names(node, name)``: one row.

    The source is looked up first; an unknown name gives the most similar known one. Two known people
    without a path between them are told so.
    """
    spark = edges.sparkSession
    people = names.where(F.col("node").startswith("person"))
    asked = spark.createDataFrame([(source,), (target,)], "query string").distinct()
    known = {r["query"]: r["resolved"] for r in resolve_names(asked, people.select("name")).collect()}
    schema = "found boolean, message string, suggestion string"
    for typed in (source, target):
        if known[typed] is None:
            best = suggest_names(asked.where(F.col("query") == typed), people.select("name")).first()
            near = best["name"] if best else ""
            return spark.createDataFrame([(False, UNKNOWN.format(typed, near), near)], schema)
    ends = {r["name"]: r["node"] for r in people.where(F.col("name").isin(list(known.values()))).groupBy("name").agg(F.min("node").alias("node")).collect()}
    path = shortest_path(edges, ends[known[source]], ends[known[target]])
    row = explain_path(path, edges, names).first()
    message = row["message"] if row else UNCONNECTED.format(known[source], known[target])
    return spark.createDataFrame([(row is not None, message, "")], schema)


def resolve_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``query, resolved`` by exact, then by normalised name; null where neither fits."""
    wanted = queries.withColumn("key", text.normalize_graph(F.col("query")))
    by_key = names.groupBy(text.normalize_graph(F.col("name")).alias("key")).agg(F.min("name").alias("near"))
    exact = names.select(F.col("name").alias("query"), F.col("name").alias("exact")).distinct()
    return wanted.join(exact, "query", "left").join(by_key, "key", "left").select(
        "query", F.coalesce("exact", "near").alias("resolved")
    )


def suggest_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Most similar name per query by the better of plain and word-sorted ratio; ties to the smaller name.

    Queries are what users typed. They are sent to the names in blocks of at most :data:`QUERY_BLOCK`, every
    name is scored where it lies, and only one best name per query and task is shuffled.
    """
    asked = cut(queries.select("query", text.normalize_graph(F.col("query")).alias("q")).distinct())
    known = names.select("name", text.normalize_graph(F.col("name")).alias("k")).distinct()
    blocks = asked.count() // QUERY_BLOCK + 1
    number = F.row_number().over(Window.orderBy("query")) if blocks > 1 else F.lit(0)
    numbered = asked.withColumn("_block", F.pmod(number, F.lit(blocks)))
    best = None
    for block in range(blocks):
        pairs = known.join(F.broadcast(numbered.where(F.col("_block") == block).select("query", "q")), F.lit(True))
        scored = pairs.withColumn("score", name_match_score("q", "k"))
        part = scored.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
        best = part if best is None else best.unionByName(part)
    return best.select("query", "b.name", (-F.col("b.s")).alias("score"))
