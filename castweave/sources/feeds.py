"""Feeds and files: RSS payloads to episodes, chart lists, edge lists, fixtures, and keyed sinks.

Fetching is not part of this engine: a table of raw payloads is the input.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castweave.functions import text
from castweave.operators.timestamps import instant_ms, read_times
from castweave.runtime import ship

ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "guid", "link", "title", "description", "published", "updated", "enclosure", "duration", "explicit")]
)
FEED = T.StructType(
    [
        T.StructField("feed_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("items", T.ArrayType(ITEM)),
        T.StructField("error", T.StringType()),
    ]
)
_NAMES = {"guid": "guid", "id": "id", "link": "link", "title": "title", "description": "description", "summary": "description",
          "pubDate": "published", "published": "published", "updated": "updated", "duration": "duration", "explicit": "explicit"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_feed(payload: bytes | None, max_items: int | None = None) -> dict:
    """RSS or Atom bytes to feed fields and items; ``error`` tells why nothing could be read.

    The cap on items applies before items are read. Blank texts are empty strings.
    """
    empty = {"title": "", "description": "", "link": "", "image": "", "language": "", "items": [], "error": None}
    if not payload:
        return empty | {"error": "empty payload"}
    try:
        root = ET.fromstring(payload)
    except ET.ParseError as error:
        return empty | {"error": f"parse: {error}"}
    head = next((e for e in root.iter() if _local(e.tag) in ("channel", "feed")), root)
    feed, items = dict(empty), []
    nodes = [e for e in root.iter() if _local(e.tag) in ("item", "entry")]
    for child in head:
        name, value = _local(child.tag), (child.text or "").strip()
        if name in ("title", "link", "language") and not feed[name]:
            feed[name] = value or child.get("href", "")
        elif name in ("description", "subtitle", "summary") and not feed["description"]:
            feed["description"] = value
        elif name == "image" and not feed["image"]:
            url = next((g.text or "" for g in child if _local(g.tag) == "url"), "")
            feed["image"] = (url or child.get("href", "")).strip()
    for node in nodes[:max_items]:
        item = dict.fromkeys((f.name for f in ITEM), "")
        linked = ""
        for child in node:
            name, value = _local(child.tag), (child.text or "").strip()
            if name == "enclosure" and not item["enclosure"]:
                item["enclosure"] = child.get("url") or child.get("href") or ""
            elif name == "link" and child.get("rel") == "enclosure":
                linked = linked or child.get("href", "")
            elif name in _NAMES and not item[_NAMES[name]]:
                item[_NAMES[name]] = value or (child.get("href", "") if name == "link" else "")
        item["enclosure"] = item["enclosure"] or linked
        items.append(item)
    return feed | {"items": items}


def parse_feeds(payloads: DataFrame, max_items: int | None = None) -> DataFrame:
    """One row per feed of ``payloads(feed_id, payload)`` with its items as structs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"feed_id": f} | parse_feed(p, max_items) for f, p in zip(batch["feed_id"], batch["payload"], strict=True)]
            yield pd.DataFrame(rows, columns=[f.name for f in FEED])

    return payloads.select("feed_id", "payload").mapInPandas(run, FEED)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


# Fixed value: what an item without title is called.
UNTITLED = "Untitled episode"


def guid_of(id_: Column, guid: Column, link: Column, title: Column, published: Column) -> Column:
    """First of id, guid and link that is not blank, else a hash of title and date."""
    named = F.coalesce(_filled(title), F.lit(UNTITLED))
    made = F.concat(F.lit("generated:"), F.sha2(F.concat_ws("|", named, F.coalesce(F.trim(published), F.lit(""))), 256))
    return F.coalesce(_filled(id_), _filled(guid), _filled(link), made)


def episodes_of(parsed: DataFrame) -> DataFrame:
    """Episodes of parsed feeds: guid fallback, bounded texts, three-valued explicit flag, time in UTC, raw fields.

    ``published_at`` is the instant of the item's date, or of its update; null where neither can be read.
    ``raw`` maps the kept fields of the item, without blank ones.
    """
    i = parsed.select("feed_id", F.explode("items").alias("i")).withColumn("_date", F.coalesce(_filled(F.col("i.published")), _filled(F.col("i.updated"))))
    read = read_times(i.withColumn("_zone", F.lit("UTC")), "_date", "_zone")
    instant = F.coalesce(F.col("epoch_ms"), instant_ms())
    kept = F.map_filter(
        F.create_map(*(x for f in ("id", "guid", "title", "link", "published", "updated", "duration", "explicit") for x in (F.lit(f), F.col(f"i.{f}")))),
        lambda _, v: v != "",
    )
    return read.select(
        "feed_id",
        guid_of(*(F.col(f"i.{x}") for x in ("id", "guid", "link", "title", "published"))).alias("guid"),
        text.bounded_text(F.coalesce(_filled(F.col("i.title")), F.lit(UNTITLED)), 500).alias("title"),
        F.trim("i.description").alias("description"),
        F.timestamp_millis(instant).alias("published_at"),
        text.bounded_text(F.col("i.link"), 1000).alias("episode_url"),
        text.bounded_text(F.col("i.enclosure"), 1000).alias("enclosure_url"),
        F.col("i.duration").alias("duration_raw"),
        text.explicit_flag(F.col("i.explicit")).alias("explicit"),
        kept.alias("raw"),
    )


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one whose ``order`` columns are largest. Combines map-side, without a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows of ``old`` with the same keys; other old rows stay. Null keys never match."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def snapshots(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed payloads not stored yet: ``feed_id, content_hash, path, payload``."""
    hashed = payloads.withColumn("content_hash", F.sha2("payload", 256)).dropDuplicates(["feed_id", "content_hash"])
    path = F.format_string("rss/%d/%s.xml", F.col("feed_id"), F.substring("content_hash", 1, 16))
    return hashed.withColumn("path", path).join(stored.select("feed_id", "content_hash"), ["feed_id", "content_hash"], "left_anti")


def chart_ids(lists: DataFrame) -> DataFrame:
    """Charts ``(label, position, id)`` to one row per id in first order with its sorted labels; blank ids dropped."""
    named = lists.where(F.col("id").isNotNull() & (F.trim("id") != ""))
    return named.groupBy("id").agg(
        F.min(F.struct("position", "label")).alias("_first"), F.array_sort(F.collect_set("label")).alias("chart_sources")
    ).select("id", F.col("_first.position").alias("position"), "chart_sources")


def genre_ids(tree: dict) -> list[int]:
    """Ids of a nested genre tree, depth first, each once."""
    found: list[int] = []

    def walk(level: dict) -> None:
        for key, node in level.items():
            if str(key).isdigit() and int(key) not in found:
                found.append(int(key))
            walk((node or {}).get("subgenres") or {})

    walk(tree)
    return found


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Three tab-separated fields ``left, right, attributes``; other lines are skipped, kind defaults to guest."""
    part = F.split("value", "\t")
    attrs = F.col("p")[2]
    pick = lambda key: _filled(F.regexp_extract(attrs, f"['\"]{key}['\"]\\s*:\\s*['\"]([^'\"]*)", 1))
    day = F.substring(pick("date"), 1, 10)
    kind = F.coalesce(pick("kind"), F.lit("guest"))
    lines = spark.read.text(path).select(part.alias("p")).where(F.size("p") == 3)
    return lines.select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right"), kind.alias("kind"), day.alias("date")).withColumns(
        {"active_start": F.when(F.col("kind") == "host", F.col("date")), "active_end": F.when(F.col("kind") == "host", F.col("date"))}
    )


def read_fixture(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON array of ``{pk, fields}`` records as ``pk`` and the typed ``fields``."""
    raw = spark.read.schema(f"pk long, fields struct<{fields}>").json(path, multiLine=True)
    return raw.select("pk", "fields.*")


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated file with header whose first column is a row index and is dropped."""
    reader = spark.read.option("sep", "\t").option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.drop(df.columns[0])


def request_lines(df: DataFrame, id_: Column, body: list[str]) -> DataFrame:
    """One JSON document per row, for a text sink: ``custom_id`` and ``body``."""
    return df.select(F.to_json(F.struct(F.concat(F.lit("episode-"), id_).alias("custom_id"), F.struct(*body).alias("body"))).alias("value"))


def response_rows(lines: DataFrame) -> DataFrame:
    """Responses back to rows: episode id, status and guests of the first output text."""
    schema = "custom_id string, response struct<status_code int, body struct<output array<struct<content array<struct<type string, text string>>>>>>, error string"
    r = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    parts = F.flatten(F.transform("response.body.output", lambda o: o["content"]))
    body = F.filter(parts, lambda p: p["type"] == "output_text")
    output = F.try_element_at(body, F.lit(1))["text"]
    guests = F.from_json(output, "guests array<struct<name string, confidence double, evidence string>>")["guests"]
    state = (
        F.when(F.col("error").isNotNull(), "failed").when(F.col("response.status_code") != 200, "failed").when(guests.isNull(), "unreadable")
    ).otherwise("succeeded")
    episode = F.regexp_extract("custom_id", r"^episode-(\d+)$", 1).try_cast("long")
    return r.select(episode.alias("episode_id"), state.alias("status"), guests.alias("guests"))


def copy_clean(df: DataFrame, booleans: list[str] = ()) -> DataFrame:
    """A table ready for another database: NUL removed from strings, 0/1 columns to booleans."""
    out = df.withColumns({c: F.translate(F.col(c), "\0", "") for c, t in df.dtypes if t == "string"})
    return out.withColumns({c: F.col(c).cast("boolean") for c in booleans})


ship(__name__)
