"""Queries of the training-data operators of this subpackage, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from castweave.llm import contract, encoding, leakage, names, packing, pii
from castweave.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.found_groups(table(spark, sf_dir, "candidate_pair"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(table(spark, sf_dir, "person"), table(spark, sf_dir, "entity_profile"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = encoding.damaged_tables(table(spark, sf_dir, "parsed_episode"), table(spark, sf_dir, "podcast"))
    return damaged.select("source_table", "record_id", "field").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = encoding.damaged_tables(table(spark, sf_dir, "parsed_episode"), table(spark, sf_dir, "podcast"))
    return damaged.select("source_table", "record_id", "field", "restored", "labels")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    leaks = leakage.find_leaks(documents, "doc_id", "text", items, "item_id", "text")
    return leaks.select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_in(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A deployment sets its own secret; the test tables hold nothing to hide.
    key = spark.conf.get("spark.castweave.pii.key", "key of the test tables")
    return pii.redact_in(table(spark, sf_dir, "documents"), "doc_id", "text", key)


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

SQL = {
    "p1_found": """
        WITH RECURSIVE e AS (
            SELECT left_id AS a, right_id AS b FROM candidate_pair WHERE status = 'accepted' AND left_id <> right_id
            UNION SELECT right_id, left_id FROM candidate_pair WHERE status = 'accepted' AND left_id <> right_id),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS am_entity_id, min(b) AS group_id FROM r GROUP BY a""",
}
