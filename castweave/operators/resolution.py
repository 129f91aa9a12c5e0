"""The chain of entity resolution around the pairs: observations, links, profiles, labelled examples, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castweave.functions import text
from castweave.operators import entities as E
from castweave.runtime import cut

PROVIDER, EXACT = "appearance", "exact_name"
#: Share of the labelled examples that is held out, and how many of a class must be there for that.
HOLDOUT, LEAST_PER_CLASS = 0.25, 5


def observations(appearance: DataFrame) -> DataFrame:
    """One row per appearance ``(episode_id, podcast_id, person_id, name, role, published_at)``.

    The id depends on provider, episode, person and role, so a repeated run gives the same rows; repeats collapse.
    """
    id_ = text.stable_id(24, F.lit(PROVIDER), F.col("episode_id").cast("string"), F.col("person_id").cast("string"), F.col("role"))
    return appearance.where(F.col("name").isNotNull()).select(
        id_.alias("observation_id"), "episode_id", "podcast_id", "person_id", "role",
        F.col("name").alias("observed_name"), text.normalize_extraction(F.col("name")).alias("normalized_name"),
        F.col("published_at").alias("seen_at"),
    ).dropDuplicates(["observation_id"])


def links(observation: DataFrame, existing: DataFrame) -> DataFrame:
    """``observation_id, am_entity_id, method`` after a run: links made otherwise than by the exact name are kept.

    ``existing`` has the same columns; links of observations that are gone are dropped.
    """
    exact = observation.select(
        "observation_id", text.stable_id(24, F.lit("person"), F.col("normalized_name")).alias("_made")
    )
    kept = existing.where(F.col("method") != EXACT).groupBy("observation_id").agg(
        F.min(F.struct("am_entity_id", "method")).alias("_kept")
    )
    return exact.join(kept, "observation_id", "left").select(
        "observation_id",
        F.coalesce("_kept.am_entity_id", "_made").alias("am_entity_id"),
        F.coalesce("_kept.method", F.lit(EXACT)).alias("method"),
    )


def profiles(canonical: DataFrame, link: DataFrame, observation: DataFrame, genres: DataFrame, least: int = 1) -> DataFrame:
    """Profiles of the entities with at least ``least`` observations; shows and genres by their links.

    ``genres(podcast_id, genres)`` holds each show's list. Entities without links have empty lists.
    """
    seen = link.join(observation.select("observation_id", "podcast_id"), "observation_id").where("podcast_id IS NOT NULL")
    seen = seen.select(F.col("am_entity_id").alias("entity_id"), "podcast_id").distinct()
    shows = seen.groupBy("entity_id").agg(F.array_sort(F.collect_set("podcast_id")).alias("podcast_ids"))
    named = seen.join(genres, "podcast_id").select("entity_id", F.explode("genres").alias("genre")).distinct()
    kinds = named.groupBy("entity_id").agg(F.array_sort(F.collect_set("genre")).alias("genres"))
    tokens = text.tokens(F.col("normalized_name"))
    own = canonical.where(F.col("observation_count") >= least).select(
        F.col("am_entity_id").alias("entity_id"), "display_name", "normalized_name", tokens.alias("tokens"),
        E.alpha_tokens(F.col("normalized_name")).alias("alpha_tokens"), "observation_count",
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
    )
    return own.join(shows, "entity_id", "left").join(kinds, "entity_id", "left").withColumns(
        {
            "podcast_ids": F.coalesce("podcast_ids", F.array().cast("array<bigint>")),
            "genres": F.coalesce("genres", F.array().cast("array<string>")),
        }
    )


def examples(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows of labelled pairs with ``label`` 1 for accepted and 0 for rejected; contradictory pairs are left out."""
    side = (F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    labelled = pairs.where(F.col("status").isin("accepted", "rejected") & (F.col("left_id") != F.col("right_id")))
    label = (F.col("status") == "accepted").cast("int")
    judged = labelled.select(*side, label.alias("l")).groupBy("left_id", "right_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    return features.join(judged.where("lo = hi").select("left_id", "right_id", F.col("lo").alias("label")), ["left_id", "right_id"])


def probabilities(model: PipelineModel, features: DataFrame, names: list[str]) -> DataFrame:
    """``features`` with ``probability`` of a match; null features count as 0."""
    return model.transform(features.fillna(0.0, names)).withColumn("probability", vector_to_array("probability")[1]).drop(
        "_raw", "_scaled", "rawPrediction", "prediction"
    )


def measure(rows: DataFrame, at: float = 0.5) -> dict[str, float]:
    """Accuracy, precision, recall, F1 and area under the ROC curve of ``rows(label, probability)``.

    The area is that of the ranks, ties counting half; it is computed from one row per probability.
    """
    yes, true = F.col("probability") >= at, F.col("label") == 1
    c = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(yes & true, 1)).alias("tp"), F.count(F.when(yes & ~true, 1)).alias("fp"),
        F.count(F.when(~yes & true, 1)).alias("fn"), F.count(F.when(true, 1)).alias("pos"),
    ).first()
    ratio = lambda a, b: a / b if b else 0.0
    precision, recall = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    negatives = c["n"] - c["pos"]
    area = 0.0
    if c["pos"] and negatives:
        judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC", numBins=0)
        area = judge.evaluate(rows.select(F.col("label").cast("double").alias("label"), "probability"))
    return {
        "holdout_examples": c["n"], "accuracy": ratio(c["n"] - c["fp"] - c["fn"], c["n"]), "precision": precision,
        "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "roc_auc": area,
    }


def train_measured(rows: DataFrame, names: list[str], seed: int = 42) -> tuple[PipelineModel, dict[str, float]]:
    """A model of all examples and the measures of one that a quarter of each class was held out from.

    The held-out quarter is drawn by a seeded hash of the pair. With fewer than five examples of a class nothing is
    held out and there are no measures.
    """
    rows = cut(rows)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    found: dict[str, float] = {}
    if len(counts) > 1 and min(counts.values()) >= LEAST_PER_CLASS:
        order = F.xxhash64(F.lit(seed), "left_id", "right_id")
        cuts = rows.groupBy("label").agg(F.percentile_approx(order, HOLDOUT, 10_000).alias("_bar"))
        split = rows.join(F.broadcast(cuts), "label").withColumn("_out", order <= F.col("_bar"))  # two rows
        model = E.train(split.where(~F.col("_out")).drop("_bar", "_out"), "label", names)
        found = measure(probabilities(model, split.where("_out").drop("_bar", "_out"), names))
    return E.train(rows, "label", names), found


def weights(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Features of a fitted model by the size of their weight on the scaled values, the largest first."""
    return sorted(zip(names, model.stages[-1].coefficients.tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def known_hosts(appearance: DataFrame, candidate: DataFrame, podcast: DataFrame, least: float = 0.9) -> DataFrame:
    """``podcast_id, name, kind``: hosts a prompt may name, best source first.

    ``confirmed`` from host appearances, ``extracted`` from host candidates ``(podcast_id, name, role, confidence)`` of at
    least ``least``, ``metadata`` from the show's own metadata; a name of a show counts with its best source.
    """
    from castweave.operators.relational import metadata_hosts

    ranked = [
        appearance.where("role = 'host'").select("podcast_id", "name", F.lit(0).alias("_k")),
        candidate.where((F.col("role") == "host") & (F.col("confidence") >= least)).select("podcast_id", "name", F.lit(1).alias("_k")),
        metadata_hosts(podcast).select("podcast_id", "name", F.lit(2).alias("_k")),
    ]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).where("name IS NOT NULL AND trim(name) <> ''")
    best = every.groupBy("podcast_id", text.normalize_extraction(F.col("name")).alias("_n")).agg(F.min(F.struct("_k", "name")).alias("b"))
    kind = F.element_at(F.array(F.lit("confirmed"), F.lit("extracted"), F.lit("metadata")), F.col("b._k") + 1)
    return best.select("podcast_id", "b.name", kind.alias("kind"))
