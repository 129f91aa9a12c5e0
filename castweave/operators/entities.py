"""Entity resolution of people: blocking keys, candidate pairs, 67 pair features, scores and merges."""

from __future__ import annotations

import re

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castweave.functions import similarity as sim
from castweave.functions import text
from castweave.runtime import cut

BLOCK_LIMIT, PAIR_LIMIT, POOL_LIMIT = 200, 10_000, 250_000
COMMON_FIRST, COMMON_LAST = 5000.0, 500.0
# Alias rules (alias name, target name, show or blank).
KNOWN_ALIASES = (
    ("bill nye the science guy", "bill nye", ""),
    ("neil tyson", "neil degrasse tyson", "StarTalk Radio"),
    ("dr joe", "dr joe esposito", "The Von Haessler Doctrine"),
    ("dr drew", "dr drew pinsky", ""),
    ("christina p", "christina pazsitzky", ""),
    ("joey coco diaz", "joey diaz", ""),
)


def canonicals(observation: DataFrame) -> DataFrame:
    """One entity per normalised name of ``observation(normalized_name, observed_name, role, seen_at)``.

    The display name is the one observed most often, ties to the smaller name.
    """
    counted = observation.groupBy("normalized_name", "observed_name").agg(F.count(F.lit(1)).alias("n"))
    names = counted.groupBy("normalized_name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("observed_name").alias("d"))).alias("b"),
        F.array_sort(F.collect_set("observed_name")).alias("aliases"),
    )
    facts = observation.groupBy("normalized_name").agg(
        F.array_sort(F.collect_set("role")).alias("roles"),
        F.count(F.lit(1)).alias("observation_count"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
    )
    return names.join(facts, "normalized_name").select(
        text.stable_id(24, F.lit("person"), F.col("normalized_name")).alias("am_entity_id"),
        F.col("b.d").alias("display_name"), "normalized_name", "aliases", "roles", "observation_count", "first_seen_at", "last_seen_at",
    )


def alpha_tokens(normalized: Column) -> Column:
    return F.filter(text.tokens(normalized), lambda t: ~t.rlike(r"^\d+$"))


def blocking_keys(normalized: Column) -> Column:
    """Up to seven keys: token sets, first and last, first two, of plain and of cleaned tokens."""
    t, c = alpha_tokens(normalized), text.clean_tokens(normalized)
    joined = lambda a: F.array_join(F.array_sort(a), " ")
    first, last = text.first_or_empty, text.last_or_empty
    second = lambda a: F.coalesce(F.try_element_at(a, F.lit(2)), F.lit(""))
    keys = F.array(
        F.concat(F.lit("token-set:"), joined(t)),
        F.when(F.size(t) >= 2, F.concat(F.lit("first-last:"), first(t), F.lit(":"), last(t))),
        F.when(F.size(t) >= 2, F.concat(F.lit("first-two:"), first(t), F.lit(":"), second(t))),
        F.when(F.size(c) >= 1, F.concat(F.lit("clean-token-set:"), joined(c))),
        F.when(F.size(c) >= 2, F.concat(F.lit("clean-first-last:"), first(c), F.lit(":"), last(c))),
        F.when(F.size(c) >= 2, F.concat(F.lit("clean-first-two:"), first(c), F.lit(":"), second(c))),
        F.when(F.size(c) >= 2, F.concat(F.lit("clean-first-last-prefix:"), first(c), F.lit(":"), F.substring(last(c), 1, 4))),
    )
    return F.when(F.size(t) > 0, F.array_distinct(F.array_compact(keys))).otherwise(F.array().cast("array<string>"))


def block_pairs(profile: DataFrame, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """``left_id < right_id`` with their shared keys, from blocks of 2 to ``block_limit`` members.

    Block sizes are counted before pairs are made, so an oversized block never pairs up. The limit is
    part of this blocking scheme; :func:`block_class_pairs` gives what the blocks above it hold.
    """
    keyed = profile.select("entity_id", F.explode(blocking_keys(F.col("normalized_name"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, block_limit))
    kept = cut(keyed.join(sizes, "key").select("key", "entity_id"))
    left, right = kept.withColumnRenamed("entity_id", "left_id"), kept.withColumnRenamed("entity_id", "right_id")
    pairs = left.join(right, "key").where("left_id < right_id")
    return pairs.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("key")).alias("blocking_keys"))


def block_class_pairs(profile: DataFrame, block_limit: int = BLOCK_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): what blocks above ``block_limit`` hold, without pairing all their members.

    Members are put in classes by their cleaned tokens, whatever the order; ``membership(entity_id, class_id)`` names
    the smallest member. Pairs ``left_id < right_id`` are those of representatives that share an oversized block
    and whose cleaned tokens agree but for one, in either direction: that is all :func:`viable` accepts but close
    last names, which share the block of their prefix and meet here by a letter deleted from the last name.
    """
    clean = F.array_sort(text.clean_tokens(F.col("normalized_name")))
    keyed = profile.select("entity_id", "normalized_name", F.explode(blocking_keys(F.col("normalized_name"))).alias("key"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_limit).select("key")
    inside = cut(keyed.join(large, "key", "left_semi").select("entity_id", "normalized_name", F.array_join(clean, " ").alias("class")).distinct())
    first = inside.groupBy("class").agg(F.min("entity_id").alias("class_id"), F.min_by("normalized_name", "entity_id").alias("name"))
    membership = inside.join(first.select("class", "class_id"), "class").select("entity_id", "class_id")
    tokens = text.clean_tokens(F.col("name"))
    each = F.transform(F.filter(tokens, lambda t: F.lit(True)), lambda t: F.array_join(F.array_sort(F.array_except(tokens, F.array(t))), " "))
    last = text.last_or_empty(tokens)
    cut_one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(last), F.lit(1))), lambda i: F.concat(F.lit("last:"), text.first_or_empty(tokens), F.lit(":"), last.substr(F.lit(1), i - 1), last.substr(i + 1, F.length(last))))
    whole = F.array(F.array_join(F.array_sort(tokens), " "), F.concat(F.lit("last:"), text.first_or_empty(tokens), F.lit(":"), last))
    near = first.select("class_id", F.explode(F.array_distinct(F.concat(each, cut_one, whole))).alias("k")).where("k <> ''")
    left, right = near.withColumnRenamed("class_id", "left_id"), near.withColumnRenamed("class_id", "right_id")
    return left.join(right, "k").where("left_id < right_id").select("left_id", "right_id").distinct(), membership


def viable(left: Column, right: Column) -> Column:
    """Whether two normalised names may be one person: equal sets, a close last name, or two shared tokens."""
    a, b = text.clean_tokens(left), text.clean_tokens(right)
    same = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    close = sim.osa(text.last_or_empty(a), text.last_or_empty(b)).between(1, 2)
    return (
        (F.size(a) > 0)
        & (F.size(b) > 0)
        & (
            same(a, b)
            | same(text.alias_stripped(a), text.alias_stripped(b))
            | (F.size(F.array_intersect(a, b)) >= 2)
            | ((F.size(a) >= 2) & (F.size(b) >= 2) & (text.first_or_empty(a) == text.first_or_empty(b)) & close)
        )
    )


def profile_pairs(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs with both profiles as structs ``l`` and ``r``."""
    side = lambda s, key: profile.select(F.col("entity_id").alias(key), F.struct(*profile.columns).alias(s))
    return pairs.join(side("l", "left_id"), "left_id").join(side("r", "right_id"), "right_id")


def candidate_pairs(profile: DataFrame, limit: int = PAIR_LIMIT, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """The best viable pairs: most keys, most shared clean tokens, most observations of the rarer one."""
    joined = profile_pairs(block_pairs(profile, block_limit), profile)
    fits = joined.where(viable(F.col("l.normalized_name"), F.col("r.normalized_name")))
    shared = F.size(F.array_intersect(text.clean_tokens(F.col("l.normalized_name")), text.clean_tokens(F.col("r.normalized_name"))))
    rarer = F.least(F.coalesce("l.observation_count", F.lit(0)), F.coalesce("r.observation_count", F.lit(0)))
    ranked = fits.withColumns({"keys": F.size("blocking_keys"), "shared": shared, "rarer": rarer})
    return ranked.orderBy(F.desc("keys"), F.desc("shared"), F.desc("rarer"), "left_id", "right_id").limit(limit)


def near_in_graph(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs with ``near``: how many pairs of their shows are joined by some third entity.

    Third entities are counted per pair of shows once, so nothing is paired within a show; the
    two entities themselves are taken off the count.
    """
    on = profile.select("entity_id", F.array_sort(F.array_distinct(F.coalesce("podcast_ids", F.array().cast("array<bigint>")))).alias("s"))
    sets = on.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("n", "s", F.posexplode("s").alias("i", "a"))
    joined = first.select("n", "a", F.explode(F.slice("s", F.col("i") + 1, F.size("s"))).alias("b"))
    links = joined.groupBy("a", "b").agg(F.sum("n").alias("n"))
    side = lambda name: on.select(F.col("entity_id").alias(f"{name}_id"), F.col("s").alias(f"{name}_s"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    x, y = F.col("x"), F.col("y")
    spread = both.withColumn("x", F.explode("left_s")).withColumn("y", F.explode("right_s"))
    spread = spread.select("left_id", "right_id", "left_s", "right_s", "x", "y", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    own = lambda s: (F.array_contains(s, F.col("a")) & F.array_contains(s, F.col("b"))).cast("int")
    third = spread.join(links, ["a", "b"]).withColumn("t", F.col("n") - own("left_s") - own("right_s")).where("t > 0")
    near = third.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("near"))
    return pairs.join(near, ["left_id", "right_id"], "left").withColumn("near", F.coalesce("near", F.lit(0)))


def name_frequencies(counts: DataFrame, name: str, count: str) -> DataFrame:
    """``name, count, per_million`` from raw counts, names folded to lower case."""
    total = counts.agg(F.sum(count)).scalar()
    per = F.bround(F.sum(count) / total * 1_000_000, 6)
    return counts.groupBy(F.lower(name).alias("name")).agg(F.sum(count).alias("count"), per.alias("per_million"))


def pair_features(joined: DataFrame, first_names: dict[str, float] | None = None, last_names: dict[str, float] | None = None) -> DataFrame:
    """``left_id, right_id`` and the 67 features of pairs from :func:`profile_pairs`.

    A column ``near`` of :func:`near_in_graph` feeds the graph distance. Name frequencies (per
    million) are small dictionaries; without them those features are 0.
    """
    table = lambda d: F.create_map(*(F.lit(x) for x in chain(*(d or {"": 0.0}).items())))
    per_first, per_last = table(first_names), table(last_names)
    arr = lambda c, kind="array<string>": F.coalesce(F.col(c), F.array().cast(kind))
    tokens = {s: arr(f"{s}.alpha_tokens") for s in "lr"}
    third = F.col("near") if "near" in joined.columns else F.lit(0)
    base = joined.select(
        "left_id", "right_id", "l", "r", third.alias("near"),
        *(F.array_distinct(tokens[s]).alias(f"{s}t") for s in "lr"),
        *(tokens[s].alias(f"{s}raw") for s in "lr"),
        *(text.clean_tokens(F.col(f"{s}.normalized_name")).alias(f"{s}c") for s in "lr"),
        *(text.nickname_stripped(F.coalesce(f"{s}.display_name", F.lit("")), F.col(f"{s}.normalized_name")).alias(f"{s}n") for s in "lr"),
    )
    base = base.withColumns({f"{s}a": text.alias_stripped(F.col(f"{s}c")) for s in "lr"}).withColumns(
        {f"{s}g": F.filter(f"{s}c", lambda t: ~t.isin(text.ARTICLES)) for s in "lr"}
    )
    first, last = text.first_or_empty, text.last_or_empty
    c = F.col
    both = lambda x, y: F.size(F.array_intersect(x, y))
    same = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    spaced = lambda x: F.array_join(x, " ")
    extra = F.concat(F.filter("lc", lambda t: ~F.array_contains("rc", t)), F.filter("rc", lambda t: ~F.array_contains("lc", t)))
    proper = within(c("lc"), c("rc")) != within(c("rc"), c("lc"))
    group = {s: F.arrays_overlap(F.col(f"{s}c"), F.array(*map(F.lit, text.GROUP_WORDS))) for s in "lr"}
    last_edits = sim.osa(last(c("lc")), last(c("rc")))
    frequency = lambda table_, token: F.coalesce(F.element_at(table_, token), F.lit(0.0))
    last2 = lambda a: F.when(F.size(a) >= 2, F.element_at(a, -1)).otherwise("")
    pf = {s: frequency(per_first, first(c(f"{s}c"))) for s in "lr"}
    pl = {s: frequency(per_last, last2(c(f"{s}c"))) for s in "lr"}
    common = lambda x, y: F.when((x > 0) & (y > 0), F.bround(F.log1p(x) * F.log1p(y), 6)).otherwise(F.lit(0.0))
    sf = F.when((first(c("lc")) != "") & (first(c("lc")) == first(c("rc"))), pf["l"]).otherwise(F.lit(0.0))
    sl = F.when((last2(c("lc")) != "") & (last2(c("lc")) == last2(c("rc"))), pl["l"]).otherwise(F.lit(0.0))
    shows = [arr(f"{s}.podcast_ids", "array<bigint>") for s in "lr"]
    genres, roles = [arr(f"{s}.genres") for s in "lr"], [arr(f"{s}.roles") for s in "lr"]
    shared_shows = both(*shows)
    group_union = F.size(F.array_union("lg", "rg"))
    distance = F.when(shared_shows > 0, 2).when(c("near") > 0, 4)
    # The names and the order of the features.
    features = {
        "name_sequence_ratio": sim.seq_ratio("l.normalized_name", "r.normalized_name"),
        "token_jaccard": text.jaccard(c("lt"), c("rt")),
        "cleaned_name_sequence_ratio": sim.seq_ratio(spaced("lc"), spaced("rc")),
        "cleaned_token_jaccard": text.jaccard(c("lc"), c("rc")),
        "cleaned_token_overlap_count": both("lc", "rc"),
        "same_cleaned_token_set": same(c("lc"), c("rc")),
        "same_cleaned_token_order": c("lc") == c("rc"),
        "same_cleaned_first_token": first(c("lc")) == first(c("rc")),
        "same_cleaned_last_token": last(c("lc")) == last(c("rc")),
        "cleaned_last_name_damerau_similarity": sim.osa_sim(last(c("lc")), last(c("rc"))),
        "cleaned_full_name_damerau_similarity": sim.osa_sim(spaced("lc"), spaced("rc")),
        "cleaned_last_names_within_one_edit": last_edits == 1,
        "cleaned_last_names_within_two_edits": last_edits.between(1, 2),
        "same_cleaned_first_and_last_token": (first(c("lc")) == first(c("rc"))) & (last(c("lc")) == last(c("rc"))),
        "cleaned_first_last_swapped": (F.size("lc") >= 2) & (F.size("rc") >= 2) & (first(c("lc")) == last(c("rc"))) & (last(c("lc")) == first(c("rc"))),
        "nickname_stripped_name_sequence_ratio": sim.seq_ratio(spaced("ln"), spaced("rn")),
        "nickname_stripped_token_jaccard": text.jaccard(c("ln"), c("rn")),
        "nickname_stripped_token_overlap_count": both("ln", "rn"),
        "same_nickname_stripped_token_set": same(c("ln"), c("rn")),
        "alias_suffix_stripped_token_jaccard": text.jaccard(c("la"), c("ra")),
        "same_alias_suffix_stripped_token_set": same(c("la"), c("ra")),
        "one_name_has_quoted_nickname": F.coalesce(c("l.display_name").rlike(text.QUOTED), F.lit(False)) | F.coalesce(c("r.display_name").rlike(text.QUOTED), F.lit(False)),
        "token_overlap_count": both("lt", "rt"),
        "extra_cleaned_token_count": F.size(extra),
        "extra_cleaned_tokens_are_initials": (F.size(extra) > 0) & F.forall(extra, lambda t: F.length(t) == 1),
        "extra_cleaned_tokens_are_short": (F.size(extra) > 0) & F.forall(extra, lambda t: F.length(t) <= 2),
        "cleaned_token_containment_with_same_first_last": proper & (first(c("lc")) == first(c("rc"))) & (last(c("lc")) == last(c("rc"))),
        "cleaned_token_containment_with_different_last": proper & (last(c("lc")) != last(c("rc"))),
        "left_token_count": F.size("lt"),
        "right_token_count": F.size("rt"),
        "same_first_token": first(c("lraw")) == first(c("rraw")),
        "same_last_token": last(c("lraw")) == last(c("rraw")),
        "same_token_set": same(c("lt"), c("rt")),
        "one_name_contains_other_tokens": within(c("lt"), c("rt")) | within(c("rt"), c("lt")),
        "left_observation_count": c("l.observation_count"),
        "right_observation_count": c("r.observation_count"),
        "left_is_group_name": group["l"],
        "right_is_group_name": group["r"],
        "one_group_name": group["l"] != group["r"],
        "both_group_names": group["l"] & group["r"],
        "group_name_token_jaccard": text.jaccard(c("lg"), c("rg")),
        "same_group_name_tokens": (group_union > 0) & same(c("lg"), c("rg")),
        "shared_group_designator": F.arrays_overlap(F.array_intersect("lg", "rg"), F.array(*map(F.lit, text.GROUP_WORDS))),
        "left_first_name_per_million": pf["l"],
        "right_first_name_per_million": pf["r"],
        "max_first_name_per_million": F.greatest(pf["l"], pf["r"]),
        "left_last_name_per_million": pl["l"],
        "right_last_name_per_million": pl["r"],
        "max_last_name_per_million": F.greatest(pl["l"], pl["r"]),
        "left_name_commonness_score": common(pf["l"], pl["l"]),
        "right_name_commonness_score": common(pf["r"], pl["r"]),
        "max_name_commonness_score": F.greatest(common(pf["l"], pl["l"]), common(pf["r"], pl["r"])),
        "shared_first_name_per_million": sf,
        "shared_last_name_per_million": sl,
        "shared_name_commonness_score": common(sf, sl),
        "same_common_first_name": sf >= COMMON_FIRST,
        "same_common_last_name": sl >= COMMON_LAST,
        "same_common_first_and_last_name": (sf >= COMMON_FIRST) & (sl >= COMMON_LAST),
        "shared_podcast_count": shared_shows,
        "podcast_jaccard": text.jaccard(*shows),
        "shared_genre_count": both(*genres),
        "genre_jaccard": text.jaccard(*genres),
        "both_host_somewhere": F.array_contains(roles[0], "host") & F.array_contains(roles[1], "host"),
        "both_guest_somewhere": F.array_contains(roles[0], "guest") & F.array_contains(roles[1], "guest"),
        "role_jaccard": text.jaccard(*roles),
        "graph_distance_proxy": F.coalesce(distance, F.lit(0)),
        "has_graph_distance_proxy": distance.isNotNull(),
    }
    return base.select("left_id", "right_id", *(value.cast("double").alias(name) for name, value in features.items()))


# What counts for and against a match, with its weight; conditions over the features, where {x} is a
# feature with null as 0, and seq, tok, cseq, ctok, nseq, ntok are the similarities of plain, cleaned and nickname-free
# names (0 falls back to the plainer one).
SCORE_PARTS = {"seq": 0.22, "cseq": 0.28, "tok": 0.08, "ctok": 0.22}
SCORE_RULES = (
    ("same token set", 0.16, "{same_token_set} <> 0"),
    ("same cleaned token set", 0.14, "{same_cleaned_token_set} <> 0 AND {same_token_set} = 0"),
    ("same name after stripping quoted nickname", 0.22,
     "{one_name_has_quoted_nickname} <> 0 AND {same_nickname_stripped_token_set} <> 0 AND {same_cleaned_token_set} = 0"),
    ("one name contains the other's tokens", 0.08, "{one_name_contains_other_tokens} <> 0"),
    ("high nickname-stripped similarity", 0.06, "ntok >= 0.9 AND nseq >= 0.9"),
    ("high cleaned-name similarity", 0.05, "ctok >= 0.8 AND tok < ctok"),
    ("same first and last token", 0.08, "{same_first_token} <> 0 AND {same_last_token} <> 0"),
    ("same cleaned first and last token", 0.07,
     "{same_cleaned_first_token} <> 0 AND {same_cleaned_last_token} <> 0 AND NOT ({same_first_token} <> 0 AND {same_last_token} <> 0)"),
    ("same last token", 0.04,
     "{same_last_token} <> 0 AND {same_first_token} = 0 AND NOT ({same_cleaned_first_token} <> 0 AND {same_cleaned_last_token} <> 0)"),
    ("shared podcast with strong name overlap", "least(0.09, 0.04 + 0.015 * {shared_podcast_count})", "{shared_podcast_count} > 0 AND ctok >= 0.67"),
    ("shared podcast with weak name overlap", "least(0.025, 0.01 + 0.005 * {shared_podcast_count})", "{shared_podcast_count} > 0 AND ctok < 0.67"),
    ("nearby in graph", 0.03, "{shared_podcast_count} = 0 AND {graph_distance_proxy} = 4"),
    ("similar podcast genres", "least(0.05, 0.05 * {genre_jaccard})", "{genre_jaccard} <> 0"),
    ("same observed role mix", "least(0.03, 0.03 * {role_jaccard})", "{role_jaccard} <> 0"),
    ("low cleaned-name overlap", -0.18, "ctok < 0.5"),
    ("no strong cleaned-name match", -0.08, "ctok < 0.67 AND {same_cleaned_token_set} = 0"),
    ("low token overlap without shared podcast", -0.10, "tok < 0.34 AND {shared_podcast_count} = 0"),
    ("no graph proximity", -0.05, "{has_graph_distance_proxy} = 0 AND ctok < 0.5"),
)
# Most that a score may be, where a condition holds.
SCORE_GUARDS = (
    ("distinct group names are not person matches", 0.2, "{both_group_names} > 0 AND {same_group_name_tokens} = 0"),
    ("group name compared with person name", 0.3, "{one_group_name} > 0"),
)
ACCEPT, REJECT = 0.9, 0.2


def _read(expression: str | float) -> str:
    """A rule's expression over the columns of a feature row."""
    similar = {"seq": "{name_sequence_ratio}", "tok": "{token_jaccard}"}
    similar["cseq"] = "coalesce(nullif({cleaned_name_sequence_ratio}, 0), seq)"
    similar["ctok"] = "coalesce(nullif({cleaned_token_jaccard}, 0), tok)"
    similar["nseq"] = "coalesce(nullif({nickname_stripped_name_sequence_ratio}, 0), cseq)"
    similar["ntok"] = "coalesce(nullif({nickname_stripped_token_jaccard}, 0), ctok)"
    out = str(expression)
    for name in ("nseq", "ntok", "cseq", "ctok", "seq", "tok"):
        out = re.sub(rf"\b{name}\b", lambda _, n=name: f"({similar[n]})", out)
    return re.sub(r"\{(\w+)\}", r"coalesce(\1, 0D)", out)


def guarded(score: Column) -> Column:
    """Distinct group names are at most 0.2 alike, a group and a person at most 0.3."""
    out = score
    for _, most, when in reversed(SCORE_GUARDS):
        out = F.when(F.expr(_read(when)) & (score > most), F.lit(most)).otherwise(out)
    return out


def _plain_score() -> Column:
    total = sum((F.lit(w) * F.expr(_read(part)) for part, w in SCORE_PARTS.items()), F.lit(0.0))
    for _, weight, when in SCORE_RULES:
        total = total + F.when(F.expr(_read(when)), F.expr(f"cast({_read(weight)} AS double)")).otherwise(F.lit(0.0))
    return total


def heuristic_score() -> Column:
    """Score of a feature row from the tables of rules, between 0 and 0.999."""
    return F.bround(F.greatest(F.lit(0.0), F.least(guarded(_plain_score()), F.lit(0.999))), 6)


def score_reasons() -> Column:
    """Names of the rules that hold for a feature row, in the order of the tables, and of the guard that cut its score."""
    held = [F.when(F.expr(_read(when)), F.lit(reason)) for reason, _, when in SCORE_RULES]
    guard = F.lit(None).cast("string")
    for reason, most, when in reversed(SCORE_GUARDS):
        guard = F.when(F.expr(_read(when)) & (_plain_score() > most), F.lit(reason)).otherwise(guard)
    return F.array_compact(F.array(*held, guard))


def scored(features: DataFrame, accept: float = ACCEPT, reject: float = REJECT) -> DataFrame:
    """``left_id, right_id, score, reasons, decision``: accepted from ``accept`` on, rejected up to ``reject``, else a candidate."""
    out = features.select("left_id", "right_id", heuristic_score().alias("score"), score_reasons().alias("reasons"))
    decision = F.when(F.col("score") >= accept, "accepted").when(F.col("score") <= reject, "rejected").otherwise("candidate")
    return out.withColumn("decision", decision)


def merge_targets(pairs: DataFrame, canonical: DataFrame) -> DataFrame:
    """``target_id, source_id`` of accepted pairs: more observations, then the longer name, then the smaller."""
    side = lambda s: canonical.select(
        F.col("am_entity_id").alias(f"{s}_id"),
        F.struct(
            (-F.coalesce("observation_count", F.lit(0))).alias("o"), (-F.length("display_name")).alias("n"),
            F.col("display_name").alias("d"), F.col("am_entity_id").alias("i"),
        ).alias(s),
    )
    joined = pairs.join(side("left"), "left_id").join(side("right"), "right_id").where("left_id <> right_id")
    left_wins = F.col("left") < F.col("right")
    return joined.select(
        F.when(left_wins, F.col("left_id")).otherwise(F.col("right_id")).alias("target_id"),
        F.when(left_wins, F.col("right_id")).otherwise(F.col("left_id")).alias("source_id"),
        *(x for x in pairs.columns if x not in ("left_id", "right_id")),
    )


def apply_merges(targets: DataFrame, probability: str) -> DataFrame:
    """``source_id, target_id``: each source joins its most probable target, chains followed to their end.

    The sequential merge of one pair after another is replaced by this order-free form: among the
    targets of a source the one of highest probability (unknown ones last, then the smallest id) is taken.
    """
    best = targets.groupBy("source_id").agg(F.min(F.struct((-F.coalesce(probability, F.lit(-1.0))).alias("p"), "target_id")).alias("b"))
    links = cut(best.select("source_id", F.col("b.target_id").alias("target_id")))
    while True:
        up = links.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("up"))
        moved = cut(links.join(up, "target_id", "left").select("source_id", "target_id", "up"))
        if moved.where("up IS NOT NULL AND up <> target_id AND up <> source_id").isEmpty():
            return links
        links = moved.select("source_id", F.when(F.col("up") == F.col("source_id"), F.col("target_id")).otherwise(F.coalesce("up", "target_id")).alias("target_id"))


def apply_alias_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``names(name, podcast)`` with the target of the rule that fits, or their own name.

    A rule of ``rules(alias, target, podcast)`` with a blank podcast fits everywhere.
    """
    r = rules.select("alias", "target", F.col("podcast").alias("scope"))
    fits = (F.col("name") == F.col("alias")) & ((F.col("scope") == "") | (F.col("scope") == F.col("podcast")))
    return names.join(r, fits, "left").select("name", "podcast", F.coalesce("target", "name").alias("resolved"))


def uncertain_pairs(pairs: DataFrame, low: float = 0.35, high: float = 0.85, limit: int = 250) -> DataFrame:
    """Candidate pairs nearest to 0.5 within the closed range, then by ids."""
    kept = pairs.where((F.col("status") == "candidate") & F.col("match_probability").between(low, high))
    return kept.orderBy(F.abs(F.col("match_probability") - 0.5), "left_id", "right_id").limit(limit)


def train(features: DataFrame, label: str, names: list[str]):
    """Fitted scaler and logistic regression, both classes weighted to the same total.

    Needs ten labels of two classes; null features count as 0.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    filled = features.fillna(0.0, names)
    counts = {r[label]: r["count"] for r in filled.groupBy(label).count().collect()}
    if sum(counts.values()) < 10 or len(counts) < 2:
        raise ValueError("training needs at least ten labels of two classes")
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts.get(1, 1))).otherwise(total / (2 * counts.get(0, 1)))
    stages = [
        VectorAssembler(inputCols=names, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="_weight", maxIter=100),
    ]
    return Pipeline(stages=stages).fit(filled.withColumn("_weight", weight))
