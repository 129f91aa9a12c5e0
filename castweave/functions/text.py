"""Name and text functions as column expressions; they stay inside whole-stage code generation.

Four normalisers are kept apart on purpose: the graph's (accents folded), the extraction's (accented
letters become spaces), the display-name cleaner, and the entity tokeniser.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts that mark a show as not English, and the wider CJK test of chart imports.
NON_ENGLISH = r"[؀-ۿݐ-ݿࢠ-ࣿ一-鿿぀-ヿ가-힯]"
CHART_CJK = r"[㐀-鿿豈-﫿]"
# Compact names with a known spelling.
KNOWN_COMPACT = {"autopritts": "Auto Pritts"}
# Tokens that are no part of a person's name.
NOISE = (
    "dr doctor prof professor mr mrs ms miss sir dame rev reverend pastor rabbi imam fr father sen senator rep "
    "representative gov governor president lt gen general md phd ph d jr sr ii iii iv ret retired"
).split()
# Words that mark a group's name, and articles before them.
GROUP_WORDS = "band boys brother brothers crew duo family girls group sister sisters sketch squad team trio twins".split()
ARTICLES = ["a", "an", "the"]
QUOTED = "\"[^\"]+\"|“[^”]+”|‘[^’]+’|'[^']+'|\\([^)]*\\)"
# Signs of a guest in a title or description (case is ignored).
GUEST_SIGNALS = (
    r"\bwith\s+[A-Z][A-Za-z'.-]+",
    r"\bw/\s*[A-Z][A-Za-z'.-]+",
    r"\bguests?\s*:",
    r"\bfeatur(?:e|ing|es)\s+[A-Z][A-Za-z'.-]+",
    r"\bjoined by\s+[A-Z][A-Za-z'.-]+",
    r"\binterview with\s+[A-Z][A-Za-z'.-]+",
    r"\bconversation with\s+[A-Z][A-Za-z'.-]+",
    r"\bwelcomes\s+[A-Z][A-Za-z'.-]+",
    r"\bsits down with\s+[A-Z][A-Za-z'.-]+",
)
# Fixed value: the offline guest extractor's pattern.
LOCAL_GUEST = r"\b(?:with|w/|featuring|guest)[ \t]+([A-Z][A-Za-z.'-]+(?:[ \t]+[A-Z][A-Za-z.'-]+){1,3})"


def _fold_table() -> tuple[str, str]:
    """Accented small letters and their base letters, by Unicode decomposition."""
    import unicodedata

    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)):
        char = chr(code).lower()
        base = unicodedata.normalize("NFKD", char)[0].lower()
        if len(char) == 1 and base != char and base.isascii() and base.isalnum():
            pairs.append((char, base))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_extraction(c: Column) -> Column:
    """Lower case; every run of other than a-z and 0-9 becomes one space; blank edges dropped."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_graph(c: Column) -> Column:
    """Accents folded, ``&`` read as and, other signs to single spaces."""
    accented, plain = _fold_table()
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{M}+", ""), "ß", "ss")
    folded = F.translate(bare, accented, plain)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "&", " and "), "[^a-z0-9]+", " "))


def split_compact(c: Column) -> Column:
    """Camel case to words."""
    c = F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")
    return F.regexp_replace(c, "(?<=[A-Z])(?=[A-Z][a-z])", " ")


def title_case(c: Column) -> Column:
    """First letter after any non-letter to upper case, the others to lower (unlike ``initcap``)."""
    pieces = F.regexp_extract_all(c, F.lit(r"([A-Za-zÀ-ÖØ-öø-ÿ]+|[^A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def is_all_caps(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return (F.length(letters) > 2) & (F.upper(letters) == letters)


def clean_display_name(c: Column) -> Column:
    """Handles to words, camel case split, a final "here" and handle digits dropped, capitals eased."""
    name = F.trim(c)
    handle = r"^@([A-Za-z][A-Za-z0-9_]{2,30})$"
    name = F.when(name.rlike(handle), F.translate(F.regexp_extract(name, handle, 1), "_", " ")).otherwise(name)
    name = split_compact(name)
    known = F.create_map(*(F.lit(x) for x in chain(*KNOWN_COMPACT.items())))
    name = F.coalesce(F.element_at(known, F.lower(name)), name)
    words = F.split(squeeze(name), " ")
    ends_here = (F.size(words) >= 3) & (F.lower(F.element_at(words, -1)) == "here")
    name = F.when(ends_here, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(name)
    digits = r"(?<=[A-Za-z])\d{1,4}$"
    name = F.when(squeeze(name).contains(" "), F.regexp_replace(squeeze(name), digits, "")).otherwise(name)
    return squeeze(F.when(is_all_caps(name), title_case(name)).otherwise(name))


def tokens(c: Column) -> Column:
    """Runs of a-z or of digits in lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+|\d+)"), F.lit(1))


def clean_tokens(c: Column) -> Column:
    """Tokens without digits and noise words; repeated tokens stay."""
    noise = F.array(*map(F.lit, NOISE))
    return F.filter(tokens(c), lambda t: ~t.rlike(r"^\d+$") & ~F.array_contains(noise, t))


def is_single_token(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))) < 2


def first_or_empty(a: Column) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))


def last_or_empty(a: Column) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))


def alias_stripped(a: Column) -> Column:
    """Last token without a repeated first token at its end, where more than two letters remain."""
    first, last = first_or_empty(a), last_or_empty(a)
    cut = (F.size(a) >= 2) & last.endswith(first) & (F.length(last) > F.length(first) + 2)
    head = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.when(cut, F.concat(head, F.array(F.substr(last, F.lit(1), F.length(last) - F.length(first))))).otherwise(a)


def nickname_stripped(display: Column, fallback: Column) -> Column:
    """Clean tokens without quoted or bracketed parts; those of ``fallback`` where none are left."""
    stripped = clean_tokens(F.regexp_replace(display, QUOTED, " "))
    return F.when(F.size(stripped) > 0, stripped).otherwise(clean_tokens(fallback))


def is_english_name(c: Column) -> Column:
    return ~c.rlike(NON_ENGLISH)


def is_english_code(c: Column) -> Column:
    code = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    return (code == "") | (code == "en") | code.startswith("en-")


def stable_id(length: int, *parts: Column) -> Column:
    """First hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def truncate_words(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space and marked with three points."""
    head = F.regexp_replace(F.substring(F.trim(c), 1, limit), r"\s\S*$", "")
    return F.when(F.length(F.trim(c)) <= limit, F.trim(c)).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def bounded_text(c: Column, limit: int) -> Column:
    """Longer texts keep their head, three points and 12 hex digits of their hash; NUL is removed."""
    plain = F.translate(c, "\0", "")
    return F.when(F.length(plain) <= limit, plain).otherwise(
        F.concat(F.substring(plain, 1, limit - 16), F.lit("..."), F.lit("-"), F.substring(F.sha2(plain, 256), 1, 12))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard rounded half to even on six places; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.bround(F.size(F.array_intersect(a, b)) / union, 6)).otherwise(F.lit(0.0))


def explicit_flag(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin("yes", "true", "explicit"), True).when(text.isin("no", "false", "clean"), False)


def has_guest_signal(c: Column) -> Column:
    return c.rlike("(?i)(?:" + "|".join(GUEST_SIGNALS) + ")")


def local_guest(c: Column) -> Column:
    """Name the offline extractor finds, or null."""
    return F.nullif(F.trim(F.regexp_extract(c, LOCAL_GUEST, 1)), F.lit(""))


def web_genres(metadata: Column) -> Column:
    """Legacy categories, trimmed, first order kept, blanks dropped."""
    raw = F.coalesce(metadata["legacy"]["categories"], F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(raw, F.trim), lambda g: g != ""))


def entity_genres(metadata: Column) -> Column:
    """Legacy categories and chart sources as a sorted lower-case set."""
    empty = F.array().cast("array<string>")
    both = F.concat(
        F.coalesce(metadata["legacy"]["categories"], empty), F.coalesce(metadata["apple_podcasts"]["chart_sources"], empty)
    )
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, lambda g: F.lower(F.trim(g))), lambda g: g != "")))


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct substrings of ``n`` characters; a shorter text is its own only one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n))))


def ngram_distance(a: Column, b: Column, n: int = 3) -> Column:
    """One minus the Jaccard index of the two sets of substrings."""
    x, y = ngrams(a, n), ngrams(b, n)
    return 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def is_resolved_name(c: Column) -> Column:
    """A usable full name: two words or more, no brackets, and not said to be unknown."""
    vague = c.rlike(r"(?i)[\[\](){}<>]|\bunknown\b|not provided")
    return ~vague & (F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")) >= 2)


def loose_boolean(c: Column) -> Column:
    """``true/yes/1`` and ``false/no/0`` in any case; null otherwise."""
    text = F.lower(F.trim(c))
    return F.when(text.isin("true", "yes", "1", "t"), True).when(text.isin("false", "no", "0", "f"), False)


def loose_list(c: Column) -> Column:
    """A list literal with either kind of quotes as an array of strings; null where it is none."""
    return F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>")


def merged(old: Column, new: Column, fields: list[str]) -> Column:
    """Struct of ``fields`` of ``new`` where they are set, else of ``old``."""
    return F.struct(*(F.coalesce(new[f], old[f]).alias(f) for f in fields))
