"""Column functions on strings.  All of them stay in the JVM; a null counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it, for patterns in (?U) mode.
_EDGE = r"(?U)^\s+|\s+$"
#: Strings that stand for a missing value in exports.
SENTINELS = ("__NULL__", "__EMPTY__", "None")

#: Names that mean the same.
SYNONYM_GROUPS = (
    ("arabian gulf", "persian gulf"),
    ("formosa strait", "taiwan strait"),
    ("strait of hormuz", "hormuz strait"),
    ("south china sea", "scs"),
    ("sea of japan", "east sea"),
)
#: Words that do not relate two names.
STOP_WORDS = ("the", "and", "for", "uss", "usns", "hmas", "hmcs", "in", "of", "on", "at", "to")

#: Topics kept, and topics left out, by the news filters.
KEYWORDS = (
    "USS", "USNS", "CVN", "DDG", "SSN", "SSBN", "CG-", "LHD", "LHA", "LPD", "LSD", "LCAC",
    "Navy", "Naval", "fleet", "carrier", "destroyer", "submarine", "cruiser",
    "amphibious", "sealift", "strike group", "battle group",
    "INDOPACOM", "EUCOM", "CENTCOM", "SOUTHCOM", "AFRICOM",
    "7th Fleet", "5th Fleet", "6th Fleet", "2nd Fleet", "3rd Fleet", "4th Fleet", "10th Fleet",
    "Naval Station", "Naval Base", "Naval Air Station",
)
EXCLUDED_TOPICS = (
    "community event", "mental health", "therapy", "partnership with",
    "charity", "fundrais", "volunteer", "wellness", "yoga", "diversity", "inclusion",
    "talkspace", "insurance", "hiring", "recruitment fair",
)


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands between word boundaries, in either case."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, _EDGE, "")


def normal(value: Column) -> Column:
    """Lower case without white space at the ends; null becomes empty."""
    return F.lower(stripped(F.coalesce(value.cast("string"), F.lit(""))))


def property_value(value: Column, sentinels: bool = True) -> Column:
    """A property as it is compared: sentinels, tested before lower-casing, count as empty."""
    s = stripped(F.coalesce(value.cast("string"), F.lit("")))
    return F.lower(F.when(s.isin(*SENTINELS), F.lit("")).otherwise(s) if sentinels else s)


def tokens(value: Column) -> Column:
    """The set of words, lower case, split at white space."""
    return F.array_distinct(F.array_remove(F.split(normal(value), r"(?U)\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def contained(a: Column, b: Column) -> Column:
    """Whether one normal string contains the other; an empty one contains nothing and is nowhere."""
    x, y = normal(a), normal(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def parse_aliases(value: Column, bars: bool = True) -> Column:
    """An array from '{a,b}', 'a||b', a JSON array, or one plain name.

    bars=False: '||' is an ordinary part of a name.
    """
    s = stripped(F.coalesce(value, F.lit("")))
    quotes = r"""^["']+|["']+$"""
    braces = F.transform(F.split(F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))), ","), lambda x: F.regexp_replace(F.trim(x), quotes, ""))
    listed = F.from_json(s, "array<string>")
    out = F.when(s == "", F.array().cast("array<string>")).when(s.startswith("{") & s.endswith("}"), F.array_remove(braces, ""))
    if bars:
        out = out.when(s.contains("||"), F.array_remove(F.transform(F.split(s, r"\|\|"), lambda x: F.trim(x)), ""))
    return out.when(s.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(s))


def alias_keys(name: Column, aliases: Column) -> Column:
    """The normal forms of a name and its aliases, empty aliases left out."""
    return F.array_distinct(F.concat(F.array(normal(name)), F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), normal), lambda x: x != "")))


def synonyms(keys: Column) -> Column:
    """What the keys' groups of synonyms hold."""
    groups = F.array(*(F.array(*map(F.lit, g)) for g in SYNONYM_GROUPS))
    return F.array_distinct(F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, keys))))


def significant_words(name: Column) -> Column:
    return F.filter(tokens(name), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP_WORDS))


def related(name_a: Column, name_b: Column, aliases_a: Column, aliases_b: Column) -> Column:
    """The blocking predicate: equal or contained names, a common alias or synonym, or a common significant word."""
    a, b = normal(name_a), normal(name_b)
    ka, kb = alias_keys(name_a, aliases_a), alias_keys(name_b, aliases_b)
    return F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(ka, kb) | F.arrays_overlap(synonyms(ka), kb) | F.arrays_overlap(significant_words(name_a), significant_words(name_b))


def name_tier(name_a: Column, name_b: Column, aliases_a: Column, aliases_b: Column) -> Column:
    """1 for equal names, 0.95 if a name is an alias of the other, else the words' Jaccard similarity."""
    a, b = normal(name_a), normal(name_b)
    none = F.array().cast("array<string>")
    la, lb = F.transform(F.coalesce(aliases_a, none), normal), F.transform(F.coalesce(aliases_b, none), normal)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(F.array_contains(lb, a) | F.array_contains(la, b), F.lit(0.95)).otherwise(name_similarity(name_a, name_b))


def coordinates(value: Column) -> Column:
    """(lat, lng) of 'lat,lng'; null if either is not a number."""
    part = F.split(value, ",")
    lat, lng = F.trim(F.get(part, F.lit(0))).try_cast("double"), F.trim(F.get(part, F.lit(1))).try_cast("double")
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


#: What a vertex id's prefix stands for.
PREFIX_TYPES = {"equip": "equipment", "person": "person", "loc": "location", "event": "activity", "org": "organization", "id": "identifier", "ds": "dataset", "dr": "datarecord"}


def vid_type(vid: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in PREFIX_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(kinds, F.substring_index(vid, "_", 1)), F.lit("unknown"))


def vid_number(vid: Column) -> Column:
    """The number after the first underscore; null if there is none."""
    return F.substring(vid, F.instr(vid, "_") + 1, F.length(vid)).try_cast("long")


def containment_score(a: Column, b: Column) -> Column:
    """0.4 + 0.3 * shorter / longer if one name contains the other, else 0."""
    x, y = F.length(normal(a)), F.length(normal(b))
    return F.when(contained(a, b), 0.4 + 0.3 * F.least(x, y) / F.greatest(x, y)).otherwise(F.lit(0.0))


def alias_cross_score(keys_a: Column, keys_b: Column) -> Column:
    """0.3 for a common alias, 0.25 for synonyms, else 0."""
    return F.when(F.arrays_overlap(keys_a, keys_b), F.lit(0.3)).when(F.arrays_overlap(synonyms(keys_a), keys_b), F.lit(0.25)).otherwise(F.lit(0.0))


def years_close(a: Column, b: Column, distance: int = 1) -> Column:
    year = lambda x: F.substring(x, 1, 4).try_cast("int")
    return F.coalesce(F.abs(year(a) - year(b)) <= distance, F.lit(False))


def sentences(text: Column) -> Column:
    """Split at full-width stops, marks and semicolons, and at line ends; blanks left out."""
    return F.filter(F.transform(F.split(text, "[。！？；\\n]"), stripped), lambda s: s != "")


def first_sentence_with(name: Column, text: Column, longest: int = 300, excerpt: int = 200) -> Column:
    """The first sentence (up to a full stop) that has the name, cut to longest, else the begin of the text."""
    hit = F.get(F.filter(F.split(text, r"\."), lambda s: F.contains(s, name)), F.lit(0))
    return F.coalesce(F.substring(F.trim(hit), 1, longest), F.substring(text, 1, excerpt))


def mentions(name: Column, text: Column, before: int = 100, after: int = 200) -> Column:
    """A window of text around each mention of the name, in either case."""
    low, word = F.lower(text), F.lower(name)
    quoted = F.concat(F.lit("\\Q"), word, F.lit("\\E"))
    sizes = F.transform(F.split(low, quoted, -1), F.length)
    # The k-th mention begins after the first k pieces and k - 1 mentions.
    starts = F.slice(F.aggregate(sizes, F.array().cast("array<int>"), lambda done, n: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)) + F.length(word), F.lit(0)) + n)), F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(0)))
    cut = F.transform(starts, lambda at: stripped(F.substring(text, F.greatest(at - before, F.lit(0)) + 1, at + F.length(word) + after - F.greatest(at - before, F.lit(0)))))
    return F.when((F.length(word) > 0) & text.isNotNull(), cut).otherwise(F.array().cast("array<string>"))


def fold_name(value: Column) -> Column:
    """Underscores, hyphens and parentheses become spaces, runs of white space one; edges are trimmed before, so a space may remain there."""
    spaced = F.regexp_replace(F.lower(stripped(F.coalesce(value, F.lit("")))), r"[_\-()]", " ")
    return F.regexp_replace(spaced, r"(?U)\s+", " ")


def uri_tokens(uri: Column) -> Column:
    """The set of parts of a URI's local name; empty parts stay, and each %XX is a separator."""
    local = F.regexp_replace(F.lower(F.element_at(F.split(uri, "/"), -1)), "%[0-9a-f]{2}", "_")
    return F.array_distinct(F.split(local, "[_-]"))


def ratio(a: Column, b: Column) -> Column:
    """The smaller by the larger; 0 unless both are positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def plain_text(html: Column) -> Column:
    """Text of an HTML string: scripts, styles and comments go, tags become spaces, runs of white space one."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


#: Where an article's text is looked for, in this order: a tag, a role or a class.  Fixed values.
ARTICLE_SELECTORS = (("tag", "article"), ("role", "main"), ("class", "article-body"), ("class", "post-content"), ("class", "entry-content"), ("class", "story-body"), ("class", "article-content"))

_TAG = r"<(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
#: Entities that are resolved; the ampersand last, so that nothing is resolved twice.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(found, r"""^["']|["']$""", "")


def _tokens(html: Column) -> Column:
    """Tags and the texts between them: text, name (null for a text), closing, role, classes."""
    def told(t: Column) -> Column:
        tag = t.rlike(r"(?s)^<[A-Za-z/!?].*>$")
        opening = t.rlike(r"^<[A-Za-z]")
        return F.struct(t.alias("text"), F.when(tag, F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))).alias("name"), t.startswith("</").alias("closing"),
                        F.when(opening, _attribute(t, "role")).alias("role"), F.when(opening, F.split(F.trim(_attribute(t, "class")), r"\s+")).alias("class"))

    return F.transform(F.regexp_extract_all(html, F.lit(_TAG + r"|[^<]++|<"), F.lit(0)), told)


def _resolved(text: Column) -> Column:
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _strings(tokens: Column) -> Column:
    """The texts between tags, trimmed, without empty ones."""
    texts = F.transform(F.filter(tokens, lambda t: t["name"].isNull()), lambda t: F.regexp_replace(_resolved(t["text"]), r"(?U)^\s+|\s+$", ""))
    return F.filter(texts, lambda t: t != "")


def _until_end(rest: Column) -> Column:
    """The tokens of the element that the first one opens, elements of its name inside it included; without an end tag, all."""
    def end(name: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

        def step(state: Column, token: Column) -> Column:
            own = F.coalesce(token["name"] == name, F.lit(False))
            depth = state["depth"] + F.when(~own, 0).when(token["closing"], -1).otherwise(1)
            seen = state["seen"] + 1
            return F.struct(depth.alias("depth"), seen.alias("seen"), F.when((state["end"] == 0) & own & (depth == 0), seen).otherwise(state["end"]).alias("end"))

        return F.aggregate(rest, start, step, lambda x: F.when(x["end"] > 0, x["end"]).otherwise(x["seen"]))

    return F.slice(rest, F.lit(1), let(F.get(rest, F.lit(0))["name"], end))


def _element(tokens: Column, kind: str, value: str) -> Column:
    """The text of the first element that the selector names, null if there is none."""
    def chosen(t: Column) -> Column:
        if kind == "class":
            return F.coalesce(F.array_contains(t["class"], value), F.lit(False))
        return F.coalesce((t["name"] == value) & ~t["closing"] if kind == "tag" else t["role"] == value, F.lit(False))

    text = lambda at: F.when(at > 0, let(F.slice(tokens, F.greatest(at, F.lit(1)).cast("int"), F.size(tokens)), lambda rest: F.array_join(_strings(_until_end(rest)), " ")))
    return let(F.array_position(F.transform(tokens, chosen), True), text)


def article_text(html: Column, enough: int = 200) -> Column:
    """The text of an article's page: of the first selector's element with more than enough characters, else of all paragraphs.

    The texts inside an element are trimmed and joined by a space, those of a paragraph without one;
    paragraphs are joined by a space.  Scripts, styles and comments are left out, common entities
    resolved.  A null page has no text.
    """
    def paragraphs(bare: Column) -> Column:
        found = F.regexp_extract_all(bare, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?p[\s>]|</(?:article|blockquote|body|div|html|li|main|section|td)\s*>|\z)"), F.lit(1))
        return F.array_join(F.transform(found, lambda p: F.array_join(_strings(_tokens(p)), "")), " ")

    def picked(bare: Column) -> Column:
        found = let(_tokens(bare), lambda tokens: F.filter(F.array(*(_element(tokens, *s) for s in ARTICLE_SELECTORS)), lambda x: x.isNotNull()))
        first = lambda xs: F.get(F.filter(xs, lambda x: F.length(x) > enough), F.lit(0))
        last = lambda xs: F.get(xs, F.size(xs) - 1)
        return let(found, lambda xs: F.coalesce(first(xs), F.when(F.length(last(xs)) >= enough, last(xs)), paragraphs(bare)))

    return let(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "<!>"), picked)


def feed_time(value: Column) -> Column:
    """ISO 8601 or the compact form 20240131T120000Z."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(F.upper(value), F.lit("yyyyMMdd'T'HHmmss'Z'")))


def days_since(ts: Column, now: Column) -> Column:
    """Infinity for a missing or bad time."""
    then = F.try_to_timestamp(ts.cast("string"))
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0, F.lit(float("inf")))


def property_diff(a: Column, b: Column) -> Column:
    """(field, a, b, differs) of every key of either map, sorted; two nulls do not differ."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.transform(keys, lambda k: F.struct(k.alias("field"), F.try_element_at(a, k).alias("a"), F.try_element_at(b, k).alias("b"), (~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))).alias("differs")))
