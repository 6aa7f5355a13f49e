"""Parsers of judges' replies and builders of their prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLY = "struct<match_vid:string,confidence:double,reason:string>"

#: Keys that are no attributes of an entity.
NOISE_KEYS = ("created_at", "updated_at", "confidence", "labels", "vid", "id", "source_pk", "imported_at")


def _bare(text: Column) -> Column:
    """Without reasoning tags and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", ""), r"```(?:json)?", ""))


def judge_reply(text: Column, candidates: Column) -> Column:
    """The reply's JSON, or the first object in it; a match that is no candidate is dropped."""
    bare = _bare(text)
    inner = F.regexp_extract(bare, r"(?s)(\{.*?\})", 1)
    parsed = F.coalesce(*(F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, REPLY)) for x in (bare, inner)))
    vid = F.when(F.array_contains(candidates, parsed["match_vid"]), parsed["match_vid"])
    known = F.struct(vid.alias("match_vid"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(parsed["reason"], F.lit("")).alias("reason"))
    failed = F.struct(F.lit(None).cast("string").alias("match_vid"), F.lit(0.0).alias("confidence"), F.lit("parse_fail").alias("reason"))
    return F.when(parsed.isNull(), failed).otherwise(known)


def verdict(text: Column) -> Column:
    """same, different or unknown: by the first word, else by keywords."""
    low = F.lower(_bare(text))
    return (F.when(low.startswith("same"), "same").when(low.startswith("different"), "different").when(low.startswith("unknown"), "unknown")
            .when(low.rlike(r"\bdifferent\b|\bnot the same\b"), "different").when(low.rlike(r"\bsame\b"), "same").otherwise("unknown"))


def match_reply(text: Column) -> Column:
    """1 for MATCH, 0 for DIFFERENT, -1 for anything else."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(up.contains("DIFFERENT"), 0).when(up.contains("MATCH"), 1).otherwise(-1)


def verdict_label(v: Column) -> Column:
    return F.when(v == "same", 1).when(v == "different", 0).otherwise(-1)


def status_label(status: Column) -> Column:
    """1 for a merge, 0 for kept apart, null for what says nothing."""
    return F.when(status == "merged", 1).when(status.isin("disambig", "new_entity"), 0)


def clean_attributes(props: Column) -> Column:
    """Without noise keys and empty or sentinel values."""
    return F.map_filter(props, lambda k, v: ~k.isin(*NOISE_KEYS) & v.isNotNull() & ~F.trim(v).isin("", "__NULL__", "__EMPTY__", "None"))


def format_attributes(props: Column) -> Column:
    lines = F.transform(F.array_sort(F.map_entries(clean_attributes(props))), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(no attributes)"))


def format_fragments(fragments: Column, most: int = 2, longest: int = 300) -> Column:
    """The longest fragments, each cut."""
    by_length = F.array_sort(fragments, lambda x, y: F.length(y) - F.length(x))
    return F.array_join(F.transform(F.slice(by_length, 1, most), lambda f: F.concat(F.lit("- "), F.substring(f, 1, longest))), "\n")


def pair_prompt(entity_type: Column, name_a: Column, name_b: Column, props_a: Column, props_b: Column, fragments_a: Column, fragments_b: Column) -> Column:
    side = lambda label, n, p, f: F.concat_ws("\n", F.concat(F.lit(f"Entity {label}: "), n), format_attributes(p), F.lit("Sources:"), format_fragments(f))
    return F.concat_ws("\n\n", F.concat(F.lit("Do these two entries name the same "), entity_type, F.lit("? Answer same, different or unknown.")), side("A", name_a, props_a, fragments_a), side("B", name_b, props_b, fragments_b))


#: What a judge is told to look at first, by type.
TYPE_RULES = {
    "equipment": "Compare designations and hull numbers first; different ones are different items.",
    "person": "Compare full names, organisations and posts; an equal name alone is not enough.",
    "location": "Compare coordinates and regions; different places are always different.",
    "organization": "Compare official names and codes; a unit and its parent are different.",
    "activity": "Compare names, regions and dates; another time means another activity.",
}


def candidates_prompt(entity_type: Column, name: Column, props: Column, fragments: Column, excerpt: Column, candidates: Column, examples: Column | None = None) -> Column:
    """The question which of the candidates, an array of (vid, name, props, fragments), a new entity is.

    Without fragments the article's excerpt stands for them.
    """
    rules = F.create_map(*(F.lit(x) for kv in TYPE_RULES.items() for x in kv))
    rule = F.coalesce(F.try_element_at(rules, entity_type), F.lit("Compare all attributes."))
    sources = F.when(F.size(fragments) > 0, format_fragments(fragments)).otherwise(F.concat(F.lit("- "), F.substring(F.coalesce(excerpt, F.lit("")), 1, 300)))
    each = F.transform(candidates, lambda c: F.concat_ws("\n", F.concat(F.lit("["), c["vid"], F.lit("] "), c["name"]), format_attributes(c["props"]),
                                                         F.when(F.size(c["fragments"]) > 0, F.concat(F.lit("Source: "), F.substring(F.get(c["fragments"], F.lit(0)), 1, 200)))))
    new = F.concat_ws("\n", F.concat(F.lit("New "), entity_type, F.lit(": "), name), format_attributes(props), F.lit("Sources:"), sources)
    parts = [F.concat(F.lit("Which candidate is the new entity, if any? "), rule), *([examples] if examples is not None else []), new, F.concat(F.lit("Candidates:\n"), F.array_join(each, "\n")),
             F.lit('Answer as JSON: {"match_vid": id or null, "confidence": 0 to 1, "reason": text}.')]
    return F.concat_ws("\n\n", *parts)


def batch_prompt(pairs: Column) -> Column:
    """The question about up to ten pairs, an array of (vid_a, name_a, vid_b, name_b, similarity), answered by pair_0, pair_1, ..."""
    line = lambda p, i: F.concat(F.lit("pair_"), i.cast("string"), F.lit(": ["), p["vid_a"], F.lit("] "), p["name_a"], F.lit(" / ["), p["vid_b"], F.lit("] "), p["name_b"], F.lit(" (similarity "), F.format_number(p["similarity"], 2), F.lit(")"))
    return F.concat(F.lit("For each pair: merge or disambiguate?\n"), F.array_join(F.transform(pairs, line), "\n"))


ANSWER = "struct<action:string,keep_vid:string,reason:string>"


def batch_answers(text: Column) -> Column:
    """The map of a batch's answers by pair_i; empty where the reply is no JSON object."""
    return F.coalesce(F.from_json(_bare(text), f"map<string,{ANSWER}>"), F.from_json(F.lit("{}"), f"map<string,{ANSWER}>"))
