"""Vocabulary mapping and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import first_contained, fold_key, lookup, non_blank, slugify, strip, title_case

TECHNIQUE_ID = r"T\d{4}(?:\.\d{3})?"


def technique_id(c: Column) -> Column:
    """Upper-cased technique id, NULL when malformed."""
    cleaned = F.upper(strip(c))
    return F.when(cleaned.rlike(rf"^{TECHNIQUE_ID}$"), cleaned)


def technique_ids_in(text: Column) -> Column:
    """Technique ids named in a text, first mention order, each once."""
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(rf"(?<![0-9A-Za-z_])({TECHNIQUE_ID})(?![0-9A-Za-z_])"), F.lit(1))
    )


def technique_url(tid: Column) -> Column:
    return F.concat(
        F.lit("https://attack.mitre.org/techniques/"), F.replace(tid, F.lit("."), F.lit("/")), F.lit("/")
    )


def canonical_sector(c: Column) -> Column:
    name = strip(c)
    return lookup(F.lower(name), vocab.SECTORS, title_case(name))


def canonical_sectors(values: Column) -> Column:
    return F.array_distinct(F.transform(values, canonical_sector))


def canonical_motivations(values: Column) -> Column:
    """Known motivations in order, one ``unknown`` for everything else."""
    return F.array_distinct(
        F.transform(
            values,
            lambda v: F.when(fold_key(v).isin(vocab.MOTIVATIONS), fold_key(v)).otherwise("unknown"),
        )
    )


def keywords_in(text: Column, table: dict) -> Column:
    """Values of the keywords that occur in the text, table order, each once."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in table.items()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def advisory_sectors(text: Column) -> Column:
    return keywords_in(text, vocab.ADVISORY_SECTOR_KEYWORDS)


def infer_origin(contributors: Column, description: Column) -> Column:
    """Country hinted at by a contributor, else by the description, else ''."""
    per_person = F.transform(
        F.coalesce(contributors, F.array().cast("array<string>")),
        lambda p: first_contained(F.lower(p), vocab.ORIGIN_HINTS),
    )
    return F.coalesce(
        F.try_element_at(F.array_compact(per_person), F.lit(1)),
        first_contained(F.lower(F.coalesce(description, F.lit(""))), vocab.ORIGIN_HINTS),
        F.lit(""),
    )


def tactic_label(c: Column) -> Column:
    low = F.lower(F.coalesce(strip(c), F.lit("")))
    return lookup(low, {t.lower(): t for t in vocab.TACTICS}, title_case(low))


def tactic_slug(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("-"))


def phase_tactics(phases: Column) -> Column:
    """Kill-chain phase names as tactic names."""
    return F.transform(
        F.filter(phases, lambda p: F.coalesce(p, F.lit("")) != ""),
        lambda p: title_case(F.replace(p, F.lit("-"), F.lit(" "))),
    )


def family_class(tags: Column) -> Column:
    """Malware class of a family from its tags, first rule wins."""
    low = F.transform(tags, F.lower)
    out = None
    for tag, label in vocab.FAMILY_CLASSES.items():
        cond = F.array_contains(low, tag)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("malware"))


def display_slug(c: Column) -> Column:
    """Readable family name from a platform-prefixed slug."""
    return title_case(F.replace(F.regexp_replace(c, r"^[a-z]+\.", ""), F.lit("_"), F.lit(" ")))


def country_name(c: Column) -> Column:
    return lookup(F.upper(c), vocab.COUNTRIES, c)


def relevance_label(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def confidence_label(sources: Column, high_provenance) -> Column:
    """HIGH for two or more sources, MEDIUM for one official one, else LOW."""
    return (
        F.when(F.size(sources) >= 2, "HIGH")
        .when(F.arrays_overlap(sources, F.array(*[F.lit(s) for s in high_provenance])), "MEDIUM")
        .otherwise("LOW")
    )


def confidence_number(label: Column) -> Column:
    """0-100 number of a label; unlabelled counts as medium."""
    return lookup(F.upper(label), vocab.CONFIDENCE_NUMBERS, F.lit(vocab.CONFIDENCE_NUMBERS["MEDIUM"]))


def layer_colour(label: Column) -> Column:
    return lookup(F.upper(label), vocab.CONFIDENCE_COLOURS, F.lit(vocab.CONFIDENCE_COLOURS["LOW"]))


def layer_score(label: Column) -> Column:
    return lookup(F.upper(label), vocab.CONFIDENCE_LAYER_SCORES, F.lit(vocab.CONFIDENCE_LAYER_SCORES["LOW"]))


def layer_comment(confidence: Column, rule_count: Column, lead_rule: Column, detection: Column) -> Column:
    """Confidence, then the rule count with its lead rule, else the detection text."""
    rules = F.concat(
        F.lit("Sigma: "), rule_count.cast("string"), F.lit(" rule"),
        F.when(rule_count != 1, F.lit("s")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" — "), non_blank(lead_rule)), F.lit("")),
    )
    # the cut is what the layer shows
    hint = F.concat(F.lit("Detection: "), F.left(non_blank(detection), F.lit(120)))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Confidence: "), F.upper(confidence)),
        F.when(rule_count > 0, rules).otherwise(hint),
    )


def stix_motivation(c: Column) -> Column:
    return first_contained(fold_key(c), vocab.STIX_MOTIVATIONS, F.lit("unknown"))


def stix_malware_type(c: Column) -> Column:
    return lookup(F.lower(c), vocab.STIX_MALWARE_TYPES, F.lit("malware"))


def stable_id(kind: str, *natural_key: Column) -> Column:
    """Deterministic id ``kind--8-4-4-4-12`` from a natural key."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in natural_key]
    h = F.sha2(F.concat_ws("\u0001", F.lit(kind), *parts), 256)
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat(
        F.lit(f"{kind}--"),
        F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)),
    )


def id_kind(sid: Column) -> Column:
    """The kind a :func:`stable_id` begins with."""
    return F.substr(sid, F.lit(1), F.length(sid) - 38)


def id_bytes(sid: Column) -> Column:
    """The 16 bytes of a :func:`stable_id`; they sort like its digits."""
    return F.unhex(F.replace(F.right(sid, F.lit(36)), F.lit("-"), F.lit("")))


def id_text(kind: Column, number: Column) -> Column:
    """The id of a kind and 16 bytes, as :func:`stable_id` writes it."""
    h = F.lower(F.hex(number))
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat(kind, F.lit("--"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12))


def article_key(url: Column, title: Column, *more: Column) -> Column:
    """Sixteen hex digits over url + title (and the actor where kept per actor)."""
    parts = [F.coalesce(c, F.lit("")) for c in (url, title, *more)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def source_slug(canonical: Column, style: str = "family") -> Column:
    """Name a source uses for an actor: curated, else by its own rule."""
    if style == "family":
        rule = F.translate(F.lower(canonical), " -", "__")
        return lookup(canonical, vocab.FAMILY_SOURCE_SLUGS, rule)
    return lookup(canonical, vocab.PULSE_SOURCE_SLUGS, canonical)


def is_search_term(alias: Column, rule: str, strict_ids: bool = False) -> Column:
    """Whether an alias is distinctive enough to search for.

    Longer than four characters and not an id; the id spellings differ between
    pulses (``pulse``), articles (``article``) and report folders (``folder``,
    length only).  ``strict_ids`` also refuses ids with up to three letters.
    """
    name = fold_key(alias)
    ids = {"pulse": r"^[gt]\d+$", "article": r"^[gtu][a-z]?\d+$", "folder": None}[rule]
    ok = F.length(name) > 4
    if strict_ids:
        ids = r"^[a-z]{1,3}[0-9]+$"
    return ok if ids is None else ok & ~name.rlike(ids)


def file_slug(name: Column) -> Column:
    return slugify(name, "alnum")
