"""Scalar text functions as column expressions (no Python runs on rows).

Rule lists are parameters: the library brings the matching, the caller brings the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def trigram_sequence(text: Column) -> Column:
    """All trigrams of the padded words in order, repeated ones too."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3)))))


def word_similarity(name: Column, text: Column) -> Column:
    """The best similarity of a name's trigrams with those of any stretch of the text's trigrams.

    A best stretch begins and ends at a trigram of the name, so only such stretches are looked at.
    """
    own, run = trigrams(name), trigram_sequence(text)
    held = F.filter(F.transform(run, lambda t, i: F.when(F.array_contains(own, t), i + 1)), lambda i: i.isNotNull())
    each = F.transform(held, lambda a: F.array_max(F.transform(F.filter(held, lambda b: b >= a), lambda b: jaccard(own, F.array_distinct(F.slice(run, a, b - a + 1))))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def has_suffix_word(text: Column, suffixes: Sequence[str]) -> Column:
    """Whether a normalised text has a word that ends with one of the suffixes."""
    return text.rlike(rf"(?U)\b\w*(?:{'|'.join(re.escape(x) for x in suffixes)})\b")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where a norm is 0."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(total(a, b) / norms)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length: stands in for sequence matching ratios."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def strip_terms(text: Column, terms: Sequence[str]) -> Column:
    """Whole words of the list removed whatever their case, blanks collapsed."""
    pattern = rf"(?iU)\b(?:{'|'.join(sorted(terms, key=lambda t: (-len(t), t)))})\b"
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, " "), r"\s+", " "))


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def first_match(text: Column, rules: Sequence[tuple[str, str]], fallback: str | None = None) -> Column:
    """The value of the first rule (pattern, value) that matches; null stays null."""
    out = F.lit(fallback)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"(?iU){pattern}"), F.lit(value)).otherwise(out)
    return F.when(text.isNotNull(), out)


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def folded_type(text: Column, folds: Sequence[tuple[str, str, str]] = ()) -> tuple[Column, Column]:
    """(type, code): types of a family become one, any other type stays as it is; null without a type.

    folds: (type, pattern of the family, pattern with the code as group 1). The code is null where a member
    of the family has none.
    """
    bare = F.nullif(trimmed(text), F.lit(""))
    kind, code = bare, F.lit(None).cast("string")
    for name, family, coded in reversed(folds):
        found = F.regexp_extract(bare, f"(?iU){coded}", 1)
        here = bare.rlike(f"(?iU){family}") | (found != "")
        kind, code = F.when(here, F.lit(name)).otherwise(kind), F.when(here, F.nullif(found, F.lit(""))).otherwise(code)
    return kind, code


def trimmed(text: Column) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def parse_moment(text: Column) -> Column:
    """Timestamp without zone from ISO with a T, a date alone or dd.mm.yyyy; fractions and offsets are dropped, junk is null."""
    bare = trimmed(text)
    iso = [F.regexp_extract(bare, r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?$", k) for k in (1, 2)]
    whole = F.try_to_timestamp(F.nullif(F.concat_ws(" ", *iso), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(whole, *(F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-M-d", "d.M.yyyy"))).cast("timestamp_ntz")


#: Fixed value: months by their first three letters.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def date_in_text(text: Column, within: int = 1200) -> Column:
    """The date that a text begins with: day, English month and year, else dd.mm.yyyy, else ISO.

    The first of these forms that is there decides; if what it says is no date the result is null.
    """
    head = F.left(text, F.lit(within))
    english, dotted, iso = rf"(?i)(\d{{1,2}})\s+({MONTHS})\w*\s+(\d{{4}})", r"(\d{2}\.\d{2}\.\d{4})", r"(\d{4}-\d{2}-\d{2})"
    day, month, year = (F.regexp_extract(head, english, k) for k in (1, 2, 3))
    spoken = F.try_to_timestamp(F.concat_ws(" ", day, F.initcap(month), year), F.lit("d MMM yyyy"))
    read = F.when(head.rlike(english), spoken).when(head.rlike(dotted), F.try_to_timestamp(F.regexp_extract(head, dotted, 1), F.lit("dd.MM.yyyy")))
    return read.when(head.rlike(iso), F.try_to_timestamp(F.regexp_extract(head, iso, 1), F.lit("yyyy-MM-dd"))).cast("date")


def count_after(text: Column, label: str, labels: Sequence[str]) -> Column:
    """The count that a ballot gives for one of its labels: up to three digits within forty characters after it.

    All labels are read in one walk, so a number counts for the first label before it. Of several counts of
    a label the last one holds; null if there is none.
    """
    pattern = F.lit(rf"(?isU)\b({'|'.join(map(re.escape, labels))})\b[^0-9]{{0,40}}([0-9]{{1,3}})\b")
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda n, v: F.when(F.upper(n) == label.upper(), v.cast("int")))
    return F.try_element_at(F.array_compact(pairs), F.lit(-1))


def majority(yes: Column, no: Column, sides: tuple[str, str] = ("accepted", "rejected")) -> Column:
    """The side with more votes; null for a tie and where a count is missing."""
    return F.when(yes > no, F.lit(sides[0])).when(yes < no, F.lit(sides[1]))


def outcome_check(counted: Column, stated: Column, expected: Mapping[str, str]) -> Column:
    """ok or warn: whether the counted side is the one that the stated outcome needs; n/a without a side or for an outcome that needs none."""
    side = F.lit(None).cast("string")
    for outcome, needs in expected.items():
        side = F.when(stated == outcome, F.lit(needs)).otherwise(side)
    return F.when(counted.isNull() | side.isNull(), "n/a").when(counted == side, "ok").otherwise("warn")


def spoken_outcome(word: str) -> str:
    """Pattern of an outcome's word in a sentence: not at the end of a longer word, with the endings of a verb."""
    return rf"(?:^|[^a-zäöüß]){re.escape(word)}(?:en|t)?\b"


def decision(text: Column, section: str, outcomes: Sequence[tuple[str, str]], item: str, after: int = 2000, head: int = 1200) -> Column:
    """The first outcome in order of priority within the part of a text that decides, or null.

    That part is what ``section`` has as group 1; without a section what follows the item's heading; without
    a heading the beginning of the text. Nothing outside that part counts.
    """
    following = F.regexp_extract(text, rf"(?:{item})(?s:(.{{0,{after}}}))", re.compile(item).groups + 1)
    scope = F.when(text.rlike(section), F.regexp_extract(text, section, 1)).when(text.rlike(item), following).otherwise(F.left(text, F.lit(head)))
    return first_match(scope, outcomes)


def item_verified(text: Column, number: Column, outcome: Column, found: Column, item: str) -> tuple[Column, Column]:
    """Whether the first item that a text names is the asked one (any, where none is asked), and whether the found outcome is the stated one."""
    asked = F.coalesce(number, F.lit(""))
    top = text.rlike(item) & ((asked == "") | (F.regexp_extract(text, item, 1) == asked))
    return F.coalesce(top, F.lit(False)), F.coalesce(found == outcome, F.lit(False))


def valid_at(day: Column, rules: Sequence[tuple[str, str, Sequence[tuple[str | None, str | None]] | None]], text: Column) -> Column:
    """First rule (pattern, value, eras) whose pattern stands in a text and one of whose eras holds the day.

    Without eras a rule always holds; with some it needs a day. An era is (from, to), both included, either
    may be open. Patterns mind case unless they say otherwise.
    """
    out = F.lit(None).cast("string")
    for pattern, value, eras in reversed(rules):
        ok = text.rlike(pattern)
        if eras is not None:
            within = [(day >= F.lit(start).cast("date") if start else F.lit(True)) & (day <= F.lit(end).cast("date") if end else F.lit(True)) for start, end in eras]
            ok = ok & day.isNotNull() & reduce(lambda a, b: a | b, within, F.lit(False))
        out = F.when(ok, F.lit(value)).otherwise(out)
    return out


#: A house number, which may be a range, and what may stand between it and the postcode.
HOUSE_NUMBER = r"\d+\s*[a-zA-Z]?(?:\s*[-/]\s*\d+\s*[a-zA-Z]?)?"
SEPARATOR = r"[\s,;·]{0,8}"


def only_as_address(text: Column, name: str, town: str) -> Column:
    """True if a name stands in a text, and each time before a house number, a postcode and the town. Names and case as they come."""
    quoted = re.escape(name)
    every = F.regexp_count(text, F.lit(f"(?iU){quoted}"))
    address = F.regexp_count(text, F.lit(rf"(?iU)(?={quoted}\s*{HOUSE_NUMBER}{SEPARATOR}\d{{5}}\s+{re.escape(town)}){quoted}"))
    return F.coalesce((every > 0) & (every == address), F.lit(False))


def excerpt(text: Column, name: Column, around: int = 60, cap: int = 255) -> Column:
    """The surroundings of the first place where a name stands by itself, whatever its case, in one line between marks; null if it does not."""
    bare = F.trim(name)
    at = F.regexp_instr(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(bare, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)")))
    start = F.greatest(F.lit(1), at - around)
    piece = F.substr(text, start, at - start + F.length(bare) + around)
    return F.when((at > 0) & (bare != ""), F.left(F.concat(F.lit("…"), trimmed(F.replace(piece, F.lit("\n"), F.lit(" "))), F.lit("…")), F.lit(cap)))


def without_noise(text: Column, patterns: Sequence[str]) -> Column:
    """What is left without the patterns, whatever the case; nothing takes their place."""
    return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", ""), patterns, text)


def rewrite(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Rewrite rules (pattern, replacement) in order."""
    return reduce(lambda u, r: F.regexp_replace(u, *r), rules, url)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def links_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""https?://[^\s"'<>]+"""), F.lit(0))


def column_name(key: Column) -> Column:
    """Fixed output names: safe column names: reserved words renamed, lower case, other characters as _, k_ before a digit."""
    clean = F.regexp_replace(F.lower(key), r"\W", "_")
    renamed = F.when(key == "start", "start_date").when(key == "end", "end_date").when(key == "order", "order_col").otherwise(clean)
    return F.when(renamed == "", "k").when(renamed.rlike(r"^\d"), F.concat(F.lit("k_"), renamed)).otherwise(renamed)


def has_anaphora(query: Column, proforms: Sequence[str]) -> Column:
    """A proform (without marks after it) that ends the query, or stands before a word that begins in lower case."""
    words, pro = F.split(F.trim(query), r"\s+"), [p.lower() for p in proforms]
    bare = lambda w: F.regexp_replace(F.lower(w), "[,.!?:;]+$", "").isin(pro)
    paired = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda w, nxt: bare(w) & (nxt.isNull() | nxt.rlike(r"^\p{Ll}")))
    return F.exists(paired, lambda x: F.coalesce(x, F.lit(False)))


#: Fixed value: marks that a query may hold beside letters, numbers and white space.
QUERY_MARKS = ".,;:!?()[]{}„“«»\"'’`-–—/&%+*#@=_|~°§$€"


def allowed_query(query: Column, most: int = 250) -> Column:
    """Whether a query, trimmed, is not empty, not too long, and made of letters, numbers, white space and the marks alone."""
    bare = trimmed(F.coalesce(query, F.lit("")))
    marks = "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in QUERY_MARKS)
    return (F.length(bare) <= most) & bare.rlike(rf"(?U)^[\p{{L}}\p{{N}}\s\x1C-\x1F{marks}]+\z")


def teaser(text: Column, summary: Column | None = None, words: int = 200, excerpt_length: int = 16000, ceiling: int = 9600) -> Column:
    """A short text in one line as it stands; a longer one by its summary, cut to ``words``; without a usable summary its beginning.

    A summary of one word is none.
    """
    one_line = lambda t: F.replace(t, F.lit("\n"), F.lit(" "))
    split = lambda t: F.array_remove(F.split(t, r"(?U)[\s\x1C-\x1F]+"), "")
    text = F.coalesce(text, F.lit(""))
    long = one_line(F.left(text, F.lit(excerpt_length)))
    if summary is not None:
        said = F.when(F.size(split(summary)) > words, F.array_join(F.slice(split(summary), 1, words), " ")).otherwise(summary)
        long = F.when(F.size(split(summary)) > 1, said).otherwise(long)
    return F.left(F.when(F.size(split(text)) <= words, one_line(text)).otherwise(long), F.lit(ceiling))


def without_code_fence(text: Column) -> Column:
    """A trimmed text; if a fence of three backticks begins it, without its first line and without a last line that is a fence."""
    bare = trimmed(text)
    lines = F.split(bare, r"\R|[\x1C-\x1E]")
    closing = trimmed(F.element_at(lines, -1)).startswith("```") & (F.size(lines) > 1)
    inner = F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 1 - closing.cast("int")), "\n")
    return F.when(bare.startswith("```"), trimmed(inner)).otherwise(bare)


def path_parts(path: Column) -> list[Column]:
    """folder (the last one), filename, extension in lower case, stem and prefix (up to the first - or _) of a path with either kind of slash."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(parts, -1)
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    stem = F.regexp_replace(name, r"(?s)\.[^.]*\z", "")
    return [folder.alias("folder"), name.alias("filename"), F.lower(F.regexp_extract(name, r"(?s)\.([^.]*)\z", 1)).alias("extension"), stem.alias("stem"), F.regexp_extract(stem, r"(?s)^([^-_]*)", 1).alias("prefix")]


def file_key(name: Column) -> Column:
    """Stem without extension and leading zeros."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^0+(?=.)", "")


def agenda_rank(number: Column) -> list[Column]:
    """Sort columns: numeric item numbers as numbers first, then null, then text."""
    value = number.try_cast("double")
    return [F.when(value.isNotNull(), 0).when(number.isNull(), 1).otherwise(2), value, number]


def web_link(base: str, kind: Column, key: Column) -> Column:
    """Link of an entity in the portal; null where a part is missing."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.lower(kind), F.lit("?id="), key.cast("string"))


def thread_turn(query: Column, thematic: Column, confidence: Column, topic: Column, sure_recall: Column, proforms: Sequence[str], least: float) -> Column:
    """followup or break: a thematic query goes on if it is anaphoric, or has no topic and an unsure intent; weak recall breaks."""
    unsure = F.coalesce(confidence, F.lit(0.0)) < least
    on = thematic & sure_recall & (has_anaphora(query, proforms) | (topic.isNull() & unsure))
    return F.when(F.coalesce(on, F.lit(False)), "followup").otherwise("break")


def classified_names(table: DataFrame, rules: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(names trimmed and missing classifications filled by rule, changes as key, column, before, after)."""
    name = F.trim(F.regexp_replace("name", r"^\s+|\s+$", ""))
    new_name = F.when(name != "", name).otherwise(F.col("name"))
    new_class = F.coalesce("classification", F.when(name != "", first_match(name, rules)))
    both = table.withColumns({"new_name": new_name, "new_class": new_class})
    change = lambda label, old, new: F.when(~F.col(old).eqNullSafe(F.col(new)), F.struct(F.lit(label).alias("column"), F.col(old).alias("before"), F.col(new).alias("after")))
    changes = both.select("key", F.explode(F.array_compact(F.array(change("name", "name", "new_name"), change("classification", "classification", "new_class")))).alias("x")).select("key", "x.*")
    return both.select(*(F.col({"name": "new_name", "classification": "new_class"}.get(c, c)).alias(c) for c in table.columns)), changes
