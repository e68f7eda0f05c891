"""Jobs over papers, meetings and their documents: attaching, deriving, migrating, viewing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import any_match, date_in_text, decision, item_verified, majority, outcome_check, valid_at


#: Fixed value: how names and texts of ballots name an item.
NAMED_ITEM = r"(?i)top\s*-?_?\s*(\d+(?:\.\d+)?)"


def paper_texts(texts: DataFrame) -> DataFrame:
    """(paper, text) of rows (paper, at, text): all texts of a paper in order, joined by blanks."""
    return texts.where("text is not null").groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))


def escalated(pairs: DataFrame, texts: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], confidence: float = 0.6) -> DataFrame:
    """Pairs without an outcome get the first one whose wording stands in any text of their paper.

    rules: outcomes with their patterns, in order. Adds signal and confidence where one was found.
    """
    found = F.lit(None).cast("string")
    for outcome, patterns in reversed(rules):
        found = F.when(any_match(F.col("text"), patterns), F.lit(outcome)).otherwise(found)
    told = paper_texts(texts).select("paper", found.alias("told"))
    joined = pairs.join(told, "paper", "left")
    fresh = F.col("outcome").isNull() & F.col("told").isNotNull()
    return joined.select(*(c for c in pairs.columns if c != "outcome"), F.coalesce("outcome", "told").alias("outcome"), F.when(fresh, "wording").alias("signal"), F.when(fresh, confidence).alias("confidence"))


def named_item(text: Column, pattern: str) -> Column:
    """The item number that a text names, without leading zeros."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), "^0+(?=.)", "")


def attached_protocols(pairs: DataFrame, candidates: DataFrame, outcomes: Sequence[tuple[str, str]], section: str, item: str, council: str = "GR", tasks: int | None = None) -> DataFrame:
    """(pair, document, outcome, derived, attached, source) of all candidates of pairs; see ``protocols``.

    derived is the decision that a pair without an outcome takes, attached whether the document belongs to the
    pair, source whether it is the document that was derived from. Each text is judged once. Both sides are dealt
    by pair into ``tasks`` parts; without a number Spark chooses it.
    """
    dealt = lambda df: df if tasks is None else df.repartition(tasks, "pair")
    joined = dealt(candidates).dropDuplicates(["pair", "document"]).join(dealt(pairs), "pair")
    text, name = F.coalesce("text", F.lit("")), F.coalesce("name", F.lit(""))
    days = [F.date_format("day", form) for form in ("dd.MM.yyyy", "dd. MMMM yyyy", "dd. MM. yyyy")]
    session = reduce(lambda a, b: a | b, (F.coalesce(F.contains(where, d), F.lit(False)) for d in days for where in (text, name)), F.contains(name, F.lit(council)))
    found = decision(text, section, outcomes, item)
    judged = joined.withColumn("found", found).withColumns({"session": session, "top": item_verified(text, F.col("number"), F.col("outcome"), F.col("found"), item)[0]})
    judged = judged.select("pair", "document", "outcome", "found", "session", "top")
    tells = F.col("outcome").isNull() & F.col("top") & F.col("found").isNotNull()
    first = F.min(F.when(tells & F.col("document").isNotNull(), F.struct("document", "found"))).over(Window.partitionBy("pair"))
    known = judged.withColumn("first", first).withColumn("stated", F.coalesce("outcome", F.when(F.col("document") > F.col("first.document"), F.col("first.found"))))
    attached = F.coalesce(F.col("top") & F.col("session") & (F.col("found") == F.col("stated")), F.lit(False))
    return known.select("pair", "document", "outcome", F.col("first.found").alias("derived"), attached.alias("attached"), F.coalesce(F.col("document") == F.col("first.document"), F.lit(False)).alias("source"))


def protocols(pairs: DataFrame, candidates: DataFrame, outcomes: Sequence[tuple[str, str]], section: str, item: str, council: str = "GR") -> tuple[DataFrame, DataFrame]:
    """(attached (pair, document), derived (pair, outcome, confidence, signal)) of pairs (pair, number, day, outcome).

    Candidates (pair, document, name, text) are taken in the order of their keys. One attaches if the first
    item that its text names is the pair's, its decision is the pair's outcome, and it belongs to the session:
    the day stands in text or name, or the name says the council. A pair without an outcome takes the decision
    of its first document of the right item, of whatever session; that document does not attach, later ones may.
    """
    known = attached_protocols(pairs, candidates, outcomes, section, item, council)
    derived = known.where("source").select("pair", F.col("derived").alias("outcome"), F.lit(0.7).alias("confidence"), F.lit("protocol").alias("signal"))
    return known.where("attached").select("pair", "document"), derived


def ballot_documents(pairs: DataFrame, candidates: DataFrame, counts: Callable[[Column], tuple[Column, Column]], expected: Mapping[str, str], item: str = NAMED_ITEM) -> DataFrame:
    """(pair, document, yes, no, verdict) of candidates (pair, document, name, text, date) that fit their pair's item and session.

    The item is named in the name, or, where the name does not name it, in the text. Any of five signals tells
    the session: a date in the text, the document's own date, the day written in ISO in the text, with dots in
    the name, or with a month's short name in the text. The counted majority is checked against the side that
    the pair's outcome needs.
    """
    joined = candidates.dropDuplicates(["pair", "document"]).join(pairs, "pair")
    text, name = F.coalesce("text", F.lit("")), F.coalesce("name", F.lit(""))
    number = F.regexp_replace("number", "^0+(?=.)", "")
    top = F.coalesce(named_item(name, item) == number, F.lit(False)) | F.coalesce(named_item(text, item) == number, F.lit(False))
    short = F.concat_ws(" ", F.dayofmonth("day").cast("string"), F.date_format("day", "MMM"), F.year("day").cast("string"))
    signals = (date_in_text(text) == F.col("day"), F.col("date") == F.col("day"), F.contains(text, F.date_format("day", "yyyy-MM-dd")), F.contains(name, F.date_format("day", "dd.MM.yyyy")), F.contains(F.lower(text), F.lower(short)))
    session = reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in signals))
    yes, no = counts(text)
    return joined.where(top & session).select("pair", "document", yes.alias("yes"), no.alias("no"), outcome_check(majority(yes, no), F.col("outcome"), expected).alias("verdict"))


def authors(papers: DataFrame, chunks: DataFrame, rules: Sequence[tuple], head: int = 3, most: int = 4000) -> DataFrame:
    """(paper, author): the first party whose wording stands in a paper's name or first chunks, within the party's era.

    papers: (paper, name, day); chunks: (paper, chunk_index, text), each cut to ``most`` characters.
    """
    w = Window.partitionBy("paper").orderBy("chunk_index")
    first = chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= head)
    heads = first.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.left("text", F.lit(most)).alias("text")))), lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("head"))
    corpus = F.concat(F.coalesce("name", F.lit("")), F.coalesce("head", F.lit("")))
    return papers.join(heads, "paper", "left").select("paper", valid_at(F.col("day"), rules, corpus).alias("author"))


def surrogates(rows: DataFrame, natural: str) -> DataFrame:
    """(natural, sid): distinct natural keys numbered from 1, by two hexadecimal digits of their hash, then by key.

    Numbers are made within 256 parts and added up over the parts' counts, so no task sorts all keys.
    """
    keys = rows.select(natural).where(F.col(natural).isNotNull()).distinct().withColumn("part", F.left(F.md5(F.col(natural).cast("string")), F.lit(2)))
    counts = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows
    return keys.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(natural))).join(F.broadcast(before), "part").select(natural, (F.col("before") + F.col("place")).alias("sid"))


def migrated(rows: DataFrame, keys: DataFrame, natural: str, json_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with surrogate ids and parsed documents, unresolved natural keys with counts, rows whose JSON does not parse)."""
    parsed = rows.withColumn("parsed", F.expr(f"try_parse_json({json_column})"))
    bad = parsed.where(F.col("parsed").isNull() & F.col(json_column).isNotNull())
    missing = rows.join(keys, natural, "left_anti").groupBy(natural).agg(F.count(F.lit(1)).alias("n"))
    good = parsed.where(F.col("parsed").isNotNull() | F.col(json_column).isNull()).join(keys, natural)
    return good, missing, bad.select(*rows.columns)


def without_provenance(items: DataFrame, assignments: DataFrame, **having) -> DataFrame:
    """Items that no assignment of a given provenance (columns and values, e.g. source="model") covers."""
    told = assignments.where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in having.items()), F.lit(True)))
    return items.join(told.select("item"), "item", "left_anti")


def concept_view(entities: DataFrame, links: DataFrame, concepts: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities (id, name) with their concepts' labels and further triples, each if there is one."""
    out = entities.join(links.select("id", "concept", "relation"), "id", "left").join(concepts.select("concept", "label"), "concept", "left")
    return out.join(triples.select("id", "predicate", "value"), "id", "left").select("id", "name", "concept", "label", "relation", "predicate", "value")


def role_view(persons: DataFrame, links: DataFrame, concepts: DataFrame, role: str, member: str) -> DataFrame:
    """Persons (id, name) with the labels of their roles and of the organizations they belong to."""

    def told(relation: str, name: str) -> DataFrame:
        of = links.where(F.col("relation") == relation).select("id", F.col("concept").alias(name))
        return of.join(concepts.select(F.col("concept").alias(name), F.col("label").alias(f"{name}_label")), name, "left")

    return persons.select("id", "name").join(told(role, "role"), "id", "left").join(told(member, "organization"), "id", "left").select("id", "name", "role", "role_label", "organization", "organization_label")


def keyed_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of a bulk table: the key as the text of a whole number, the vector as floats; rows without either go."""
    return table.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").cast("string").alias("key"), F.col(vector).cast("array<float>").alias("vector"))


def class_counts(reasons: DataFrame, column: str, rules: Sequence[tuple[str, str]], fallback: str = "other") -> DataFrame:
    """(value, n): reasons by the first rule (pattern, class) that matches."""
    value = F.lit(fallback)
    for pattern, name in reversed(rules):
        value = F.when(F.col(column).rlike(pattern), F.lit(name)).otherwise(value)
    return reasons.where(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def serialised(parts: list[DataFrame], dates: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, type, date, attributes) of partial node tables (id, type, attributes, date columns), in order.

    The first part of an id gives its type and date; the date is the first of its type's columns that is not
    null, and types without columns have none. Attributes are merged: of one that several parts give, the last
    value that is not null holds, and one that is null everywhere is left out.
    """

    def dated(part: DataFrame) -> Column:
        day = F.lit(None).cast("date")
        for kind, columns in dates.items():
            there = [F.col(c) for c in columns if c in part.columns]
            day = F.when(F.col("type") == kind, F.coalesce(*there)).otherwise(day) if there else day
        return day

    numbered = reduce(DataFrame.unionByName, (p.select("id", "type", dated(p).cast("date").alias("date"), "attributes", F.lit(i).alias("part")) for i, p in enumerate(parts)))
    first = numbered.groupBy("id").agg(F.min_by(F.struct("type", "date"), "part").alias("first"))
    told = numbered.select("id", "part", F.explode("attributes").alias("name", "value")).where("value is not null")
    each = told.groupBy("id", "name").agg(F.max_by("value", "part").alias("value"))
    merged = each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    return first.join(merged, "id", "left").select("id", "first.type", "first.date", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def meeting_topics(items: DataFrame, item_files: DataFrame, consultations: DataFrame, paper_files: DataFrame) -> DataFrame:
    """(meeting, item, files): agenda items with their own files and those of the papers they consult, items without any too."""
    own = item_files.select("item", "file")
    through = consultations.select("item", "paper").join(paper_files.select("paper", "file"), "paper").select("item", "file")
    files = own.unionByName(through).distinct().groupBy("item").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return items.select("meeting", "item").join(files, "item", "left").select("meeting", "item", F.coalesce("files", F.array().cast(files.schema["files"].dataType)).alias("files"))


def entities_of(docs: DataFrame, extract: Callable[[str, str], list[str]] | None = None) -> DataFrame:
    """(doc, entity, n) by a given extractor (text, type) -> list; none: no rows. Runs on Arrow batches of (doc, type, text)."""
    if extract is None:
        return docs.select("doc", F.lit("").alias("entity"), F.lit(0).cast("long").alias("n")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, found) for doc, kind, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "type", "text")), strict=True) if text for found in extract(text, kind)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column("doc").type), pa.array([r[1] for r in rows], pa.string())], ["doc", "entity"])

    found = docs.select("doc", "type", "text").mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, entity string")
    return found.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("n"))
