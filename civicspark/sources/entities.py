"""Nested JSON entities to typed tables: scan, flatten, relations, column types, keys, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.functions.text import column_name, parse_moment, trimmed


def read_folder(spark: SparkSession, path: str, pattern: str = "[!.]*.json", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a folder of files that are one JSON document each, or one on each line with ``lines``; columns doc (its file) and body (its text)."""
    raw = spark.read.text(path, wholetext=not lines, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("body"))
    whole = F.try_parse_json("body").isNotNull()
    return raw.where(whole), raw.where(~whole)


def fields(entities: DataFrame) -> DataFrame:
    """(id, type, field, value as string, kind) of every scalar and list element of the entities."""
    entities.withColumn("body", F.try_parse_json("body")).createOrReplaceTempView("entity_rows")
    return entities.sparkSession.sql(
        """WITH top AS (SELECT e.id, e.type, x.key AS field, x.value AS v FROM entity_rows e, LATERAL variant_explode(e.body) AS x),
           each AS (
             SELECT id, type, field, v, false AS listed FROM top WHERE schema_of_variant(v) NOT LIKE 'ARRAY%'
             UNION ALL
             SELECT t.id, t.type, t.field, y.value AS v, true AS listed FROM top t, LATERAL variant_explode(t.v) AS y WHERE schema_of_variant(t.v) LIKE 'ARRAY%')
           SELECT id, type, field, listed, schema_of_variant(v) AS kind,
                  CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN try_variant_get(v, '$.id', 'string') ELSE CAST(v AS STRING) END AS value
           FROM each"""
    )


def relations(values: DataFrame, entities: DataFrame) -> DataFrame:
    """(type, field, target_type, many): fields whose values resolve to entities of one type only."""
    targets = entities.select(F.col("id").alias("value"), F.col("type").alias("target_type")).distinct()
    hit = values.join(targets, "value")
    found = hit.groupBy("type", "field").agg(F.count_distinct("target_type").alias("kinds"), F.min("target_type").alias("target_type"), F.bool_or("listed").alias("many"))
    return found.where("kinds = 1").drop("kinds")


def column_types(values: DataFrame) -> DataFrame:
    """(type, field, column, kind): the narrowest type that every observed value of a field has."""
    v = F.col("value")
    seen = values.where(~F.col("listed") & (F.col("kind") != "VOID") & ~F.col("kind").startswith("OBJECT"))
    number = F.col("kind").isin("BIGINT", "DOUBLE") | F.col("kind").startswith("DECIMAL")
    tests = seen.groupBy("type", "field").agg(
        F.bool_and(F.col("kind") == "BOOLEAN").alias("b"), F.bool_and(F.col("kind") == "BIGINT").alias("l"), F.bool_and(number).alias("d"), F.bool_and((F.col("kind") == "STRING") & parse_moment(v).isNotNull()).alias("t")
    )
    kind = F.when(F.col("b"), "boolean").when(F.col("l"), "bigint").when(F.col("d"), "double").when(F.col("t"), "timestamp_ntz").otherwise("string")
    return tests.select("type", "field", column_name(F.col("field")).alias("column"), kind.alias("kind"))


def foreign_keys(values: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    """(id, field_sid): the surrogate key of a single-valued relation; unresolved ones are null."""
    return values.where(F.col("field") == field).select("id", "value").join(ids.select(F.col("id").alias("value"), "sid"), "value", "left").select("id", F.col("sid").alias(f"{field}_sid"))


def associations(values: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    """Distinct (src_sid, tgt_sid) of a many-valued relation."""
    both = values.where(F.col("field") == field).join(ids.select("id", F.col("sid").alias("src_sid")), "id").join(ids.select(F.col("id").alias("value"), F.col("sid").alias("tgt_sid")), "value")
    return both.select("src_sid", "tgt_sid").distinct()


def latest(rows: DataFrame, key: str, modified: str, tie: Column | None = None) -> DataFrame:
    """One row per key: the newest; a null modified always wins."""
    order = [F.desc_nulls_first(modified), tie if tie is not None else F.lit(1)]
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", modified: str = "modified") -> DataFrame:
    """Stored rows give way to incoming ones that are newer or have no date; columns may be added.

    New columns come with the incoming rows and are null in the rows that stay.
    """
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(latest(incoming, key, modified).withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    wins = F.when((F.col("_fresh") == 1) & F.col(modified).isNull(), F.lit(1)).otherwise(0)
    order = [F.desc(wins), F.desc_nulls_last(modified), F.col("_fresh")]
    return both.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place", "_fresh")


def profile(docs: DataFrame, body: str, kind: Column) -> DataFrame:
    """(type, field, presence_pct, kinds): how often each field of a JSON text column is there, and as what."""
    parsed = docs.select(kind.alias("type"), F.try_parse_json(body).alias("v")).where("v is not null")
    total = parsed.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    parsed.createOrReplaceTempView("profile_rows")
    each = docs.sparkSession.sql("SELECT p.type, x.key AS field, schema_of_variant(x.value) AS kind FROM profile_rows p, LATERAL variant_explode(p.v) AS x")
    return each.groupBy("type", "field").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).join(total, "type").select("type", "field", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("presence_pct"), "kinds")


def file_references(strings: DataFrame, column: str, extensions: list[str]) -> DataFrame:
    """Rows whose string names a file of a known kind, with extension and the year in its path; for nested documents see ``nested``."""
    found = F.lower(F.regexp_extract(column, rf"(?i)\.({'|'.join(extensions)})(?:[?#].*)?$", 1))
    year = F.regexp_extract(column, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1).try_cast("int")
    return strings.withColumn("extension", found).withColumn("year", year).where("extension <> ''")


def typed_table(values: DataFrame, kind: str, types: DataFrame) -> DataFrame:
    """One row for each entity (id) of a kind, a column for each single-valued field in its narrowest type.

    ``types`` are ``column_types``; the kind's columns are collected: as many as the kind has fields.
    """
    columns = sorted((r["field"], r["column"], r["kind"]) for r in types.where((F.col("type") == kind) & (F.col("field") != "id")).collect())
    mine = values.where((F.col("type") == kind) & ~F.col("listed") & (F.col("field") != "id"))
    wide = mine.groupBy("id").pivot("field", [c[0] for c in columns]).agg(F.first("value"))
    cast = lambda field, to: parse_moment(F.col(f"`{field}`")) if to == "timestamp_ntz" else F.col(f"`{field}`").try_cast(to)
    return wide.select("id", *(cast(f, to).alias(column) for f, column, to in columns))


#: Words before a last year that are no part of a name, in the order in which they are looked for.
YEAR_MARKS = (", vor", ", nach", ", um", " vor", " nach", " um")


def street_register(texts: DataFrame) -> DataFrame:
    """(name, year, heading, description) of registers (text): a section for each heading that ``## `` begins.

    The description is the line below the heading. A heading's last word, or else its first one, is the year
    if it is a whole number, else the year is -1. The name is the heading without that year; before a last
    year the words from ", vor", ", nach", ", um", " vor", " nach" or " um" on go too, the first of these that
    is there. A heading that ends in a word with "jahr" loses its last two words. Empty names drop.
    """
    section = texts.select(F.explode(F.split("text", "## ")).alias("section"))
    lines = F.split("section", "\n")
    head = section.select(lines.getItem(0).alias("heading"), F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("description"))
    words = F.split(trimmed(F.col("heading")), " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    number = r"^\p{Nd}+$"
    before = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    clean = before
    for mark in reversed(YEAR_MARKS):
        clean = F.when(F.contains(before, F.lit(mark)), trimmed(F.substring_index(before, mark, 1))).otherwise(clean)
    century = trimmed(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), " "))
    after = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    name = F.when(last.rlike(number), clean).when(F.contains(F.lower(last), F.lit("jahr")), century).when(first.rlike(number), after).otherwise(trimmed(F.col("heading")))
    year = F.when(last.rlike(number), last.try_cast("int")).when(first.rlike(number), first.try_cast("int")).otherwise(-1)
    return head.select(name.alias("name"), year.alias("year"), "heading", "description").where("name <> ''")


def features(collections: DataFrame, name: str = "NAME") -> DataFrame:
    """(doc, place, name, properties, geometry) of the features in feature collections (doc, body: JSON text).

    The name is the property of that name, as text; properties and geometry are JSON texts. Bodies that are no
    JSON object with a list of features give nothing, and features without a name stay, with null.
    """
    at = "$.properties['" + name.replace("'", "") + "']"
    # an object casts to its JSON text at once; anything else is copied out as a value first
    text = lambda field: f"CASE WHEN try_variant_get(x.value, '$.{field}', 'struct<>') IS NOT NULL THEN try_variant_get(x.value, '$.{field}', 'string') ELSE to_json(try_variant_get(x.value, '$.{field}', 'variant')) END AS {field}"
    view = f"feature_collections_{uuid.uuid4().hex}"
    collections.select("doc", F.try_parse_json("body").alias("v")).where("v is not null").createOrReplaceTempView(view)
    made = collections.sparkSession.sql(f"""
        SELECT c.doc, x.pos AS place, try_variant_get(x.value, "{at}", 'string') AS name, {text("properties")}, {text("geometry")}
        FROM {view} c, LATERAL variant_explode(try_variant_get(c.v, '$.features', 'variant')) AS x WHERE x.key IS NULL""")
    collections.sparkSession.catalog.dropTempView(view)
    return made


def gazetteer(names: DataFrame, shapes: DataFrame, known: DataFrame) -> DataFrame:
    """Names with their geometry where one has the same name; names that are known already stay out."""
    return names.join(known.select("name").distinct(), "name", "left_anti").join(shapes, "name", "left")


def write_by(df: DataFrame, column: str, path: str, fmt: str = "parquet") -> None:
    """One folder for each value; a value of very many rows is dealt to several tasks, a file each."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def reference_chain(items: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Items with what they refer to, step by step (table, column here, key there); missing links leave nulls."""
    for there, here, key in steps:
        items = items.join(there, F.col(here) == F.col(key), "left")
    return items


def profile_samples(docs: DataFrame, body: str, kind: Column, most: int = 3) -> DataFrame:
    """(type, field, samples): the smallest distinct values, as text, of each field of a JSON text column."""
    docs.select(kind.alias("type"), F.try_parse_json(body).alias("v")).where("v is not null").createOrReplaceTempView("sample_rows")
    each = docs.sparkSession.sql("SELECT DISTINCT p.type, x.key AS field, CAST(x.value AS STRING) AS value FROM sample_rows p, LATERAL variant_explode(p.v) AS x").where("value is not null")
    few = each.withColumn("place", F.row_number().over(Window.partitionBy("type", "field").orderBy("value"))).where(F.col("place") <= most)
    return few.groupBy("type", "field").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def mandate_holders(people: DataFrame, roles: list[str]) -> DataFrame:
    """People with a party whose role holds one of the words, one row a name (the least party and role); ``write_by`` party exports them."""
    held = people.where(F.col("party").isNotNull() & F.lower("role").rlike("|".join(roles)))
    first = held.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("party", "role")))
    return first.where("place = 1").drop("place")
