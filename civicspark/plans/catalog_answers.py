"""Candidates of several item types with provenance, answers about meetings, totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import chunks, graph, ranking, tags
from civicspark.plans.catalog import COSINE, TAGS_SQL, TRIGRAMS, batch_of_vectors, query, tag_rows
from civicspark.sources.tables import shared_folder, table

STRIPPED = r"trim(regexp_replace(regexp_replace(lower({0}), '\b(?:small|steel)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _lexical(kind: str, source: str) -> str:
    return f"""SELECT '{kind}' AS type, 0 AS signal, query_id, key, rank, NULL::DOUBLE AS distance, NULL::INT AS chunk FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (
    SELECT query_id, key, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS score FROM asked, (SELECT key, {TRIGRAMS.format(STRIPPED.format("name"))} AS b FROM {source})) WHERE score > 0.3) WHERE rank <= 20"""


def _named(kind: str, rest: int) -> str:
    return f"SELECT '{kind}', 1, query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, 1 - score, NULL FROM v WHERE key % 3 = {rest} AND round(1 - score, 6) < 0.9 QUALIFY rank <= 20"


@query("r7_typed_candidates", f"""
WITH asked AS (SELECT vec_id AS query_id, {TRIGRAMS.format(STRIPPED.format("p_name"))} AS a FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 50 = 0),
files AS (SELECT p_partkey AS key, p_name AS name FROM part), papers AS (SELECT min(p_partkey) AS key, p_type AS name FROM part GROUP BY 2), meetings AS (SELECT vec_id AS key, 'M' || vec_id AS name FROM embeddings WHERE vec_id % 2 = 0),
v AS (SELECT q.vec_id AS query_id, e.vec_id AS key, round({COSINE.format("q.embedding", "e.embedding")}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
b AS (SELECT query_id, key // 2 AS doc, max(score) AS score, arg_max(key % 2, (score, -(key % 2))) AS chunk FROM v GROUP BY 1, 2),
r AS ({_lexical("File", "files")} UNION ALL {_lexical("Paper", "papers")} UNION ALL {_named("File", 0)} UNION ALL {_named("Paper", 1)} UNION ALL {_named("Meeting", 2)} UNION ALL
  SELECT 'File', 2, query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, 1 - score, chunk FROM b QUALIFY rank <= 20),
f AS (SELECT query_id, type, key, round(sum(1.0::DOUBLE / (60 + rank)), 5) AS score, min((signal, rank)) AS first, bool_or(signal = 0) AS lexical, round(max(distance) FILTER (signal = 1), 4) AS by_name, round(max(distance) FILTER (signal = 2), 4) AS by_content, nullif(max(chunk), 0) AS content_chunk
  FROM r WHERE type <> 'Paper' OR key % 5 > 0 GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY first, key::VARCHAR) AS place FROM f),
n AS (SELECT 'File' AS type, key, name FROM files UNION ALL SELECT 'Paper', key, name FROM papers UNION ALL SELECT 'Meeting', key, name FROM meetings)
SELECT query_id, type || '_' || key AS id, CASE WHEN place <= 40 THEN name END AS name, score, CASE WHEN lexical THEN true END AS lexical, by_name, by_content, content_chunk FROM p LEFT JOIN n USING (type, key) WHERE type = 'File' OR (place <= 40 AND name IS NOT NULL)""")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    """Three item types: files by lexical, name and content signals, papers (of which filters leave four fifths) by two, meetings by one."""
    part, e = table(spark, sf, "part"), table(spark, sf, "embeddings")
    vectors = batch_of_vectors(spark, sf)
    asked = vectors.select("query_id").join(part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")).hint("merge"), "query_id")
    files = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    papers = part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("key"))
    meetings = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("key"), F.concat(F.lit("M"), "vec_id").alias("name"))
    lexical = lambda items: ranking.lexical_recall(asked, items, n=20, stop_terms=["small", "steel"])
    named = lambda rest: ranking.vector_recall(vectors, e.where(F.col("vec_id") % 3 == rest).select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), n=20).withColumn("distance", 1 - F.col("score"))
    parts = ranking.best_chunk(vectors, e.select(F.floor(F.col("vec_id") / 2).alias("doc"), (F.col("vec_id") % 2).alias("chunk"), F.col("embedding").alias("vector")), 20).withColumnRenamed("doc", "key")
    content = ranking.top_per(parts, ["query_id"], [F.desc("score"), F.col("key")], 20).withColumn("distance", 1 - F.col("score"))
    recalls = [("File", "lexical", lexical(files)), ("Paper", "lexical", lexical(papers)), ("File", "name", named(0)), ("Paper", "name", named(1)), ("Meeting", "name", named(2)), ("File", "content", content)]
    wanted = part.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("key")).unionByName(e.where("vec_id % 5 > 0").select(F.col("vec_id").alias("key")))
    found = ranking.fused_candidates(recalls, {"File": files, "Paper": papers, "Meeting": meetings}, {"Paper": wanted}, per_signal=20)
    return found.select("query_id", "id", "name", "score", "signals.lexical", F.col("signals.name").alias("by_name"), F.col("signals.content").alias("by_content"), "signals.content_chunk")


@query("g8_meeting_rounds", """
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
e AS (SELECT DISTINCT 'order_' || o AS source, 'part_' || p AS target, 'part' AS relation FROM l UNION SELECT DISTINCT 'part_' || p, 'supplier_' || s, 'supplier' FROM l UNION SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'nation' FROM supplier UNION SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 'customer' FROM orders),
b AS (SELECT source AS here, target AS node, * FROM e UNION ALL SELECT target, source, * FROM e),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY here, relation ORDER BY node) <= 3), k AS (SELECT * FROM n WHERE node NOT LIKE 'customer%'),
s0 AS (SELECT 'order_' || o_orderkey AS seed FROM orders), r0 AS (SELECT DISTINCT seed, node, source, target, relation FROM s0 JOIN k ON here = seed),
v0 AS (SELECT seed, seed AS node FROM s0 UNION SELECT seed, node FROM r0), r1 AS (SELECT DISTINCT seed, k.node, source, target, relation FROM v0 JOIN k ON here = v0.node AND v0.node LIKE 'part%'),
v1 AS (SELECT * FROM v0 UNION SELECT seed, node FROM r1), r2 AS (SELECT DISTINCT seed, k.node, source, target, relation FROM v1 JOIN k ON here = v1.node AND v1.node LIKE 'supplier%'),
x AS (SELECT * FROM r0 UNION SELECT * FROM r1 UNION SELECT * FROM r2), y AS (SELECT DISTINCT seed, source, target, relation FROM x)
SELECT seed, relation, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, min(source) AS least FROM y GROUP BY 1, 2""")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    """All orders (meetings) expanded in rounds over parts and suppliers; customers are hubs and stay out."""
    l, link = table(spark, sf, "lineitem"), graph.Link
    edges = graph.edges([
        (l, link("part", "order", "l_orderkey", "part", "l_partkey")), (l, link("supplier", "part", "l_partkey", "supplier", "l_suppkey")),
        (table(spark, sf, "supplier"), link("nation", "supplier", "s_suppkey", "nation", "s_nationkey")), (table(spark, sf, "orders"), link("customer", "order", "o_orderkey", "customer", "o_custkey")),
    ])
    seeds = table(spark, sf, "orders").select(graph.node_id("order", "o_orderkey").alias("node"))
    return graph.tallied_in_rounds(seeds, edges, ["part", "supplier"], skip=["customer"], per_relation=3)


@query("a3_summed_distribution", f"WITH {TAGS_SQL}, c AS (SELECT DISTINCT conv_id AS item, role AS tag, 'topic' AS scheme FROM conversations) SELECT scheme, tag, sum(n)::BIGINT AS items FROM (SELECT coalesce(scheme, '(none)') AS scheme, tag, count(DISTINCT item) AS n FROM tags GROUP BY 1, 2 UNION ALL SELECT scheme, tag, count(DISTINCT item) FROM c GROUP BY 1, 2 UNION ALL SELECT 'topic', 't1', count(*) FROM labels WHERE toxic = 1) GROUP BY 1, 2")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "conversations").select(F.col("conv_id").alias("item"), F.col("role").alias("tag"), F.lit("topic").alias("scheme"))
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("item"), F.lit("t1").alias("tag"), F.lit("topic").alias("scheme"))
    return tags.distribution([tag_rows(spark, sf), roles, toxic])


@query("a19_party_totals", "SELECT CASE WHEN grouping(p) = 0 THEN coalesce(p, '(none)') END AS party, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM (SELECT event_type, CASE WHEN user_id % 5 > 0 THEN 'party ' || user_id % 5 END AS p FROM events) GROUP BY GROUPING SETS ((p), ())")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "events").select(F.upper("event_type").alias("choice"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("party "), (F.col("user_id") % 5).cast("string"))).alias("party"))
    return tags.choice_totals(votes, ["click", "view"])


@query("e2_stored_chunks", """
SELECT doc_id AS doc, CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 1 END::BIGINT AS chunks, CASE WHEN doc_id % 50 = 0 THEN 'again ' || text || 'END' ELSE text END AS text FROM documents""")
def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All texts as one chunk each; then a batch comes anew, with other words before and a second chunk, and is put into the same table."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    piece = lambda df, number, text: df.select("doc", F.lit(number).alias("chunk_index"), text.alias("text"))
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.store_chunks(piece(d, 0, F.col("text")), path, buckets=16)
    again = d.where("doc % 50 = 0")
    chunks.store_chunks(piece(again, 1, F.concat(F.lit("again "), "text")).unionByName(piece(again, 2, F.lit("END"))), path, buckets=16)
    stored = spark.read.parquet(path)
    return chunks.whole_texts(stored).join(stored.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks")), "doc").select("doc", "chunks", "text")


@query("e5_assigned_tags", f"""
WITH {TAGS_SQL}, known AS (SELECT * FROM tags WHERE item % 2 = 0 AND scheme = 'topic'),
offered AS (SELECT item, tag, scheme, CASE WHEN item % 7 = 0 THEN 'guess' ELSE source END AS source, CASE WHEN item % 11 = 0 THEN 1.5 ELSE confidence END AS confidence FROM tags WHERE scheme IS NOT NULL UNION ALL SELECT item, tag, scheme, 'rule', 0.3 FROM tags WHERE scheme IS NOT NULL AND item % 3 = 0),
good AS (SELECT * FROM offered WHERE source IN ('manual', 'rule', 'model') AND (confidence IS NULL OR confidence BETWEEN 0 AND 1) QUALIFY row_number() OVER (PARTITION BY item, tag, scheme ORDER BY confidence DESC NULLS LAST, source) = 1)
SELECT 'kept' AS part, item, tag, source, confidence FROM known UNION ALL SELECT 'kept', item, tag, source, confidence FROM good g WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.item = g.item AND k.tag = g.tag AND k.scheme = g.scheme)
UNION ALL SELECT 'rejected', item, tag, source, confidence FROM offered WHERE source = 'guess' OR confidence > 1""")
def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Tags offered anew, of which some are known, some come twice, and some have a source or a confidence that is none."""
    told = tag_rows(spark, sf)
    known = told.where("item % 2 = 0 and scheme = 'topic'")
    of_scheme = told.where("scheme is not null")
    first = of_scheme.withColumns({"source": F.when(F.col("item") % 7 == 0, "guess").otherwise(F.col("source")), "confidence": F.when(F.col("item") % 11 == 0, 1.5).otherwise(F.col("confidence"))})
    second = of_scheme.where("item % 3 = 0").withColumns({"source": F.lit("rule"), "confidence": F.lit(0.3)})
    every, rejected = tags.assign(known, first.unionByName(second))
    columns = ["item", "tag", "source", "confidence"]
    return every.select(F.lit("kept").alias("part"), *columns).unionByName(rejected.select(F.lit("rejected").alias("part"), *columns))


@query("e6_dropped_tag", f"WITH {TAGS_SQL} SELECT 'catalog' AS part, NULL::BIGINT AS item, tag FROM tags WHERE tag <> 't1' GROUP BY tag UNION ALL SELECT 'assignments', item, tag FROM tags WHERE tag <> 't1'")
def dropped(spark: SparkSession, sf: str) -> DataFrame:
    told = tag_rows(spark, sf)
    catalog_, left = tags.drop_tag(told.select("tag").distinct(), told, ["t1", "unknown"])
    none = F.lit(None).cast("long").alias("item")
    return catalog_.select(F.lit("catalog").alias("part"), none, "tag").unionByName(left.select(F.lit("assignments").alias("part"), "item", "tag"))
