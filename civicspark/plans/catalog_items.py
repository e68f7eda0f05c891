"""Tags in detail, clusters, topics, snapshots, threads, links, summaries, names with years, features, triples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import clusters, filters, graph, quality, ranking, tags, timeline
from civicspark.plans.catalog import COSINE, TAGS_SQL, query, tag_rows
from civicspark.sources import entities
from civicspark.sources.tables import shared_folder, table, tasks_for


@query("a8_tag_details", f"""
WITH {TAGS_SQL} SELECT item, tag, scheme, CASE WHEN scheme IS NOT NULL THEN source END AS source, coalesce(confidence, 1.0) AS confidence FROM tags WHERE item IN (SELECT item FROM tags WHERE tag IN ('t1', 'q0'))""")
def tag_details(spark: SparkSession, sf: str) -> DataFrame:
    """Languages are assignments from before there were schemes, without source and confidence."""
    told = tag_rows(spark, sf).withColumn("source", F.when(F.col("scheme").isNotNull(), F.col("source")))
    return tags.details(told, tags.holding_any(told, ["t1", "q0"]))


@query("a8_tag_details_of_scheme", f"WITH {TAGS_SQL} SELECT item, tag, scheme, source, confidence FROM tags WHERE scheme = 'topic'")
def scheme_details(spark: SparkSession, sf: str) -> DataFrame:
    return tags.details(tag_rows(spark, sf), scheme="topic")


MEMBERS_SQL = "m AS (SELECT 'rolls/' || p_brand || '/' || replace(p_name, ' ', '-') || '_' || p_type || '.v' || p_size || '.PDF' AS name, CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size % 23 END AS cluster FROM part)"


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files in clusters; a quarter of the sizes is noise."""
    text = lambda c: F.col(c).cast("string")
    path = F.concat(F.lit("rolls/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), "p_type", F.lit(".v"), text("p_size"), F.lit(".PDF"))
    return table(spark, sf, "part").select(path.alias("name"), F.when(F.col("p_size") % 4 == 0, -1).otherwise(F.col("p_size") % 23).alias("cluster"))


@query("a21_token_hints", rf"""
WITH {MEMBERS_SQL}, s AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, cluster LIMIT 15),
t AS (SELECT cluster, n, unnest(regexp_extract_all(regexp_replace(string_split(name, '/')[-1], '\.[^.]*$', ''), '[A-Za-z0-9_]{{3,}}')) AS token FROM m JOIN s USING (cluster) WHERE cluster <> -1),
c AS (SELECT cluster, n, token, count(*) AS times FROM t GROUP BY 1, 2, 3)
SELECT cluster, n, row_number() OVER (PARTITION BY cluster ORDER BY times DESC, token) AS place, token, times FROM c QUALIFY place <= 10""")
def token_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen clusters and ten words are the report's own limits."""
    return clusters.token_hints(members(spark, sf))


@query("a21_cluster_sizes", f"""
WITH {MEMBERS_SQL}, s AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1)
SELECT cluster, n, (SELECT count(*) FROM s WHERE cluster <> -1) AS clusters, (SELECT sum(n)::BIGINT FROM s) AS members, (SELECT n FROM s WHERE cluster = -1) AS noise, (SELECT round(100.0::DOUBLE * sum(n) FILTER (cluster = -1) / sum(n), 2) FROM s) AS noise_pct FROM s""")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    return clusters.sizes(m).join(F.broadcast(clusters.summary(m)), F.lit(True))  # the summary is one row


@query("r10_topic_focus", f"""
WITH t AS (SELECT label AS place, 'topic ' || label AS topic, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
s AS (SELECT vec_id AS query_id, place, topic, round({COSINE.format("v.embedding", "t.e")}, 6) AS s FROM embeddings v, t)
SELECT query_id, CASE WHEN s >= 0.3 THEN topic END AS topic, greatest(s, 0) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place) = 1""")
def topic_focus(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a query; a topic's vector is the first one of its label."""
    e = table(spark, sf, "embeddings")
    topics = e.groupBy(F.col("label").alias("place")).agg(F.min_by("embedding", "vec_id").alias("vector")).withColumn("topic", F.concat(F.lit("topic "), F.col("place").cast("string")))
    return ranking.topic_focus(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), topics)


SNAPSHOT = """SELECT l_orderkey AS query_id, l_partkey AS key, max(CASE WHEN l_linenumber <> 6 THEN round(l_tax{0}, 4) END) AS distance, round(max(l_discount{1}) FILTER (l_linenumber <> {2}), 4) AS name, round(max(l_tax) FILTER (l_returnflag = 'R'), 4) AS content
FROM lineitem WHERE l_orderkey % 11 <> {3} AND (l_orderkey % 5 > 0 OR l_linenumber <> {4}) GROUP BY 1, 2"""


@query("u6_search_parity", f"""
WITH a AS ({SNAPSHOT.format("", "", 5, 3, 2)}), b AS ({SNAPSHOT.format(" + CASE WHEN l_linenumber = 4 THEN 0.05 ELSE 0.01 END", " + CASE WHEN l_linenumber = 7 THEN 0.5 ELSE 0 END", 3, 7, 3)}),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.key, b.key) AS key, a.distance AS da, b.distance AS db, a.name AS na, b.name AS nb, a.content AS ca, b.content AS cb, a.key IS NOT NULL AS in_a, b.key IS NOT NULL AS in_b FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key),
q AS (SELECT query_id, count_if(in_a) AS a, count_if(in_b) AS b, bool_or(in_a <> in_b) AS differs FROM j GROUP BY 1 HAVING a > 0), r AS (SELECT * FROM j JOIN q USING (query_id) WHERE b > 0)
SELECT query_id, NULL AS key, 'missing query' AS finding, NULL AS before, NULL AS after FROM q WHERE b = 0
UNION ALL SELECT query_id, key, 'missing key', da, NULL FROM r WHERE NOT in_b UNION ALL SELECT query_id, key, 'extra key', NULL, db FROM r WHERE NOT in_a
UNION ALL SELECT query_id, key, 'distance', da, db FROM r WHERE NOT differs AND ((da IS NULL) <> (db IS NULL) OR abs(da - db) > 0.02)
UNION ALL SELECT query_id, key, 'signals', NULL, NULL FROM r WHERE NOT differs AND ((na IS NULL) <> (nb IS NULL) OR (ca IS NULL) <> (cb IS NULL))
UNION ALL SELECT query_id, key, 'signal name', na, nb FROM r WHERE NOT differs AND abs(na - nb) > 0.02 UNION ALL SELECT query_id, key, 'signal content', ca, cb FROM r WHERE NOT differs AND abs(ca - cb) > 0.02""")
def search_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as searches, their parts as what was found; the newer snapshot lacks some searches and some parts and has other distances."""
    line, lines = F.col("l_linenumber"), table(spark, sf, "lineitem")
    tasks = tasks_for(lines, 100_000)  # a row is in both snapshots

    def snapshot(tax, discount, unnamed: int, lost: int, left_out: int) -> DataFrame:
        rows = lines.where((F.col("l_orderkey") % 11 != lost) & ((F.col("l_orderkey") % 5 > 0) | (line != left_out))).repartition(tasks, "l_orderkey")
        found = rows.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("key")).agg(
            F.max(F.when(line != 6, F.round(tax, 4))).alias("distance"), F.round(F.max(F.when(line != unnamed, discount)), 4).alias("name"), F.round(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))), 4).alias("content")
        )
        signals = F.map_filter(F.create_map(F.lit("name"), "name", F.lit("content"), "content"), lambda k, v: v.isNotNull())
        return found.select("query_id", "key", "distance", signals.alias("signals"))

    old = snapshot(F.col("l_tax"), F.col("l_discount"), 5, 3, 2)
    new = snapshot(F.col("l_tax") + F.when(line == 4, 0.05).otherwise(0.01), F.col("l_discount") + F.when(line == 7, 0.5).otherwise(0.0), 3, 7, 3)
    return quality.search_parity(old, new, tasks=tasks)


@query("w5_effective_queries", r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace('  ' || CASE turn % 5 WHEN 0 THEN left(text, 249) WHEN 1 THEN text WHEN 2 THEN left(text, 30) || '<b>' WHEN 3 THEN left(text, 240) ELSE ' ' END || ' ', '^\s+', ''), '\s+$', '') AS q FROM conversations),
g AS (SELECT * FROM t WHERE length(q) BETWEEN 1 AND 250 AND regexp_full_match(q, '[\p{L}\p{N}\s.,;:!?()\[\]{}„“«»"''’`\-–—/&%+*#@=_|~°§$€]+'))
SELECT conv_id, turn, right(string_agg(q, ' · ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 750) AS query FROM g""")
def effective_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all lengths, some with marks that no query may hold and some empty."""
    form, said = F.col("turn") % 5, F.col("text")
    asked = F.when(form == 0, F.left(said, F.lit(249))).when(form == 1, said).when(form == 2, F.concat(F.left(said, F.lit(30)), F.lit("<b>"))).when(form == 3, F.left(said, F.lit(240))).otherwise(" ")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("  "), asked, F.lit(" ")).alias("asked"))
    return timeline.effective_queries(turns, "conv_id", "turn", "asked").select("conv_id", "turn", "query")


@query("j3_unreferenced_parts", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49.5 OR (l_linenumber BETWEEN 1 AND 5 AND l_quantity = 10 + l_linenumber AND l_returnflag = 'R'))
AND p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE label = 1) AND p_partkey NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that none of eight association tables names."""
    lines = table(spark, sf, "lineitem")
    returned = [(lines.where((F.col("l_linenumber") == k) & (F.col("l_quantity") == 10 + k) & (F.col("l_returnflag") == "R")), "l_partkey") for k in range(1, 6)]
    others = [(lines.where("l_quantity > 49.5"), "l_partkey"), (table(spark, sf, "embeddings").where("label = 1"), "vec_id"), (table(spark, sf, "labels").where("quality = 1"), "doc_id")]
    return quality.unreferenced(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", returned + others)


@query("f12_summary_texts", r"""
WITH s AS (SELECT doc_id, text, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents),
g AS (SELECT * FROM s WHERE chars >= 20 AND lines >= 5 AND chars / lines::DOUBLE >= 10), k AS (SELECT g.* FROM g, (SELECT quantile_cont(chars, 0.98) AS most FROM g) WHERE chars <= most AND doc_id % 7 > 0),
r AS (SELECT doc_id, false AS summarised, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM k WHERE chars <= 8000 UNION ALL
  SELECT doc_id, true, left(regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN left(text, 9000) ELSE left(text, 500) END, '^\s+', ''), '\s+$', ''), 8000) FROM k WHERE chars > 8000 AND doc_id % 4 <> 3)
SELECT doc_id, summarised, length(text) AS chars, md5(text) AS md5 FROM r""")
def summary_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings as summaries, half of them in a fence; every fourth document has none, every seventh is done."""
    d = table(spark, sf, "documents")
    fit = quality.fit_for_summary(d, "text").select(F.col("doc_id").alias("doc"), "text")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```markdown\n"), F.left("text", F.lit(9000)), F.lit("\n``` "))).otherwise(F.left("text", F.lit(500)))
    kept = quality.summary_texts(fit, d.where("doc_id % 4 <> 3").select(F.col("doc_id").alias("doc"), said.alias("summary")), d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("doc")))
    return kept.select(F.col("doc").alias("doc_id"), "summarised", F.length("text").alias("chars"), F.md5("text").alias("md5"))


@query("f15_named_items", """
WITH n AS (SELECT p_partkey AS key, p_name AS name, o_orderdate::DATE AS date FROM part LEFT JOIN orders ON o_orderkey = p_partkey * 3 WHERE p_name LIKE '%l_t%' AND (o_orderdate IS NULL OR year(o_orderdate) BETWEEN 1993 AND 1996)),
l AS (SELECT l_partkey AS key, l_orderkey AS file, min(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END) AS place FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
SELECT key, name, date, coalesce(string_agg(file::VARCHAR, ',' ORDER BY place, file), '') AS files FROM n LEFT JOIN l USING (key) GROUP BY 1, 2, 3""")
def named_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as agenda items, dated by orders and linked to orders in two ways."""
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), (F.col("p_partkey") * 3).alias("owner"))
    moments = table(spark, sf, "orders").select(F.col("o_orderkey").alias("owner"), F.col("o_orderdate").alias("moment"))
    linked = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("file"))
    found = filters.named_items(items, moments, {"resolution": linked("R"), "auxiliary": linked("A")}, "l_t", 1993, 1996)
    return found.select("key", "name", "date", F.array_join(F.transform("files", lambda f: f.cast("string")), ",").alias("files"))


@query("s15_s17_features", """
SELECT p_brand AS name, count(*) AS features, min(l_orderkey) AS least, max(l_partkey) AS most, sum(l_linenumber)::BIGINT AS places FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 9 > 0 GROUP BY 1""")
def split_features(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as feature collections, written as files of JSON lines, read again, their features written by name and read again."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    feature = lambda line: F.struct(
        F.lit("Feature").alias("type"), F.struct(line.p_brand.alias("NAME"), line.l_linenumber.alias("NUMMER")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("doc", line.l_partkey).alias("coordinates")).alias("geometry")
    )
    own = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct("p_brand", "l_linenumber", "l_partkey")).alias("lines"))  # an order's lines
    listed = own.select("doc", F.transform("lines", feature).alias("features"))
    body = F.when(F.col("doc") % 9 > 0, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))).otherwise('{"type": "FeatureCollection", "features": {}}')
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    listed.select(body.alias("body")).write.text(f"{path}/in")
    found = entities.features(spark.read.text(f"{path}/in").select(F.monotonically_increasing_id().alias("doc"), F.col("value").alias("body")))
    entities.write_by(found, "name", f"{path}/by-name")
    again = spark.read.schema("doc long, place int, properties string, geometry string, name string").parquet(f"{path}/by-name")
    point, number = F.from_json("geometry", "coordinates array<long>")["coordinates"], F.get_json_object("properties", "$.NUMMER").cast("long")
    read = again.select("name", point.alias("point"), number.alias("number"))
    return read.groupBy("name").agg(F.count(F.lit(1)).alias("features"), F.min(F.get("point", 0)).alias("least"), F.max(F.get("point", 1)).alias("most"), F.sum("number").alias("places"))


@query("g10_valid_triples", """
SELECT l_orderkey AS subject, l_linenumber AS place, CASE WHEN l_linenumber % 2 = 0 AND l_returnflag <> 'N' THEN l_linestatus END AS object_literal, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END AS object_ref FROM lineitem
WHERE (l_linenumber % 2 = 0 AND l_returnflag <> 'N') <> (l_linenumber % 3 = 0)""")
def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as triples with a literal, a reference, both or neither."""
    line = F.col("l_linenumber")
    literal, ref = F.when((line % 2 == 0) & (F.col("l_returnflag") != "N"), F.col("l_linestatus")), F.when(line % 3 == 0, F.col("l_partkey"))
    return graph.valid_triples(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subject"), line.alias("place"), literal.alias("object_literal"), ref.alias("object_ref")))


@query("e23_grounding_report", """
WITH v AS (SELECT DISTINCT p_brand AS tag, p_size AS qualifier FROM part WHERE p_size % 3 > 0 AND p_type <> 'PROMO') SELECT p_brand AS tag, count(*) FILTER (v.tag IS NOT NULL) AS kept, count(*) FILTER (v.tag IS NULL) AS rejected FROM part LEFT JOIN v ON v.tag = p_brand AND v.qualifier = p_size GROUP BY 1""")
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Brands and sizes as qualified tags; the vocabulary is what parts of all types but one have, without every third size."""
    pairs = table(spark, sf, "part").select(F.col("p_brand").alias("tag"), F.col("p_size").alias("qualifier"), "p_type")
    return tags.grounding_report(*tags.within_vocabulary(pairs, pairs.where("qualifier % 3 > 0 and p_type <> 'PROMO'")))


@query("e3_j7_chunk_report", """
WITH c AS (SELECT doc_id AS doc, unnest(range(n_chars // 700)) AS chunk_index FROM documents), v AS (SELECT DISTINCT vec_id // 3 AS doc, vec_id % 3 AS chunk_index FROM embeddings)
SELECT 'documents without chunks' AS finding, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc FROM c) UNION ALL SELECT 'chunks without vector', count(*) FROM c ANTI JOIN v USING (doc, chunk_index) UNION ALL SELECT 'vectors without chunk', count(*) FROM v ANTI JOIN c USING (doc, chunk_index)""")
def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk for each whole 700 characters of a document, three vectors a document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.floor(F.col("n_chars") / 700).alias("n"))
    chunks = d.where("n > 0").select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk_index"))
    vectors = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("doc"), (F.col("vec_id") % 3).alias("chunk_index")).distinct()
    return quality.chunk_report(d.select("doc"), chunks, vectors)
