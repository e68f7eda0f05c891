"""Registered queries over the driver's tables, each with SQL that DuckDB answers alike.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import blocks, chunks, filters, graph, pairs, places, quality, ranking, tags, timeline
from civicspark.sources import entities
from civicspark.sources.tables import spread, table
from civicspark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


#: DuckDB macros of the text functions, written from the same definitions.
TRIGRAMS = r"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, len(w) + 2)] FOR w IN regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')]))"
COSINE = "(CASE WHEN sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {0}])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {1}])) = 0 THEN 0 ELSE list_sum([{0}[i]::DOUBLE * {1}[i]::DOUBLE FOR i IN range(1, len({0}) + 1)]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {0}])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {1}]))) END)"

# --- retrieval -----------------------------------------------------------------------------------


def batch_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """The batch of query names: parts whose key 50 divides."""
    return table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))


def batch_of_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


LEXICAL = f"""
named AS (SELECT p_name AS name, min(p_partkey) AS key FROM part GROUP BY 1),
i AS (SELECT key, name, {TRIGRAMS.format("name")} AS tri FROM named),
q AS (SELECT p_partkey AS query_id, {TRIGRAMS.format("p_name")} AS tri FROM part WHERE p_partkey % 50 = 0),
lexical AS (
  SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (
    SELECT query_id, key, round(len(list_intersect(q.tri, i.tri)) / (len(q.tri) + len(i.tri) - len(list_intersect(q.tri, i.tri)))::DOUBLE, 6) AS score FROM q, i)
  WHERE score > 0.3 QUALIFY rank <= 50)"""


def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("key"))


@query("r1_t1_lexical_recall", f"WITH {LEXICAL} SELECT query_id, key, score, rank FROM lexical")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.lexical_recall(batch_of_names(spark, sf), distinct_names(spark, sf))


VECTORS = f"""
qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
vector AS (
  SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (
    SELECT query_id, vec_id AS key, round({COSINE.format("qv.e", "v.embedding")}, 6) AS score FROM qv, embeddings v)
  WHERE 1 - score < 0.9 QUALIFY rank <= 50)"""


@query("r2_t3_vector_recall", f"WITH {VECTORS} SELECT query_id, key, score, rank FROM vector")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return ranking.vector_recall(batch_of_vectors(spark, sf), items)


@query("r3_w2_best_chunk", f"""
WITH qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, label AS doc, vec_id AS chunk, round({COSINE.format("qv.e", "v.embedding")}, 6) AS score FROM qv, embeddings v)
SELECT query_id, doc, score, chunk FROM s QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, chunk) = 1""")
def r3(spark: SparkSession, sf: str) -> DataFrame:
    chunks_ = table(spark, sf, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    return ranking.best_chunk(batch_of_vectors(spark, sf), chunks_)


@query("r6_w1_u4_hybrid_fused_top10", f"""
WITH {LEXICAL}, {VECTORS},
lists AS (SELECT 'lexical' AS signal, query_id, key, rank FROM lexical UNION ALL SELECT 'vector', query_id, key, rank FROM vector),
fused AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM lists GROUP BY 1, 2)
SELECT query_id, key, score, signals, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fused QUALIFY rank <= 10""")
def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """For the batch of query names: lexical and vector signals fused, the best ten with provenance."""
    signals = r1(spark, sf).withColumn("signal", F.lit("lexical")).unionByName(r2(spark, sf).withColumn("signal", F.lit("vector")))
    return ranking.top_per(ranking.fuse(signals), ["query_id"], [F.desc("score"), F.col("key")], 10)


@query("r8_r9_rerank_boost", """
WITH s AS (SELECT l_orderkey % 100 AS query_id, l_partkey AS key, max(l_discount) AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT query_id, key, score * CASE WHEN p_size > 40 THEN 1.2 ELSE 1 END AS score FROM s JOIN part ON key = p_partkey),
r AS (SELECT query_id, b.key, score, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 50.0::DOUBLE END AS rr FROM b JOIN part ON b.key = p_partkey)
SELECT query_id, key, round(score * coalesce(rr, 1.0), 6) AS score FROM r WHERE rr IS NULL OR rr >= 0.8""")
def r8(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    scored = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("query_id"), F.col("l_partkey").alias("key")).agg(F.max("l_discount").alias("score"))
    lifted = ranking.boost(scored.join(part.select(F.col("p_partkey").alias("key")), "key", "left_semi"), part.where("p_size > 40").select(F.col("p_partkey").alias("key")))
    second = lifted.select("query_id", "key").join(part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") / 50.0).alias("rerank")), "key")
    return ranking.rerank(lifted, second).select("query_id", "key", F.round("score", 6).alias("score"))


@query("r11_centroid_classes", f"""
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2),
c AS (SELECT label, list(v ORDER BY i) AS centroid FROM m GROUP BY 1),
s AS (SELECT vec_id AS key, c.label, round({COSINE.format("v.embedding", "c.centroid")}, 6) AS score FROM embeddings v, c)
SELECT key, label, score FROM s WHERE true QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, label DESC) = 1 AND score >= 0.1""")
def r11(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    items = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return ranking.nearest_centroid(items, ranking.centroids(e, "label", "embedding"), "label", 0.1)


WORDSIM = r"""list_max(flatten([[len(list_intersect(tri, seq[a:b]))::DOUBLE / (len(tri) + len(list_distinct(seq[a:b])) - len(list_intersect(tri, seq[a:b]))) FOR b IN range(a, len(seq) + 1)] FOR a IN range(1, len(seq) + 1)]))"""
SEQUENCE = r"flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, len(w) + 2)] FOR w IN regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')])"


@query("r12_t2_t32_place_resolution", f"""
WITH kinds AS (SELECT 'type' AS kind, n AS name, n AS name_id FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS n FROM part) UNION ALL SELECT 'brand', b, b FROM (SELECT DISTINCT p_brand AS b FROM part)),
asked AS (SELECT p_partkey AS query_id, lower(trim(substr(p_type, 2) || ' near ' || p_brand)) AS query FROM part WHERE p_partkey % 50 = 0),
i AS (SELECT *, {TRIGRAMS.format("name")} AS tri FROM kinds),
q AS (SELECT query_id, {SEQUENCE.format("query")} AS seq, CASE WHEN regexp_matches(query, '\\b\\w*(?:eel|ass)\\b') THEN 0.4 ELSE 0.5 END AS least FROM asked),
s AS (SELECT query_id, kind, name_id, name, round({WORDSIM}, 4) AS score, least FROM q, i),
k AS (SELECT * FROM s WHERE score > least QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, name_id) <= 5),
b AS (SELECT *, first_value(score) OVER w AS best, first_value(lower(name)) OVER w AS best_name FROM k WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, name))
SELECT query_id, kind, name_id, name, score, lower(name) = best_name AS is_best FROM b WHERE lower(name) = best_name OR score >= round(best - 0.1, 4)""")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    """Which names of two gazetteers (words of part types, brands) the batch of misspelt queries may mean."""
    part = table(spark, sf, "part")
    kind = lambda label, c: part.select(F.lit(label).alias("kind"), c.alias("name")).distinct().withColumn("name_id", F.col("name"))
    names = kind("type", F.explode(F.split("p_type", " "))).unionByName(kind("brand", F.col("p_brand")))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.expr("substr(p_type, 2)"), F.lit(" near "), "p_brand").alias("query"))
    return places.resolve_places(asked, names, suffixes=["eel", "ass"])


@query("e26_tiers", """
WITH q AS (SELECT DISTINCT c_mktsegment AS query_id FROM customer),
t AS (SELECT query_id, c_custkey AS key, 0 AS tier FROM q JOIN customer ON c_mktsegment = query_id AND c_acctbal > 9900 UNION ALL
      SELECT query_id, c_custkey, 1 FROM q JOIN customer ON c_mktsegment = query_id AND c_acctbal > 9000 AND c_nationkey < 3)
SELECT query_id, key, tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query_id)""")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("query_id"), F.col("c_custkey").alias("key"), "c_acctbal", "c_nationkey")
    tiers = [c.where("c_acctbal > 9900"), c.where("c_acctbal > 9000 and c_nationkey < 3")]
    return places.tiered([t.select("query_id", "key") for t in tiers])


@query("r14_w8_newest_linked", """
SELECT o_custkey, o_orderkey, total, place FROM (
  SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 5""")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.newest_first(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 5).select("o_custkey", "o_orderkey", "total", "place")


@query("r15_agenda_order", """
WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN p_type ELSE p_size::VARCHAR || '.' || (p_partkey % 10)::VARCHAR END AS number FROM part)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN try_cast(number AS DOUBLE) IS NOT NULL THEN 0 WHEN number IS NULL THEN 1 ELSE 2 END, try_cast(number AS DOUBLE) NULLS FIRST, number NULLS FIRST, p_partkey) AS place FROM n""")
def r15(spark: SparkSession, sf: str) -> DataFrame:
    """Every item's place within its owner (a brand stands for a meeting)."""
    number = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, F.col("p_type")).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string")))
    items = table(spark, sf, "part").select("p_brand", "p_partkey", number.alias("number"))
    return timeline.agenda_places(items, "p_brand", "number", "p_partkey").select("p_brand", "p_partkey", "place")


@query("r16_priority_order", """
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_response FROM orders ORDER BY has_response DESC, o_orderkey LIMIT 100""")
def r16(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has_response", F.lit(True))
    return table(spark, sf, "orders").select("o_orderkey").join(marked, "o_orderkey", "left").select("o_orderkey", F.coalesce("has_response", F.lit(False)).alias("has_response")).orderBy(F.desc("has_response"), "o_orderkey").limit(100)


@query("a25_intent_choice", """
WITH s AS (SELECT o_custkey AS query_id, o_orderpriority AS intent, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
t AS (SELECT o_orderpriority AS intent, avg(o_totalprice) * 1.2 AS threshold FROM orders GROUP BY 1),
b AS (SELECT query_id, intent FROM s JOIN t USING (intent) WHERE score >= threshold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intent DESC) = 1)
SELECT DISTINCT s.query_id, coalesce(b.intent, 'search') AS intent FROM s LEFT JOIN b USING (query_id)""")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    scores = o.groupBy(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("intent")).agg(F.max("o_totalprice").alias("score"))
    return ranking.arg_max_or(scores, o.groupBy(F.col("o_orderpriority").alias("intent")).agg((F.avg("o_totalprice") * 1.2).alias("threshold")), "search")


# --- filters, facets, joins ------------------------------------------------------------------------


@query("f1_f2_f4_structured_filter", """
SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    specs = [{"facet": "paperType", "values": ["1-URGENT", "2-HIGH"]}, {"facet": "year", "op": "range", "from": "1995", "to": "1996"}]
    return table(spark, sf, "orders").where(filters.predicate(specs, {"paperType": "o_orderpriority", "paper": "o_orderdate"})).select("o_orderkey")


@query("f3_f5_tag_facet", """
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    """The tag within its scheme; the same name in another scheme says nothing."""
    told = tag_rows(spark, sf).withColumnRenamed("item", "doc_id")
    other = told.where("scheme = 'document-type'").withColumn("tag", F.lit("t1"))
    return filters.tagged(table(spark, sf, "documents"), told.unionByName(other), {"facet": "tag", "scheme": "topic", "values": ["t1"]}, "doc_id").select("doc_id", "lang")


@query("f6_two_hop_place_facet", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('EUROPE', 'ASIA', 'REGION_1', 'REGION_2')))")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region").where(F.col("r_name").isin("EUROPE", "ASIA", "REGION_1", "REGION_2")).select(F.col("r_regionkey").alias("n_regionkey"))
    nations = filters.having(table(spark, sf, "nation"), regions, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"))
    return filters.having(table(spark, sf, "customer"), nations, "c_nationkey").select("c_custkey")


@query("f7_organization_facet", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    makers = filters.having(table(spark, sf, "supplier"), nations, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"))
    return filters.having(table(spark, sf, "lineitem"), makers, "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("f8_f9_f10_null_keeping_filters", """
WITH x AS (SELECT event_id, CASE WHEN value > 50 THEN NULL WHEN value > 20 THEN true ELSE false END AS deleted, CASE WHEN event_type = 'view' THEN 'boilerplate' WHEN event_type = 'click' THEN NULL ELSE 'content' END AS status, value FROM events)
SELECT event_id FROM x WHERE NOT coalesce(deleted, false) AND (status IS NULL OR status <> 'boilerplate') AND value <= 90""")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    deleted = F.when(F.col("value") > 50, None).when(F.col("value") > 20, True).otherwise(False)
    status = F.when(F.col("event_type") == "view", "boilerplate").when(F.col("event_type") == "click", None).otherwise("content")
    return table(spark, sf, "events").where(filters.not_deleted(deleted) & filters.not_boilerplate(status) & (F.col("value") <= 90)).select("event_id")


@query("f11_name_scope", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)(?:^small)|(?:ring$)')")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(tx.any_match(F.col("p_name"), ["^small", "ring$"])).select("p_partkey")


@query("f12_document_quality", r"""
WITH s AS (SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents),
g AS (SELECT * FROM s WHERE chars >= 20 AND lines >= 5 AND chars / lines::DOUBLE >= 10),
m AS (SELECT quantile_cont(chars, 0.98) AS most FROM g)
SELECT doc_id, chars, lines, chars > 8000 AS oversized FROM g, m WHERE chars <= most""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return quality.fit_for_summary(table(spark, sf, "documents"), "text").select("doc_id", "chars", "lines", (F.col("chars") > 8000).alias("oversized"))


@query("f13_f14_text_choice", """
WITH f AS (SELECT doc_id::VARCHAR AS stem, text FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT doc_id::VARCHAR AS stem, left(text, 900) AS summary FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(f.stem, s.stem) AS stem, length(CASE WHEN f.text IS NOT NULL AND (s.summary IS NULL OR (length(f.text) < 3000 AND length(f.text) < 2 * length(s.summary))) THEN f.text ELSE s.summary END) AS chosen FROM f FULL JOIN s ON f.stem = s.stem""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    full = d.where("doc_id % 3 <> 0").select(tx.file_key(F.concat(F.lit("00"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("stem"), "text")
    short = d.where("doc_id % 4 <> 0").select(tx.file_key(F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("stem"), F.left("text", F.lit(900)).alias("summary"))
    n, k = F.length("text"), F.length("summary")
    return full.join(short, "stem", "full").select("stem", F.length(F.when(n.isNotNull() & (k.isNull() | ((n < 3000) & (n < 2 * k))), F.col("text")).otherwise(F.col("summary"))).alias("chosen"))


@query("f15_name_search_with_years", """
SELECT p_partkey, p_name, max(l_shipdate) AS latest FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_name LIKE '%ring%' AND year(l_shipdate) BETWEEN 1994 AND 1996 GROUP BY 1, 2""")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    shipped = table(spark, sf, "lineitem").where(F.year("l_shipdate").between(1994, 1996)).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("latest"))
    return table(spark, sf, "part").where(F.col("p_name").contains("ring")).join(shipped, "p_partkey").select("p_partkey", "p_name", "latest")


@query("f16_j3_orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").join(table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("j1_j2_left_chain", """
SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(n_name) AS nation FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    mine = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total"))
    out = table(spark, sf, "customer").join(mine, "c_custkey", "left").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), F.col("n_name").alias("nation"))


@query("j5_j6_j7_missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id IN (SELECT doc_id FROM labels)")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(table(spark, sf, "labels"), "doc_id", "left_semi").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


WORDS_SQL = r"(SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents)"


@query("j8_e8_dictionary_join", rf"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
starts AS (SELECT w, unnest(range(1, len(w) + 1, 40)) AS i FROM lists WHERE doc_id % 50 = 0),
names AS (SELECT DISTINCT w[i : i + n] AS parts FROM starts, (VALUES (0), (1), (2)) t(n) WHERE i + n <= len(w)),
heads AS (SELECT list_aggregate(parts, 'string_agg', ' ') AS name, parts, len(parts) AS words, parts[1] AS head FROM names),
spots AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM lists),
hits AS (SELECT doc_id, pos, name, words FROM spots JOIN heads ON x = head JOIN lists USING (doc_id) WHERE w[pos + 1 : pos + words] = parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -length(name), pos, words, name) AS k FROM hits),
fold AS (
  SELECT doc_id, 1::BIGINT AS k, [{{'s': pos, 'e': pos + words, 'name': name}}] AS kept FROM ranked WHERE k = 1 UNION ALL
  SELECT f.doc_id, r.k, CASE WHEN len(list_filter(kept, lambda o: o.s < r.pos + r.words AND r.pos < o.e)) > 0 THEN kept ELSE list_append(kept, {{'s': r.pos, 'e': r.pos + r.words, 'name': r.name}}) END
  FROM fold f JOIN ranked r ON r.doc_id = f.doc_id AND r.k = f.k + 1),
done AS (SELECT doc_id, unnest(kept).name AS name FROM fold QUALIFY k = max(k) OVER (PARTITION BY doc_id))
SELECT name, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM done GROUP BY 1""")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one to three words (runs at every 40th word of the batch of documents whose id 50 divides) in all texts."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))
    starts = F.filter(F.transform("w", lambda x, i: i), lambda i: i % 40 == 0)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, n), " ")))))
    names = d.where("doc % 50 = 0").select(places.words_at("text").alias("w")).select(F.explode(F.array_compact(runs)).alias("name")).distinct().withColumn("name_id", F.col("name"))
    found = places.longest_matches(d, names)
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc").alias("docs"))


@query("j9_w6_banded_name_join", """
WITH b AS (SELECT p_partkey AS key, p_name || ' ' || p_type AS name, CASE WHEN p_size % 10 > 0 THEN 1990 + p_size % 9 END AS year FROM part), a AS (SELECT * FROM b WHERE key % 50 = 0),
p AS (SELECT a.key, b.key AS other_key, 1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name))::DOUBLE AS ratio, abs(a.year - b.year) AS apart FROM a JOIN b ON a.key <> b.key AND coalesce(abs(a.year - b.year), 0) <= 1),
r AS (SELECT key, other_key, round(CASE WHEN apart IS NULL THEN ratio ELSE least(1.0, ratio + 0.1) END, 6) AS ratio FROM p)
SELECT key, other_key, ratio FROM r WHERE ratio >= 0.75 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ratio DESC, other_key) = 1""")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    """The batch of parts whose key 50 divides against all parts."""
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.when(F.col("p_size") % 10 > 0, 1990 + F.col("p_size") % 9).alias("year"))
    return pairs.similar_names(b.where("key % 50 = 0"), b)


@query("j12_name_correction", """
WITH n AS (SELECT DISTINCT p_type || 'x' AS name FROM part), k AS (SELECT DISTINCT p_type AS right_name FROM part),
s AS (SELECT name, right_name, round(1 - levenshtein(lower(name), lower(right_name)) / greatest(length(name), length(right_name))::DOUBLE, 6) AS ratio FROM n, k),
b AS (SELECT * FROM s WHERE ratio >= 0.8 QUALIFY row_number() OVER (PARTITION BY name ORDER BY ratio DESC, right_name DESC) = 1)
SELECT n.name, coalesce(right_name, n.name) AS corrected, ratio FROM n LEFT JOIN b ON b.name = n.name""")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    return pairs.corrected(kinds.select(F.concat("name", F.lit("x")).alias("name")), kinds)


@query("j13_as_of_latest", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.latest_until(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "1996-06-30", "o_orderkey")


@query("s13_reference_chain", """
SELECT l_orderkey, l_linenumber, o_custkey, coalesce(n_name, '') AS nation, coalesce(l_shipdate, o_orderdate) AS day FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    out = entities.reference_chain(table(spark, sf, "lineitem"), [(table(spark, sf, "orders"), "l_orderkey", "o_orderkey"), (table(spark, sf, "customer"), "o_custkey", "c_custkey"), (table(spark, sf, "nation"), "c_nationkey", "n_nationkey")])
    return out.select("l_orderkey", "l_linenumber", "o_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("l_shipdate", "o_orderdate").alias("day"))


# --- aggregates ------------------------------------------------------------------------------------


@query("a1_a2_facets", """
SELECT 'priority' AS facet, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY 2""")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("string").alias("year"))
    each = o.unpivot([], ["priority", "status", "year"], "facet", "value").where("value is not null and value <> ''")
    return each.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


TAGS_SQL = """tags AS (
SELECT doc_id AS item, 'q' || quality AS tag, 'document-type' AS scheme, 'model' AS source, 0.5 + (doc_id % 50) / 100.0::DOUBLE AS confidence FROM labels UNION ALL
SELECT doc_id, 't' || toxic, 'topic', CASE WHEN doc_id % 2 = 0 THEN 'rule' ELSE 'manual' END, 0.5 + (doc_id % 50) / 100.0::DOUBLE FROM labels UNION ALL
SELECT doc_id, lang, NULL, 'rule', NULL FROM documents)"""


def tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and languages as tag assignments with source and confidence."""
    sure = (0.5 + (F.col("doc_id") % 50) / 100.0).alias("confidence")
    lab, item = table(spark, sf, "labels"), F.col("doc_id").alias("item")
    a = lab.select(item, F.concat(F.lit("q"), "quality").alias("tag"), F.lit("document-type").alias("scheme"), F.lit("model").alias("source"), sure)
    b = lab.select(item, F.concat(F.lit("t"), "toxic").alias("tag"), F.lit("topic").alias("scheme"), F.when(F.col("doc_id") % 2 == 0, "rule").otherwise("manual").alias("source"), sure)
    c = table(spark, sf, "documents").select(item, F.col("lang").alias("tag"), F.lit(None).cast("string").alias("scheme"), F.lit("rule").alias("source"), F.lit(None).cast("double").alias("confidence"))
    return a.unionByName(b).unionByName(c)


@query("a3_a18_tag_distribution", f"WITH {TAGS_SQL} SELECT coalesce(scheme, '(none)') AS scheme, tag, count(DISTINCT item) AS items, round(avg(confidence), 3) AS mean FROM tags GROUP BY 1, 2")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return tag_rows(spark, sf).groupBy(F.coalesce("scheme", F.lit("(none)")).alias("scheme"), "tag").agg(F.count_distinct("item").alias("items"), F.round(F.avg("confidence"), 3).alias("mean"))


@query("a4_linked_items", "SELECT nation, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS nation, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(DISTINCT s_suppkey) FROM supplier GROUP BY 1) GROUP BY 1")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_distinct("c_custkey").alias("n"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count_distinct("s_suppkey").alias("n"))
    return c.unionByName(s).groupBy("nation").agg(F.sum("n").alias("n"))


@query("a5_coverage", """
WITH t AS (SELECT count(DISTINCT doc_id) AS total FROM documents), l AS (SELECT 'labels' AS layer, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'vectors', count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))
SELECT layer, n, round(100.0::DOUBLE * n / total, 1) AS pct FROM l, t""")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage(table(spark, sf, "documents"), {"labels": table(spark, sf, "labels"), "vectors": table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))}, "doc_id")


@query("a6_all_tags", f"WITH {TAGS_SQL} SELECT item FROM tags WHERE tag IN ('q1', 't0', 'en') GROUP BY 1 HAVING count(DISTINCT tag) = 3")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return tags.holding_all(tag_rows(spark, sf), ["q1", "t0", "en"])


@query("a7_a8_item_tags", f"WITH {TAGS_SQL} SELECT item, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags WHERE item IN (SELECT item FROM tags WHERE tag IN ('t1', 'q0')) GROUP BY 1")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    t = tag_rows(spark, sf)
    return tags.of_items(t.join(tags.holding_any(t, ["t1", "q0"]), "item", "left_semi")).select("item", F.array_join("tags", ",").alias("tags"))


@query("a9_related_by_tags", f"""
WITH {TAGS_SQL}, s AS (SELECT item, tag, CASE WHEN item % 3 > 0 THEN confidence END AS confidence FROM tags WHERE scheme IS NOT NULL UNION ALL SELECT item, tag, NULL FROM tags WHERE scheme IS NULL),
seeds AS (SELECT doc_id AS item FROM documents WHERE doc_id % 50 = 0), own AS (SELECT tag, coalesce(max(confidence), 0.5) AS best FROM s WHERE item IN (SELECT item FROM seeds) GROUP BY 1)
SELECT item, count(DISTINCT tag) AS shared, round(sum(1 + best), 6) AS score, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM s JOIN own USING (tag) WHERE item NOT IN (SELECT item FROM seeds) GROUP BY 1 HAVING count(DISTINCT tag) >= 2 ORDER BY score DESC, item LIMIT 10""")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    """All tags under one scheme; languages have no confidence. The best ten are the feature's own limit."""
    one = tag_rows(spark, sf).withColumns({"confidence": F.when(F.col("scheme").isNotNull() & (F.col("item") % 3 > 0), F.col("confidence")), "scheme": F.lit("kg")})
    other = one.where("tag = 'q1'").withColumn("scheme", F.lit("else"))
    return tags.related_by_tags(one.unionByName(other), table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("item")), "kg")


@query("a10_pattern_groups", """
WITH g AS (SELECT CASE WHEN regexp_matches(p_type, '(?i)^S') THEN 's' WHEN regexp_matches(p_type, '(?i)^P') THEN 'p' WHEN regexp_matches(p_type, '(?i)STEEL') THEN 'steel' ELSE 'Other' END AS grp, count(*) AS n FROM part WHERE p_type NOT LIKE '-%' GROUP BY 1)
SELECT CASE WHEN n >= 10 THEN grp ELSE 'Other' END AS grp, sum(n)::BIGINT AS n FROM g GROUP BY 1""")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return tags.grouped_by_pattern(table(spark, sf, "part"), "p_type", [("^S", "s"), ("^P", "p"), ("STEEL", "steel")], 10)


@query("a11_a12_thread_texts", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    whole = chunks.whole_texts(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk_index"), "text"), "\n")
    return whole.join(c.groupBy(F.col("conv_id").alias("doc")).agg(F.sum(F.length("text")).alias("chars")), "doc").select(F.col("doc").alias("conv_id"), "text", "chars")


@query("a13_tfidf", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), e AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN ('the', 'and') GROUP BY 1, 2)
SELECT word, sum(n)::BIGINT AS total, count(*) AS docs, round(sum(n) / count(*)::DOUBLE * ln((SELECT count(*) FROM documents) / count(*)::DOUBLE), 6) AS tfidf FROM e GROUP BY 1""")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.word_weights(spread(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")), ["the", "and"])


# DuckDB's distance counts bytes, so letters beyond ASCII stand as capitals, which lower-cased words don't have
LETTERS = "'äöüßéèêçñóíáúàâîôûëï¡¿', 'ABCDEFGHIJKLMNOPQRSTUV'"
CLUSTERS_SQL = rf"""
words AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents), kept AS (SELECT * FROM words WHERE length(word) >= 3 AND word NOT IN ('the', 'and')),
w AS (SELECT word, round(count(*) / count(DISTINCT doc)::DOUBLE * ln((SELECT count(*) FROM documents) / count(DISTINCT doc)::DOUBLE), 6) AS tfidf FROM kept GROUP BY 1 ORDER BY tfidf DESC, word LIMIT 1000),
o AS (SELECT word, translate(word, {LETTERS}) AS t, row_number() OVER (ORDER BY tfidf DESC, word) AS k FROM w),
fold AS (
  SELECT 0::BIGINT AS k, []::STRUCT(w VARCHAR, t VARCHAR)[] AS heads, NULL::VARCHAR AS word, NULL::VARCHAR AS representative UNION ALL
  SELECT o.k, CASE WHEN h IS NULL THEN list_append(heads, {{'w': o.word, 't': o.t}}) ELSE heads END, o.word, coalesce(h, o.word)
  FROM (SELECT f.k, f.heads, o.word AS x, list_filter(f.heads, lambda r: round(1 - levenshtein(r.t, o.t) / greatest(length(r.t), length(o.t))::DOUBLE, 6) >= 0.8)[1].w AS h FROM fold f JOIN o ON o.k = f.k + 1) s JOIN o ON o.word = s.x),
clusters AS (SELECT word, representative FROM fold WHERE word IS NOT NULL)"""


@query("a14_keyword_clusters", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT word, representative FROM clusters")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    """The thousand heaviest words in greedy clusters (the top-k is the feature's own limit)."""
    return chunks.word_clusters(heaviest_words(spark, sf))


def heaviest_words(spark: SparkSession, sf: str, n: int = 1000) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return chunks.word_weights(docs, ["the", "and"]).orderBy(F.desc("tfidf"), "word").limit(n).select("word", "tfidf")


@query("a19_choice_totals", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).select("user_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


@query("a17_pair_statistics", """
WITH k AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT 'documents' AS measure, CASE WHEN k <= 5 THEN '<=5' ELSE '>5' END AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'outcome', coalesce(o_orderstatus, '(none)'), count(*) FROM k GROUP BY 2""")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_orderstatus").alias("outcome"))
    return pairs.statistics(p, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair")))


@query("a20_latest_per_part", "SELECT l_partkey, max(l_shipdate) AS latest, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("latest"), F.count_distinct("l_orderkey").alias("orders"))


@query("a21_cluster_hints", r"""
WITH t AS (SELECT p_brand AS grp, unnest(regexp_extract_all(lower(p_name), '\p{L}+')) AS token FROM part), c AS (SELECT grp, token, count(*) AS n FROM t GROUP BY 1, 2)
SELECT grp, token, n FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, token) <= 3""")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit(r"\p{L}+"), F.lit(0))).alias("token"))
    return ranking.top_per(tokens.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("n")), ["grp"], [F.desc("n"), F.col("token")], 3).drop("rank")


@query("a22_distance_histogram", f"""
WITH q AS (SELECT vec_id AS a, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT 1 - round({COSINE.format("q.e", "v.embedding")}, 6) AS d FROM q, embeddings v WHERE v.vec_id <> a)
SELECT CASE WHEN d < 0 THEN 0 WHEN d >= 2 THEN 21 ELSE floor(d / 0.1)::INT + 1 END AS bucket, count(*) AS n FROM d GROUP BY 1""")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return blocks.distance_histogram(batch_of_vectors(spark, sf), items)


@query("a23_vector_clusters", None)
def a23(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(v)
    small = PCA(k=8, inputCol="unit", outputCol="features").fit(unit).transform(unit)
    return BisectingKMeans(k=10, seed=1).fit(small).transform(small).select("vec_id", F.col("prediction").alias("cluster"))


@query("a28_key_resolution", "SELECT 'l_partkey' AS side, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS unresolved FROM lineitem UNION ALL SELECT 'l_suppkey', count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) FROM lineitem")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    known = {"l_partkey": table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), "l_suppkey": table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))}
    return quality.unresolved(table(spark, sf, "lineitem"), known)


@query("a29_pass_rate", "SELECT lang, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS pending, round(avg(quality), 4) AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    judged = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").withColumn("judged", F.lit(True)), "doc_id", "left")
    return judged.groupBy("lang").agg(F.count_if(F.col("judged").isNull()).alias("pending"), F.round(F.avg("quality"), 4).alias("passed"))


# --- windows, sets, graph --------------------------------------------------------------------------


@query("w3_timeline_groups", """
WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / 86400000000) <= 30 THEN 0 ELSE 1 END AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
n AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS group_no FROM g)
SELECT o_custkey, group_no::BIGINT AS group_no, count(*) AS events, min(o_orderdate) AS first, max(o_orderdate) AS last FROM n GROUP BY 1, 2""")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    grouped = timeline.gap_groups(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return grouped.groupBy("o_custkey", "group_no").agg(F.count(F.lit(1)).alias("events"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("w4_chains", """
SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS next_key, lead(o_orderkey) OVER w IS NOT NULL AS pre_stage FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.chain_links(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "next_key", "pre_stage")


@query("w5_thread_queries", "SELECT conv_id, turn, right(string_agg(text, ' · ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 750) AS query FROM conversations")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.thread_queries(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "query")


@query("w7_latest_version", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("id", F.concat_ws("|", "user_id", "event_type"))
    return entities.latest(e, "id", "ts", F.desc("event_id")).select("user_id", "event_type", "event_id", "ts")


@query("u1_only_later", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    held = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")
    return held.join(o.where("o_orderdate < timestamp '1996-01-01'"), "c_custkey", "left_anti").distinct()


@query("u3_all_key_sets", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT p_partkey FROM part WHERE p_size < 25")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    part_of = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey")
    return part_of("R").intersect(part_of("A")).intersect(table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey")))


@query("u6_parity", """
WITH a AS (SELECT l_orderkey % 50 AS query_id, l_partkey AS key, max(l_tax) AS score FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2), b AS (SELECT l_orderkey % 50 AS query_id, l_partkey AS key, max(l_tax) AS score FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2)
SELECT query_id, key, a.score AS old_score, b.score AS new_score FROM a FULL JOIN b USING (query_id, key) WHERE a.score IS NULL OR b.score IS NULL OR abs(a.score - b.score) > 0.02""")
def u6(spark: SparkSession, sf: str) -> DataFrame:
    snap = lambda k: table(spark, sf, "lineitem").where(F.col("l_linenumber") < k).groupBy((F.col("l_orderkey") % 50).alias("query_id"), F.col("l_partkey").alias("key")).agg(F.max("l_tax").alias("score"))
    return quality.parity(snap(4), snap(5), 0.02)


def star_graph(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return graph.edges([
        (t("nation"), graph.Link("in_region", "nation", "n_nationkey", "region", "n_regionkey")),
        (t("customer"), graph.Link("in_nation", "customer", "c_custkey", "nation", "c_nationkey")),
        (t("supplier"), graph.Link("in_nation", "supplier", "s_suppkey", "nation", "s_nationkey")),
        (t("orders"), graph.Link("ordered", "order", "o_orderkey", "customer", "o_custkey", reverse=True)),
        (t("lineitem"), graph.Link("contains", "order", "l_orderkey", "part", "l_partkey")),
    ])


GRAPH_SQL = """graph AS (
SELECT DISTINCT 'nation_' || n_nationkey AS source, 'region_' || n_regionkey AS target, 'in_region' AS relation FROM nation UNION ALL SELECT DISTINCT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'in_nation' FROM customer UNION ALL
SELECT DISTINCT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT DISTINCT 'customer_' || o_custkey, 'order_' || o_orderkey, 'ordered' FROM orders UNION ALL SELECT DISTINCT 'order_' || l_orderkey, 'part_' || l_partkey, 'contains' FROM lineitem)"""


@query("g1_edges", f"WITH {GRAPH_SQL} SELECT source, target, relation FROM graph")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf)


@query("g2_neighbourhood", f"""
WITH {GRAPH_SQL}, seeds AS (SELECT DISTINCT source AS node FROM graph WHERE relation = 'in_region'),
n AS (SELECT s.node AS seed, target AS node, relation, source, target FROM graph JOIN seeds s ON source = s.node UNION ALL SELECT s.node, source, relation, source, target FROM graph JOIN seeds s ON target = s.node)
SELECT seed, node, relation, source, target FROM n QUALIFY row_number() OVER (PARTITION BY seed, relation ORDER BY node) <= 25""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf)
    return graph.neighbourhood(g.where("relation = 'in_region'").select(F.col("source").alias("node")).distinct(), g)


@query("g3_traversal", f"""
WITH {GRAPH_SQL}, s AS (SELECT 'region_' || r_regionkey AS seed FROM region), a AS (SELECT DISTINCT seed, source AS node FROM s JOIN graph ON target = seed AND relation = 'in_region'),
b AS (SELECT DISTINCT seed, source AS node FROM a JOIN graph g ON g.target = a.node AND relation = 'in_nation'), c AS (SELECT DISTINCT seed, g.target AS node FROM b JOIN graph g ON g.source = b.node AND relation = 'ordered')
SELECT seed, node, 1 AS step, 'in_region' AS relation FROM a UNION ALL SELECT seed, node, 2, 'in_nation' FROM b UNION ALL SELECT seed, node, 3, 'ordered' FROM c""")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "region").select(graph.node_id("region", "r_regionkey").alias("node"))
    return graph.reach(seeds, star_graph(spark, sf), [("in_region", False), ("in_nation", False), ("ordered", True)])


@query("g4_block_siblings", "SELECT a.l_orderkey, a.l_linenumber AS key, b.l_linenumber AS sibling FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND a.l_linenumber // 3 = b.l_linenumber // 3")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").withColumn("number", F.concat_ws(".", F.floor(F.col("l_linenumber") / 3).cast("string"), F.col("l_linenumber").cast("string")))
    return graph.block_siblings(items, "l_orderkey", "number", "l_linenumber").select("l_orderkey", "key", "sibling")


@query("g5_documents_with_all_terms", r"""
WITH q AS (SELECT conv_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations WHERE turn = 0 AND conv_id % 50 = 0),
t AS (SELECT conv_id, list_distinct([x FOR x IN [w[1], w[-1], w[len(w) // 2 + 1]] IF length(x) >= 3]) AS terms FROM q)
SELECT d.doc_id, conv_id FROM documents d, t WHERE len(terms) > 0 AND len([x FOR x IN terms IF NOT contains(lower(d.text), x)]) = 0""")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of a question are its first, middle and last word."""
    q = table(spark, sf, "conversations").where("turn = 0 and conv_id % 50 = 0").select("conv_id", places.words_at("text").alias("w"))
    picked = F.array(F.try_element_at("w", F.lit(1)), F.try_element_at("w", F.lit(-1)), F.try_element_at("w", (F.floor(F.size("w") / 2) + 1).cast("int")))
    asked = q.select(F.col("conv_id").alias("question"), F.explode(F.array_compact(picked)).alias("term"))
    found = graph.holding_all_terms(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), asked)
    return found.select(F.col("doc").alias("doc_id"), F.col("question").alias("conv_id"))


@query("g7_without_types", f"WITH {GRAPH_SQL} SELECT source, target, relation FROM graph WHERE NOT (source LIKE 'nation%' OR target LIKE 'nation%' OR source LIKE 'part%' OR target LIKE 'part%')")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf)
    nodes = g.select(F.col("source").alias("id")).unionByName(g.select(F.col("target").alias("id"))).distinct().withColumn("type", F.split("id", "_").getItem(0))
    return graph.without_types(nodes, g, ["nation", "part"])[1].select("source", "target", "relation")


@query("g9_reverse_lookup", f"WITH {GRAPH_SQL} SELECT source, target, relation FROM graph WHERE target IN (SELECT 'part_' || p_partkey FROM part WHERE p_size = 1)")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "part").where("p_size = 1").select(graph.node_id("part", "p_partkey").alias("node"))
    return graph.referencing(star_graph(spark, sf), wanted).select("source", "target", "relation")


# --- text, pages, JSON -----------------------------------------------------------------------------


@query("t4_t5_normalised_names", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '(?i)\b(?:small|ring)\b', ' ', 'g'), '\s+', ' ', 'g')) AS stripped, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS normal FROM part")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.strip_terms(F.col("p_name"), ["small", "ring"]).alias("stripped"), tx.normalise(F.col("p_name")).alias("normal"))


@query("t20_t21_url_parts", r"SELECT page_id, regexp_replace(regexp_replace(url, '^http:', 'https:'), '//www\.', '//') AS rewritten, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS last FROM pages")
def t20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.rewrite(F.col("url"), [("^http:", "https:"), (r"//www\.", "//")]).alias("rewritten"), tx.last_segment(F.col("url")).alias("last"))


@query("t22_links", r"""SELECT page_id, unnest(regexp_extract_all(replace(html, 'href="/', 'href="https://host.example/'), 'https?://[^\s"''<>]+')) AS link FROM pages""")
def t22(spark: SparkSession, sf: str) -> DataFrame:
    absolute = F.replace(F.col("html"), F.lit('href="/'), F.lit('href="https://host.example/'))
    return table(spark, sf, "pages").select("page_id", F.explode(tx.links_in(absolute)).alias("link"))


@query("t28_teasers", r"""
WITH p AS (SELECT doc_id, text, left(text, 3000) AS summary, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w FROM documents), s AS (SELECT *, [x FOR x IN string_split_regex(summary, '\s+') IF x <> ''] AS sw FROM p)
SELECT doc_id, left(CASE WHEN len(w) <= 200 THEN replace(text, chr(10), ' ') WHEN doc_id % 3 = 0 OR len(sw) < 2 THEN replace(left(text, 16000), chr(10), ' ') WHEN len(sw) > 200 THEN list_aggregate(sw[1:200], 'string_agg', ' ') ELSE summary END, 9600) AS teaser FROM s""")
def t28(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the texts have a summary, their first 3,000 characters."""
    summary = F.when(F.col("doc_id") % 3 > 0, F.left("text", F.lit(3000)))
    return table(spark, sf, "documents").select("doc_id", tx.teaser(F.col("text"), summary).alias("teaser"))


@query("t25_anaphora", r"""
WITH c AS (SELECT conv_id, turn, text, string_split_regex(trim(text), '\s+') AS w FROM conversations)
SELECT conv_id, turn, len([i FOR i IN range(1, len(w) + 1) IF regexp_replace(lower(w[i]), '[,.!?:;]+$', '') IN ('it', 'that', 'this', 'these', 'they', 'de', 'der', 'a', 'en') AND (i = len(w) OR regexp_matches(w[i + 1], '^\p{Ll}'))]) > 0 AS anaphora FROM c""")
def t25(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.has_anaphora(F.col("text"), PROFORMS).alias("anaphora"))


PROFORMS = ["it", "that", "this", "these", "they", "de", "der", "a", "en"]


@query("s11_profile", """
WITH e AS (SELECT event_type AS type, props FROM events WHERE json_valid(props)), t AS (SELECT type, count(*) AS total FROM e GROUP BY 1), k AS (SELECT type, unnest(json_keys(props)) AS field FROM e)
SELECT k.type, field, round(100.0::DOUBLE * count(*) / any_value(total), 1) AS presence_pct, 'BIGINT' AS kinds FROM k JOIN t USING (type) GROUP BY 1, 2""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return entities.profile(table(spark, sf, "events"), "props", F.col("event_type"))


@query("s10_preserved", "SELECT * FROM (SELECT 'lang' AS \"column\", count(lang) AS n_before, count(lang) FILTER (doc_id % 7 <> 0) AS n_after FROM documents UNION ALL SELECT 'source', count(source), count(source) FILTER (doc_id % 7 <> 0) FROM documents) WHERE n_after < n_before")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return quality.preserved(d, d.where("doc_id % 7 <> 0"), ["lang", "source"])


@query("s12_file_references", r"SELECT page_id, lower(regexp_extract(url, '(?i)\.(html?|pdf|php)(?:[?#].*)?$', 1)) AS extension FROM pages WHERE regexp_matches(url, '(?i)\.(html?|pdf|php)(?:[?#].*)?$')")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    return entities.file_references(table(spark, sf, "pages"), "url", ["html?", "pdf", "php"]).select("page_id", "extension")


@query("s18_export", "SELECT o_orderkey AS pair, count(l_orderkey) AS n_documents, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS documents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("text"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("document"), F.col("l_returnflag").alias("role"))
    out = pairs.export(o.select("pair"), lines, o)
    return out.select("pair", "n_documents", F.coalesce(F.array_join(F.transform("documents", lambda x: x["document"].cast("string")), ","), F.lit("")).alias("documents"))


@query("s20_count_gate", "SELECT t AS \"table\", n, least, n >= least AS ok FROM (SELECT 'part' AS t, (SELECT count(*) FROM part) AS n, 100 AS least UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 100000000 UNION ALL SELECT 'absent', 0, 1)")
def s20(spark: SparkSession, sf: str) -> DataFrame:
    floor = spark.createDataFrame([("part", 100), ("orders", 100000000), ("absent", 1)], "table string, least int")
    return quality.count_gate({"part": table(spark, sf, "part"), "orders": table(spark, sf, "orders")}, floor)


# --- enrichment jobs -------------------------------------------------------------------------------


@query("e1_chunks", r"""
WITH RECURSIVE d AS (SELECT doc_id AS doc, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc, generate_subscripts(l, 1) AS i, unnest(l) AS line, len(l) AS lines FROM (SELECT doc, string_split(text, chr(10)) AS l FROM d WHERE length(text) > 8000)),
sized AS (SELECT doc, i, length(line) + CASE WHEN i < lines THEN 1 ELSE 0 END AS n FROM lines WHERE length(line) > 0 OR i < lines),
walk AS (SELECT doc, i, 0 AS s, n AS e FROM sized WHERE i = 1 UNION ALL
  SELECT z.doc, z.i, CASE WHEN k.e > k.s AND k.e - k.s + z.n > 8000 THEN k.e ELSE k.s END, k.e + z.n FROM walk k JOIN sized z ON z.doc = k.doc AND z.i = k.i + 1),
cuts AS (SELECT doc, s, max(e) AS e FROM walk GROUP BY 1, 2)
SELECT d.doc, (row_number() OVER (PARTITION BY d.doc ORDER BY s))::INT AS chunk_index, s AS char_start, e AS char_end, substr(text, s + 1, e - s) AS text FROM cuts c JOIN d ON d.doc = c.doc
UNION ALL SELECT doc, 0, 0, length(text), text FROM d WHERE length(text) <= 8000""")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")))


@query("e1_sections", """
WITH RECURSIVE t AS (SELECT conv_id AS doc, '# ' || turn || chr(10) || text || chr(10) AS block, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
whole AS (SELECT doc, string_agg(block, '' ORDER BY i) AS text FROM t GROUP BY 1),
sized AS (SELECT doc, i, length(block) AS n FROM t JOIN whole USING (doc) WHERE length(text) > 400),
walk AS (SELECT doc, i, 0 AS s, n AS e FROM sized WHERE i = 1 UNION ALL
  SELECT z.doc, z.i, CASE WHEN k.e - k.s >= 300 OR k.e - k.s + z.n > 300 THEN k.e ELSE k.s END, k.e + z.n FROM walk k JOIN sized z ON z.doc = k.doc AND z.i = k.i + 1),
cuts AS (SELECT doc, s, max(e) AS e FROM walk GROUP BY 1, 2)
SELECT w.doc, (row_number() OVER (PARTITION BY w.doc ORDER BY s))::INT AS chunk_index, s AS char_start, e AS char_end, substr(text, s + 1, e - s) AS text FROM cuts JOIN whole w USING (doc)
UNION ALL SELECT doc, 0, 0, length(text), text FROM whole WHERE length(text) <= 400""")
def e1_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Threads as texts with a heading before each turn; no turn is over the hard limit here."""
    turn = F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n"))
    threads = chunks.whole_texts(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk_index"), turn.alias("text")))
    return chunks.chunk(threads, target=300, hard=100_000, whole=400)


@query("e1_chunks_join_up", "SELECT doc_id AS doc, length(text) AS chars, true AS same FROM documents")
def e1_whole(spark: SparkSession, sf: str) -> DataFrame:
    whole = chunks.whole_texts(e1(spark, sf)).withColumnRenamed("text", "again")
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "doc").join(whole, "doc").select("doc", F.length("text").alias("chars"), (F.col("text") == F.col("again")).alias("same"))


@query("e4_reconcile", "WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN b.text = a.text THEN 'identical' ELSE 'fixed' END AS status FROM documents a LEFT JOIN b USING (doc_id)) GROUP BY 1")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    fresh = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return quality.reconcile(d, fresh, "doc_id", "text").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("t31_precedence", f"WITH {TAGS_SQL} SELECT item, scheme, tag, source, coalesce(confidence, CASE source WHEN 'manual' THEN 1.0 WHEN 'rule' THEN 0.9 ELSE 0.6 END) AS confidence FROM tags QUALIFY row_number() OVER (PARTITION BY item, scheme ORDER BY CASE source WHEN 'manual' THEN 0 WHEN 'rule' THEN 1 ELSE 2 END, tag) = 1")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return tags.by_precedence(tag_rows(spark, sf), {"manual": 1.0, "rule": 0.9, "model": 0.6})


@query("e7_category_cascade", """
SELECT doc_id AS item, CASE WHEN source = 'src0' THEN 'minutes' WHEN lang = 'de' THEN 'report' WHEN quality IS NOT NULL THEN 'q' || quality END AS category, CASE WHEN source = 'src0' THEN 0 WHEN lang = 'de' THEN 1 WHEN quality IS NOT NULL THEN 2 END AS stage FROM documents LEFT JOIN labels USING (doc_id)""")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "item")
    stages = [d.select("item", tx.first_match(F.col("source"), [("^src0$", "minutes")]).alias("category")), d.select("item", F.when(F.col("lang") == "de", "report").alias("category")), table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.concat(F.lit("q"), "quality").alias("category"))]
    return tags.cascade(d, stages)


@query("e11_e12_places", "WITH l AS (SELECT c_custkey AS item, n_name AS place, CASE WHEN c_acctbal < 0 THEN 'boilerplate' WHEN c_custkey % 3 = 0 THEN 'content' ELSE 'unsure' END AS gate_status FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT place, count(DISTINCT item) AS n, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS items FROM l WHERE gate_status <> 'boilerplate' GROUP BY 1")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("item"), F.col("n_name").alias("place"), "c_acctbal")
    verdicts = c.where("item % 3 = 0").select("item", "place", F.lit("content").alias("verdict"))
    gated = places.gate(c, verdicts, F.col("c_acctbal") < 0)
    return places.per_place(gated.where(filters.not_boilerplate(F.col("gate_status"))))


@query("e13_t15_pairs", """
WITH c AS (SELECT *, o_orderstatus <> 'O' AS heard, o_custkey % 3 > 0 AND o_orderkey % 4 = 0 AS decisive FROM orders)
SELECT o_orderkey AS paper, t.request_type, CASE WHEN t.request_type IS NOT NULL AND o_orderstatus = 'F' THEN 'finished' END AS outcome, CASE WHEN t.request_type IS NULL THEN 0.0 ELSE round(0.5 + CASE WHEN heard THEN 0.2 ELSE 0 END + CASE WHEN decisive THEN 0.2 ELSE 0 END + CASE WHEN heard AND decisive THEN 0.1 ELSE 0 END, 2) END::DOUBLE AS confidence,
  CASE WHEN t.request_type IS NULL THEN 'column' WHEN heard AND decisive THEN 'db-column' ELSE 'db-partial' END AS signal
FROM c, LATERAL (SELECT CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderpriority LIKE '%-HIGH%' OR o_orderpriority LIKE '%-LOW%' THEN 'plain' END AS request_type) t""")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    """Papers (orders) whose result is known unless their status is O; every fourth one is authoritative, two thirds have a role."""
    o = table(spark, sf, "orders")
    result = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("status "), "o_orderstatus"))
    role = F.when(F.col("o_custkey") % 3 == 1, "decides").when(F.col("o_custkey") % 3 == 2, "hears").when(F.col("o_custkey") % 2 == 0, "")
    found = pairs.classify(F.col("o_orderpriority"), result, role, F.col("o_orderkey") % 4 == 0, [("urgent", "urgent"), ("high|low$", "plain")], [(r"\bF$", "finished")])
    return o.select(F.col("o_orderkey").alias("paper"), found.alias("x")).select("paper", "x.*")


@query("e14_merge_keep", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, coalesce(b.w, a.w) AS w FROM (SELECT c_custkey AS k, c_name AS v, c_acctbal AS w FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS v, CASE WHEN c_custkey % 5 = 0 THEN 0.0 END AS w FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k")
def e14(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.col("c_acctbal").alias("w"))
    new = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("v"), F.when(F.col("c_custkey") % 5 == 0, F.lit(0.0)).alias("w"))
    return pairs.merge_keep(old, new, "k")


@query("e15_v1_signal_priority", "SELECT l_orderkey AS pair, l_linestatus AS outcome, l_returnflag AS signal, l_tax AS confidence FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, -l_tax, l_linestatus) = 1")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linestatus").alias("outcome"), F.col("l_returnflag").alias("signal"), F.col("l_tax").alias("confidence"))
    return pairs.by_signal(rows, ["R", "A"])


# --- increments ------------------------------------------------------------------------------------


@query("x3_classified", """
WITH k AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_id % 2 = 0 GROUP BY 1), i AS (SELECT user_id, max(ts) AS modified FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT i.user_id, modified, CASE WHEN k.user_id IS NULL THEN 'new' WHEN modified > seen THEN 'modified' ELSE 'skipped' END AS status FROM i LEFT JOIN k USING (user_id)""")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda k: table(spark, sf, "events").where(F.col("event_id") % k == 0).groupBy("user_id").agg(F.max("ts").alias("modified"))
    return incremental.classify(side(3), side(2), key="user_id").select("user_id", "modified", "status")


@query("x7_run_counts", "SELECT event_type AS type, user_id % 10 AS run, count(DISTINCT user_id) FILTER (event_type <> 'view') AS new, count(DISTINCT user_id) FILTER (event_type = 'view') AS modified FROM events GROUP BY 1, 2")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("type"), F.concat_ws("|", "event_type", "user_id").alias("id"), F.when(F.col("event_type") == "view", "modified").otherwise("new").alias("status"))
    return incremental.run_counts(rows)


@query("x8_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.sessions(table(spark, sf, "events"), "user_id", "ts", gap="6 hours")


@query("x11_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "1 day")
