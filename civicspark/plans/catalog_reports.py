"""Registered queries of reports, exports, place answers and wide traversals, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import graph, pairs, places, quality, timeline
from civicspark.plans.catalog import GRAPH_SQL, TRIGRAMS, query, star_graph
from civicspark.sources import entities
from civicspark.sources.tables import table

PAIR_DOCUMENTS = """
p AS (SELECT o_orderkey AS pair, o_orderstatus AS outcome, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS request_type, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'request' ELSE 'modification' END AS role FROM orders),
e AS (SELECT pair, l_partkey AS document, role, 0 AS strength FROM p JOIN lineitem ON l_orderkey = pair WHERE l_linenumber <= 4 UNION ALL
      SELECT pair, l_partkey, 'response', 1 FROM p JOIN lineitem ON l_orderkey = pair WHERE outcome <> 'O' AND l_returnflag = 'A'),
d AS (SELECT pair, document, arg_max(role, strength) AS role, coalesce(any_value(p_size) FILTER (p_size > 3), 0)::BIGINT AS chunks FROM e LEFT JOIN part ON p_partkey = document GROUP BY 1, 2)"""


def order_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pairs: an order is a paper, and an agenda item unless it is open."""
    low, key = F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("pair"), key.alias("paper"), F.when(F.col("o_orderstatus") != "O", key).alias("agenda_item"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_request"), F.col("o_orderstatus").alias("outcome"), F.when(low, F.col("o_orderpriority")).alias("request_type"),
    )


@query("e13_pair_documents", f"WITH {PAIR_DOCUMENTS} SELECT pair, document, role, chunks FROM d")
def pair_documents(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    own = lines.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("document"))
    heard = lines.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("agenda_item"), F.col("l_partkey").alias("document"))
    chunks = table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("document"), F.col("p_size").alias("chunks"))
    return pairs.pair_documents(order_pairs(spark, sf), own, heard, chunks)


@query("a17_pair_report", f"""
WITH {PAIR_DOCUMENTS}, k AS (SELECT pair, count(*) AS k, bool_or(role = 'modification') AS modified FROM d GROUP BY 1)
SELECT 'pairs' AS measure, 'all' AS value, count(*) AS n FROM p UNION ALL SELECT 'role', role, count(*) FROM d GROUP BY 2 UNION ALL
SELECT 'documents', CASE WHEN k <= 5 THEN '<=5' ELSE '>5' END, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM p GROUP BY 2 UNION ALL
SELECT 'request_type', coalesce(request_type, '(none)'), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'modified', 'all', count(*) FILTER (modified) FROM k UNION ALL
SELECT 'chunks', CASE WHEN chunks <= 5 THEN '<=5' ELSE '>5' END, count(*) FROM d GROUP BY 2""")
def pair_report(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_report(order_pairs(spark, sf), pair_documents(spark, sf))


@query("s18_export_counts", """
WITH o AS (SELECT o_orderkey AS pair, o_orderpriority <> '5-LOW' AS said, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_totalprice > 150000 THEN 'passed' ELSE 'failed' END END AS verdict FROM orders)
SELECT count(*) AS pairs, count(*) FILTER (said) AS with_statements, count(*) FILTER (verdict = 'passed') AS passed, count(*) FILTER (verdict = 'failed') AS failed FROM o""")
def export_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "pair")
    said = o.where("o_orderpriority <> '5-LOW'").select("pair", F.lit("request").alias("stage"), F.col("o_orderpriority").alias("text"))
    verdict = F.when(F.col("o_totalprice") > 150000, "passed").otherwise("failed")
    checks = o.where("pair % 3 = 0").select("pair", verdict.alias("verdict"), F.col("o_orderstatus").alias("reason"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("document"), F.col("l_returnflag").alias("role"))
    return pairs.export_counts(pairs.export(o.select("pair"), lines, said, checks))


@query("v1_signal_function", "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority, count(*) AS n FROM lineitem GROUP BY 1, 2")
def signal_function(spark: SparkSession, sf: str) -> DataFrame:
    pairs.register_signal_priority(spark, ["R", "A"])
    return table(spark, sf, "lineitem").groupBy("l_returnflag", F.expr("signal_priority(l_returnflag)").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("a27_answer_counts", """
WITH e AS (SELECT user_id AS query_id, event_type, value FROM events), t AS (SELECT query_id, event_type, count(*) AS n FROM e GROUP BY 1, 2)
SELECT query_id, 'files' AS measure, count(DISTINCT floor(value)) AS n FROM e GROUP BY 1 UNION ALL SELECT query_id, 'events', sum(n)::BIGINT FROM t GROUP BY 1 UNION ALL SELECT query_id, 'events of ' || event_type, n FROM t""")
def answer_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("user_id", "query_id")
    return timeline.answer_counts(e.select("query_id", F.floor("value").alias("file")), e.select("query_id", F.col("event_type").alias("type")))


@query("a28_resolution_report", """
WITH l AS (SELECT p_partkey AS p, p_size > 40 AS p_gone, s_suppkey AS s, s_acctbal < 0 AS s_gone FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey > 3) ON l_suppkey = s_suppkey)
SELECT 'l_partkey unresolved' AS finding, count(*) FILTER (p IS NULL) AS n FROM l UNION ALL SELECT 'l_partkey deleted', count(*) FILTER (p_gone) FROM l UNION ALL SELECT 'l_suppkey unresolved', count(*) FILTER (s IS NULL) FROM l UNION ALL
SELECT 'l_suppkey deleted', count(*) FILTER (s_gone) FROM l UNION ALL SELECT 'resolved', count(*) FILTER (NOT p_gone AND NOT s_gone) FROM l""")
def resolution_report(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 40).alias("deleted"))
    supplier = table(spark, sf, "supplier").where("s_nationkey > 3").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("deleted"))
    return quality.resolution_report(table(spark, sf, "lineitem"), {"l_partkey": part, "l_suppkey": supplier})


@query("e27_content_integrity", """
WITH c AS (SELECT doc_id AS doc, 0 AS chunk_index, CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 7 > 0), v AS (SELECT doc_id AS doc, toxic AS chunk_index FROM labels)
SELECT 'vectors without chunk' AS finding, count(*) AS n FROM v WHERE doc IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc = v.doc AND c.chunk_index = v.chunk_index) UNION ALL
SELECT 'files with vectors but no chunk', count(DISTINCT doc) FROM v WHERE doc NOT IN (SELECT doc FROM c) UNION ALL
SELECT 'texts differ', count(*) FILTER (d.text <> c.text) FROM documents d JOIN c ON doc = doc_id UNION ALL SELECT 'texts compared', count(*) FROM documents d JOIN c ON doc = doc_id""")
def content_integrity(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    text = F.when(F.col("doc") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    chunks = files.where("doc % 7 > 0").select("doc", F.lit(0).alias("chunk_index"), text.alias("text"))
    return quality.content_integrity(files, chunks, table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("toxic").alias("chunk_index")))


STEPS = [
    ("seed", "contains", False, "order"), ("order", "contains", True, "part"), ("order", "ordered", False, "customer"),
    ("customer", "in_nation", True, "nation"), ("nation", "in_region", True, "region"), ("customer", "ordered", True, "other_order"),
    ("other_order", "contains", True, "part"), ("region", "in_region", False, "neighbour"), ("neighbour", "in_region", True, "region"),
]
RELATED = f"""
WITH {GRAPH_SQL}, seed AS (SELECT 'part_' || p_partkey AS seed, 'part_' || p_partkey AS node FROM part WHERE p_partkey % 50 = 0),
u1 AS (SELECT seed, relation, source, target FROM seed JOIN graph ON target = node AND relation = 'contains'), ord AS (SELECT DISTINCT seed, source AS node FROM u1),
u2 AS (SELECT seed, relation, source, target FROM ord JOIN graph ON source = node AND relation = 'contains'),
u3 AS (SELECT seed, relation, source, target FROM ord JOIN graph ON target = node AND relation = 'ordered'), cust AS (SELECT DISTINCT seed, source AS node FROM u3),
u4 AS (SELECT seed, relation, source, target FROM cust JOIN graph ON source = node AND relation = 'in_nation'), nat AS (SELECT DISTINCT seed, target AS node FROM u4),
u5 AS (SELECT seed, relation, source, target FROM nat JOIN graph ON source = node AND relation = 'in_region'), reg AS (SELECT DISTINCT seed, target AS node FROM u5),
u6 AS (SELECT seed, relation, source, target FROM cust JOIN graph ON source = node AND relation = 'ordered'), other AS (SELECT DISTINCT seed, target AS node FROM u6),
u7 AS (SELECT seed, relation, source, target FROM other JOIN graph ON source = node AND relation = 'contains'),
u8 AS (SELECT seed, relation, source, target FROM reg JOIN graph ON target = node AND relation = 'in_region'), near AS (SELECT DISTINCT seed, source AS node FROM u8),
u9 AS (SELECT seed, relation, source, target FROM near JOIN graph ON source = node AND relation = 'in_region')"""


def related(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seeds = table(spark, sf, "part").where("p_partkey % 50 = 0").select(graph.node_id("part", "p_partkey").alias("node"))
    return graph.related_objects(seeds, star_graph(spark, sf), STEPS)


@query("g3_nine_steps", f"""{RELATED}
SELECT seed, 'order' AS kind, node FROM ord UNION ALL SELECT DISTINCT seed, 'part', target FROM (FROM u2 UNION ALL FROM u7) UNION ALL SELECT seed, 'customer', node FROM cust UNION ALL SELECT seed, 'nation', node FROM nat UNION ALL
SELECT DISTINCT seed, 'region', target FROM (FROM u5 UNION ALL FROM u9) UNION ALL SELECT seed, 'other_order', node FROM other UNION ALL SELECT seed, 'neighbour', node FROM near""")
def nine_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What the batch of parts is related to, set by set."""
    return related(spark, sf)[0]


@query("g3_edge_log", RELATED + "\nSELECT seed, relation, source, target, min(step) AS step FROM (" + " UNION ALL ".join(f"SELECT *, {i} AS step FROM u{i}" for i in range(1, 10)) + ") GROUP BY 1, 2, 3, 4")
def edge_log(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that the nine steps used."""
    return related(spark, sf)[1]


@query("g5_expanded_answers", """
WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber // 3 AS block, p_name AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT DISTINCT o_orderkey AS query_id, l_orderkey, l_linenumber, string_split(p_name, ' ') AS terms FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 3 = 1)
SELECT DISTINCT a.query_id, a.l_orderkey, s.l_linenumber FROM a JOIN i s ON s.l_orderkey = a.l_orderkey AND s.block = a.l_linenumber // 3 AND s.l_linenumber <> a.l_linenumber
WHERE len([t FOR t IN a.terms IF length(t) >= 3 AND NOT contains(lower(s.text), lower(t))]) = 0 AND NOT EXISTS (SELECT 1 FROM a b WHERE b.query_id = a.query_id AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = s.l_linenumber)""")
def expanded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order that share a block with a found one and hold all words of its part's name."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_name").alias("text"))
    items = lines.withColumn("number", F.concat_ws(".", F.floor(F.col("l_linenumber") / 3).cast("string"), F.col("l_linenumber").cast("string")))
    found = lines.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").where("l_linenumber % 3 = 1")
    answers = found.select(F.col("l_orderkey").alias("query_id"), "l_orderkey", "l_linenumber", F.split("text", " ").alias("terms"))
    return graph.expanded_answers(answers, items, "l_orderkey", "number", "l_linenumber", "text")


LINKED = f"""
WITH q AS (SELECT s_suppkey AS query_id, p_name AS query FROM supplier JOIN part ON p_partkey = s_suppkey),
l AS (SELECT DISTINCT query_id, query, l_partkey AS key FROM lineitem JOIN q ON query_id = l_suppkey WHERE l_returnflag <> 'R'),
n AS (SELECT query_id, key, p_size, {TRIGRAMS.format("query")} AS a, {TRIGRAMS.format("p_name")} AS b FROM l JOIN part ON p_partkey = key),
s AS (SELECT query_id, key, p_size, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS sim FROM n)"""


def place_links(spark: SparkSession, sf: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Links of suppliers as places, and the queries (the name of the part of that number) that were resolved to them."""
    asked = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("query"))
    status = F.when(F.col("l_returnflag") == "R", "boilerplate").when(F.col("l_returnflag") == "A", "content")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias(key), status.alias("gate_status")), asked


@query("r14_linked_files", f"""{LINKED},
m AS (SELECT l_partkey AS key, max(l_shipdate)::DATE AS day FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
d AS (SELECT query_id, key AS file, sim, coalesce(day, CASE WHEN p_size > 9 THEN DATE '1990-01-01' + p_size END) AS day FROM s LEFT JOIN m USING (key))
SELECT query_id, file, sim, day, row_number() OVER (PARTITION BY query_id ORDER BY day DESC NULLS LAST, file) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM d QUALIFY place <= 20""")
def linked_files(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("p_size") > 9, F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_size")).cast("timestamp"))
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("name"), own.alias("date"))
    meetings = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("file"), F.col("l_shipdate").cast("timestamp").alias("start"))
    return places.linked_files(*place_links(spark, sf, "file"), files, meetings, 20)


@query("r14_linked_items", f"{LINKED} SELECT query_id, key AS item, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, key) AS place FROM s QUALIFY place <= 50")
def linked_items(spark: SparkSession, sf: str) -> DataFrame:
    return places.linked_items(*place_links(spark, sf, "item"), table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name")))


@query("s11_profile_samples", """
WITH v AS (SELECT DISTINCT event_type AS type, props->>'k' AS value FROM events WHERE json_valid(props) AND props->>'k' IS NOT NULL), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY type ORDER BY value) <= 3)
SELECT type, 'k' AS field, string_agg(value, ',' ORDER BY value) AS samples FROM f GROUP BY 1""")
def profile_samples(spark: SparkSession, sf: str) -> DataFrame:
    return entities.profile_samples(table(spark, sf, "events"), "props", F.col("event_type")).select("type", "field", F.array_join("samples", ",").alias("samples"))


@query("s15_gazetteer", "SELECT n.name, s.size FROM (SELECT DISTINCT p_name AS name FROM part) n LEFT JOIN (SELECT p_name AS name, min(p_size) AS size FROM part WHERE p_partkey % 3 > 0 GROUP BY 1) s USING (name) WHERE n.name NOT IN (SELECT p_name FROM part WHERE p_size = 7)")
def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_name", "name")
    shapes = part.where("p_partkey % 3 > 0").groupBy("name").agg(F.min("p_size").alias("size"))
    return entities.gazetteer(part.select("name").distinct(), shapes, part.where("p_size = 7"))


@query("s21_mandate_holders", "SELECT name, party, role FROM (SELECT c_name AS name, n_name AS party, c_mktsegment AS role FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 > 0) ON n_nationkey = c_nationkey UNION ALL SELECT s_name, n_name, 'BUILDING' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT s_name, 'independent', 'machinery' FROM supplier) WHERE party IS NOT NULL AND regexp_matches(lower(role), 'build|machin') QUALIFY row_number() OVER (PARTITION BY name ORDER BY party, role) = 1")
def mandate_holders(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("party"))
    supplier = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_nationkey")
    members = table(spark, sf, "customer").join(nations.where("n_nationkey % 5 > 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_name").alias("name"), "party", F.col("c_mktsegment").alias("role"))
    seats = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("name", "party", F.lit("BUILDING").alias("role"))
    return entities.mandate_holders(members.unionByName(seats).unionByName(supplier.select("name", F.lit("independent").alias("party"), F.lit("machinery").alias("role"))), ["build", "machin"])
