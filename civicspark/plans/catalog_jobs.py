"""Registered queries of the resolving operators and of the jobs, over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import chunks, graph, jobs, places, resolve, timeline
from civicspark.plans.catalog import CLUSTERS_SQL, COSINE, LETTERS, TAGS_SQL, batch_of_vectors, heaviest_words, query, tag_rows
from civicspark.plans.catalog_text import BALLOT, SIDES
from civicspark.sources.tables import cut, table, tasks_for

DISTANCES = f"""
q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id AS key, round(1 - {COSINE.format("a", "embedding")}, 6) + 0.0::DOUBLE AS distance FROM q, embeddings)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query("r4_top_then_threshold", f"""
WITH {DISTANCES}, t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, key) <= 10)
SELECT query_id, key, distance FROM t WHERE distance <= 0.7""")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.top_then_threshold(batch_of_vectors(spark, sf), vectors(spark, sf), most_distance=0.7)


@query("r5_similar_items", f"""
WITH {DISTANCES}
SELECT query_id, key, round(1 - distance, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM d WHERE distance < 1 - 0.4::DOUBLE QUALIFY rank <= 5""")
def r5(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.similar_items(batch_of_vectors(spark, sf), vectors(spark, sf))


@query("r13_committees", r"""
WITH org AS (SELECT s_name || ' ' || p AS name, CASE WHEN s_acctbal < 0 THEN DATE '2020-01-01' WHEN s_acctbal > 5000 THEN DATE '2030-01-01' END AS end_date FROM supplier, (VALUES ('Board'), ('Council')) t(p)),
terms AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN lower(s_name) || ' board' WHEN 1 THEN upper(s_name) WHEN 2 THEN 'nothing ' || s_suppkey ELSE s_name || '  council' END AS term FROM supplier),
groups AS (SELECT s_suppkey // 10 AS place, s_name || ' Board' AS name FROM supplier WHERE s_suppkey % 10 < 3),
asked AS (SELECT query_id, lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) AS term FROM terms),
g AS (SELECT term, min(place) AS place FROM asked JOIN groups ON contains(lower(groups.name), term) GROUP BY 1),
zero AS (SELECT DISTINCT g.term, groups.name, 0 AS tier FROM g JOIN groups USING (place) JOIN org ON org.name = groups.name WHERE end_date IS NULL OR end_date >= DATE '2026-01-01'),
one AS (SELECT DISTINCT term, name, 1 AS tier FROM asked JOIN org ON lower(name) = term WHERE term NOT IN (SELECT term FROM g)),
two AS (SELECT term, name, 2 AS tier FROM (SELECT DISTINCT term, name FROM asked JOIN org ON contains(lower(name), term) WHERE term NOT IN (SELECT term FROM g) AND term NOT IN (SELECT term FROM one)) QUALIFY row_number() OVER (PARTITION BY term ORDER BY name) <= 10)
SELECT query_id, name, tier FROM asked JOIN (SELECT * FROM zero UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) USING (term)""")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier has a board and a council; boards of some are configured groups."""
    s = table(spark, sf, "supplier")
    end = F.when(F.col("s_acctbal") < 0, "2020-01-01").when(F.col("s_acctbal") > 5000, "2030-01-01").cast("date")
    organizations = s.select(F.explode(F.array(*(F.concat("s_name", F.lit(f" {p}")) for p in ("Board", "Council")))).alias("name"), end.alias("end_date"))
    kind = F.col("s_suppkey") % 4
    term = F.when(kind == 0, F.concat(F.lower("s_name"), F.lit(" board"))).when(kind == 1, F.upper("s_name")).when(kind == 2, F.concat(F.lit("nothing "), F.col("s_suppkey").cast("string"))).otherwise(F.concat("s_name", F.lit("  council")))
    groups = s.where("s_suppkey % 10 < 3").select(F.expr("s_suppkey div 10").alias("place"), F.concat("s_name", F.lit(" Board")).alias("name"))
    return resolve.committees(s.select(F.col("s_suppkey").alias("query_id"), term.alias("term")), groups, organizations, F.lit("2026-01-01").cast("date"))


@query("e25_slot_vocabulary", r"""
WITH v AS (SELECT 'kind' AS slot, 'Report' AS value, 0 AS source, '0' AS pos UNION ALL SELECT 'kind', ' economy  brass', 0, '1' UNION ALL
SELECT 'kind', p_type, 1, p_type FROM part WHERE regexp_matches(p_type, '^[A-M]') UNION ALL SELECT 'brand', p_brand, 1, p_brand FROM part UNION ALL SELECT 'brand', n_name, 2, n_name FROM nation),
n AS (SELECT slot, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS value, min((source, pos)) AS seen FROM v GROUP BY 1, 2)
SELECT slot, value, row_number() OVER (PARTITION BY slot ORDER BY seen, value) AS place FROM n""")
def e25(spark: SparkSession, sf: str) -> DataFrame:
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    fixed = spark.createDataFrame([("kind", "Report", "0"), ("kind", " economy  brass", "1")], "slot string, value string, at string")
    of = lambda df, slot, c: df.select(F.lit(slot).alias("slot"), F.col(c).alias("value"), F.col(c).alias("at")).distinct()
    stored = of(part.where(F.col("p_type").rlike("^[A-M]")), "kind", "p_type").unionByName(of(part, "brand", "p_brand"))
    return resolve.slot_vocabulary([fixed, stored, of(nation, "brand", "n_name")])


@query("u2_left_out_of_answers", """
WITH answer AS (SELECT l_orderkey AS query_id, l_partkey AS key FROM lineitem GROUP BY 1, 2), gone AS (SELECT p_partkey AS key FROM part WHERE p_size < 5),
n AS (SELECT query_id, count(*) AS dropped FROM answer WHERE key IN (SELECT key FROM gone) GROUP BY 1)
SELECT query_id, count(*) FILTER (key NOT IN (SELECT key FROM gone)) AS kept, coalesce(max(dropped), 0) AS dropped FROM answer LEFT JOIN n USING (query_id) GROUP BY 1""")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    answer = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("key")).distinct()
    kept, dropped = resolve.left_out(answer, table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").alias("key")))
    counted = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept")).join(dropped, "query_id", "full")
    return counted.select("query_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


@query("e16_escalated_outcomes", """
WITH t AS (SELECT l_orderkey AS paper, string_agg(CASE l_returnflag WHEN 'A' THEN 'was Accepted today' WHEN 'R' THEN 'is to be rejected' ELSE 'talk' END, ' ' ORDER BY l_linenumber) AS text FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS paper, CASE WHEN o_orderstatus = 'F' THEN 'known' END AS outcome FROM orders),
j AS (SELECT p.*, CASE WHEN regexp_matches(text, '(?i)\\breject') THEN 'rejected' WHEN regexp_matches(text, '(?i)accepted|agreed') THEN 'accepted' END AS told FROM p LEFT JOIN t USING (paper))
SELECT paper, coalesce(outcome, told) AS outcome, CASE WHEN outcome IS NULL AND told IS NOT NULL THEN 'wording' END AS signal, CASE WHEN outcome IS NULL AND told IS NOT NULL THEN 0.6::DOUBLE END AS confidence FROM j""")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("l_returnflag") == "A", "was Accepted today").when(F.col("l_returnflag") == "R", "is to be rejected").otherwise("talk")
    texts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("at"), said.alias("text"))
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper"), F.when(F.col("o_orderstatus") == "F", "known").alias("outcome"))
    return jobs.escalated(pairs, texts, [("rejected", [r"\breject"]), ("accepted", ["accepted", "agreed"])])


@query("e18_protocols", """
WITH p AS (SELECT o_orderkey AS pair, o_orderkey % 9 + 1 AS number, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' END AS outcome FROM orders),
c AS (SELECT l_orderkey AS pair, l_linenumber AS document, max((l_partkey % 9 + 1)::BIGINT) AS item, max(CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' END) AS found, max(l_suppkey % 3) AS kind FROM lineitem GROUP BY 1, 2),
j AS (SELECT p.*, document, found, item = number AS top, kind < 2 AS session FROM c JOIN p USING (pair)),
f AS (SELECT pair, min(document) AS by_doc, min_by(found, document) AS derived FROM j WHERE outcome IS NULL AND top AND found IS NOT NULL GROUP BY 1)
SELECT pair, document, coalesce(outcome, derived) AS outcome, f.pair IS NOT NULL AS is_derived FROM j LEFT JOIN f USING (pair)
WHERE top AND session AND found = CASE WHEN outcome IS NOT NULL THEN outcome WHEN document > by_doc THEN derived END""")
def e18(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    tasks = tasks_for(lines)
    o = orders.select(F.col("o_orderkey").alias("pair"), (F.col("o_orderkey") % 9 + 1).cast("string").alias("number"), F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").alias("outcome"))
    found = F.max(F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected"))
    dealt = lines.select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("document"), "l_partkey", "l_suppkey", "l_returnflag").repartition(tasks, "pair")
    rows = dealt.groupBy("pair", "document").agg(F.max(F.col("l_partkey") % 9 + 1).alias("item"), found.alias("found"), F.max(F.col("l_suppkey") % 3).alias("kind"))
    dated = rows.join(o.select("pair", "day").repartition(tasks, "pair"), "pair")
    word = F.when(F.col("found") == "accepted", "the motion was ACCEPTED").when(F.col("found") == "rejected", "it is rejected").otherwise("adjourned")
    text = F.concat(F.lit("Minutes of "), F.when(F.col("kind") == 0, F.date_format("day", "dd. MM. yyyy")).otherwise("a day"), F.lit("\nTOP "), F.col("item").cast("string"), F.lit("\nDecision: "), word)
    candidates = dated.select("pair", "document", F.when(F.col("kind") == 1, "Minutes GR").otherwise("Minutes").alias("name"), text.alias("text"))
    known = jobs.attached_protocols(o, candidates, [("accepted", "accepted"), ("rejected", "rejected")], r"(?s)Decision:(.{0,400})", r"(?i)\bTOP\s*(\d+(?:\.\d+)?)", tasks=tasks)
    return known.where("attached").select("pair", "document", F.coalesce("outcome", "derived").alias("outcome"), F.col("derived").isNotNull().alias("is_derived"))


@query("e19_ballots", """
WITH p AS (SELECT o_orderkey AS pair, o_orderkey % 9 + 1 AS number, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' END AS outcome FROM orders),
c AS (SELECT l_orderkey AS pair, l_linenumber AS document, max((l_partkey % 9 + 1)::BIGINT) AS item, max(l_quantity)::INT AS yes, max(l_suppkey % 5)::BIGINT AS kind FROM lineitem GROUP BY 1, 2)
SELECT pair, document, yes, 20 AS no, CASE WHEN outcome IS NULL OR yes = 20 THEN 'n/a' WHEN outcome = CASE WHEN yes > 20 THEN 'accepted' ELSE 'rejected' END THEN 'ok' ELSE 'warn' END AS verdict FROM c JOIN p USING (pair) WHERE item = number AND kind < 4""")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of a document's session signal: its own date, the day in its text in ISO, in its name, with a short month; or another day."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair"), (F.col("o_orderkey") % 9 + 1).cast("string").alias("number"), F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").alias("outcome"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("document")).agg(F.max(F.col("l_partkey") % 9 + 1).alias("item"), F.max("l_quantity").cast("int").alias("yes"), F.max(F.col("l_suppkey") % 5).alias("kind")).join(o.select("pair", "day"), "pair")
    item, is_ = F.concat(F.lit("TOP 0"), F.col("item").cast("string")), lambda k: F.col("kind") == k
    # every second name says the item, every third another one
    said = F.when(F.col("document") % 2 == 0, item).when(F.col("document") % 3 == 0, "TOP 77").otherwise("")
    name = F.concat(F.lit("Ballot "), said, F.when(is_(2), F.concat(F.lit(" "), F.date_format("day", "dd.MM.yyyy"))).otherwise(""))
    day = F.when(is_(1), F.date_format("day", "yyyy-MM-dd")).when(is_(3), F.concat_ws(" ", F.dayofmonth("day").cast("string"), F.upper(F.date_format("day", "MMM")), F.year("day").cast("string"))).otherwise("no day")
    text = F.concat(day, F.lit("\n"), item, F.lit("\nJa: "), F.col("yes").cast("string"), F.lit("\nNein: 20"))
    candidates = rows.select("pair", "document", name.alias("name"), text.alias("text"), F.when(is_(0), F.col("day")).when(is_(4), F.date_add("day", 1)).alias("date"))
    return jobs.ballot_documents(o, candidates, lambda t: (tx.count_after(t, "Ja", BALLOT), tx.count_after(t, "Nein", BALLOT)), SIDES)


@query("e20_authors", """
WITH t AS (SELECT l_orderkey, l_linenumber, max(l_returnflag || l_linestatus || ';') AS text FROM lineitem GROUP BY 1, 2),
h AS (SELECT l_orderkey AS paper, string_agg(left(text, 4000), '' ORDER BY l_linenumber) AS head FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3) GROUP BY 1),
c AS (SELECT o_orderkey AS paper, o_orderdate::DATE AS day, o_orderpriority || coalesce(head, '') AS corpus FROM orders LEFT JOIN h ON h.paper = o_orderkey)
SELECT paper, CASE WHEN regexp_matches(corpus, '(?i)urgent') AND day <= DATE '1995-12-31' THEN 'old' WHEN regexp_matches(corpus, '(?i)urgent') AND day >= DATE '1996-01-01' THEN 'new' WHEN regexp_matches(corpus, '(?i)RF;AF') THEN 'mixed' WHEN regexp_matches(corpus, '(?i)low') THEN 'calm' END AS author FROM c""")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    papers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").alias("day"))
    pieces = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("chunk_index")).agg(F.max(F.concat("l_returnflag", "l_linestatus", F.lit(";"))).alias("text"))
    rules = [("(?i)urgent", "old", [(None, "1995-12-31")]), ("(?i)urgent", "new", [("1996-01-01", None)]), ("(?i)RF;AF", "mixed", None), ("(?i)low", "calm", None)]
    return jobs.authors(papers, pieces, rules)


@query("s19_migration", """
WITH k AS (SELECT key, row_number() OVER (ORDER BY substr(md5(key), 1, 2), key) AS sid FROM (SELECT DISTINCT 'user/' || user_id AS key FROM events WHERE user_id % 7 > 0)),
r AS (SELECT event_id, 'user/' || user_id AS key, CASE WHEN event_id % 50 = 0 THEN '{broken' ELSE props END AS props FROM events)
SELECT 'resolved' AS part, sid::VARCHAR AS key, count(*) AS n FROM r JOIN k USING (key) WHERE props <> '{broken' OR props IS NULL GROUP BY 2 UNION ALL
SELECT 'missing', key, count(*) FROM r WHERE key NOT IN (SELECT key FROM k) GROUP BY 2 UNION ALL SELECT 'rejected', key, count(*) FROM r WHERE props = '{broken' GROUP BY 2""")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.col("props")).alias("props"))
    good, missing, bad = jobs.migrated(e.drop("user_id"), jobs.surrogates(e.where("user_id % 7 > 0"), "key"), "key", "props")
    told = lambda label, df, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("part"), "key", "n")
    return told("resolved", good, "sid").unionByName(missing.select(F.lit("missing").alias("part"), "key", "n")).unionByName(told("rejected", bad, "key"))


@query("t9_t8_classified_names", """
WITH o AS (SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN '  ' || s_name || chr(10) WHEN 1 THEN s_name || ' Board' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'party' END AS classification FROM supplier),
n AS (SELECT *, trim(name, ' ' || chr(10)) AS new_name FROM o), c AS (SELECT *, coalesce(classification, CASE WHEN regexp_matches(new_name, '(?i)board$') THEN 'board' END) AS new_class FROM n)
SELECT key, 'name' AS "column", name AS before, new_name AS after FROM c WHERE name <> new_name UNION ALL SELECT key, 'classification', classification, new_class FROM c WHERE classification IS DISTINCT FROM new_class""")
def t9(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("s_suppkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("  "), "s_name", F.lit("\n"))).when(kind == 1, F.concat("s_name", F.lit(" Board"))).otherwise(F.col("s_name"))
    organizations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), name.alias("name"), F.when(F.col("s_suppkey") % 4 == 0, "party").alias("classification"))
    return tx.classified_names(organizations, [("board$", "board")])[1]


@query("e9_place_links", """
WITH n AS (SELECT n_nationkey AS name_id, 'Old ' || replace(n_name, '_', ' ') AS name FROM nation),
i AS (SELECT c_custkey AS item, 'Plan for Old nation ' || (c_custkey % 40) || '!' AS name, 'near OLD NATION ' || (c_custkey % 30) || ', and Old Nation ' || (c_nationkey) || '5' AS content FROM customer),
h AS (SELECT item, name_id, 'name' AS evidence FROM i JOIN n ON regexp_matches(i.name, '(?i)(^|[^a-z0-9])' || n.name || '($|[^a-z0-9])') UNION ALL SELECT item, name_id, 'content' FROM i JOIN n ON regexp_matches(i.content, '(?i)(^|[^a-z0-9])' || n.name || '($|[^a-z0-9])'))
SELECT item, name_id, max(evidence) AS evidence FROM h WHERE item % 11 > 0 OR name_id % 2 > 0 GROUP BY 1, 2""")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("name_id"), F.concat(F.lit("Old "), F.translate("n_name", "_", " ")).alias("name"))
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    content = F.concat(F.lit("near OLD NATION "), (key % 30).cast("string"), F.lit(", and Old Nation "), F.col("c_nationkey").cast("string"), F.lit("5"))
    items = c.select(key.alias("item"), F.concat(F.lit("Plan for Old nation "), (key % 40).cast("string"), F.lit("!")).alias("name"), content.alias("content"))
    known = c.where("c_custkey % 11 = 0").select(key.alias("item")).join(names.where("name_id % 2 = 0").select("name_id"), F.lit(True))
    return places.place_links(items, names, known)


@query("j4_without_provenance", f"WITH {TAGS_SQL} SELECT doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT item FROM tags WHERE source = 'manual' AND scheme = 'topic')")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.without_provenance(table(spark, sf, "documents").select(F.col("doc_id").alias("item")), tag_rows(spark, sf), source="manual", scheme="topic")


@query("j14_concept_view", """
SELECT o_orderkey AS id, o_orderpriority AS name, 'c' || l_partkey AS concept, p_name AS label, l_returnflag AS relation, CASE WHEN c_custkey IS NOT NULL THEN 'segment' END AS predicate, c_mktsegment AS value
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 2 LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    concept = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("concept")
    links = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"), concept("l_partkey"), F.col("l_returnflag").alias("relation"))
    concepts = table(spark, sf, "part").where("p_size > 10").select(concept("p_partkey"), F.col("p_name").alias("label"))
    told = o.join(table(spark, sf, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("value"))
    return jobs.concept_view(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")), links, concepts, told)


@query("j15_role_view", """
WITH l AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'role' ELSE 'member' END AS relation, o_orderpriority AS concept FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT DISTINCT o_orderpriority AS concept, lower(o_orderpriority) AS label FROM orders WHERE o_orderpriority < '4')
SELECT c_custkey AS id, c_name AS name, r.concept AS role, kr.label AS role_label, m.concept AS organization, km.label AS organization_label FROM customer LEFT JOIN l r ON r.id = c_custkey AND r.relation = 'role' LEFT JOIN k kr ON kr.concept = r.concept LEFT JOIN l m ON m.id = c_custkey AND m.relation = 'member' LEFT JOIN k km ON km.concept = m.concept""")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    links = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "role").otherwise("member").alias("relation"), F.col("o_orderpriority").alias("concept")).distinct()
    concepts = o.where("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("concept"), F.lower("o_orderpriority").alias("label")).distinct()
    return jobs.role_view(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), links, concepts, "role", "member")


@query("s14_keyed_vectors", "SELECT vec_id::BIGINT::VARCHAR AS key, len(embedding)::INT AS size, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) AS total FROM embeddings")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    loaded = jobs.keyed_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return loaded.select("key", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("a24_class_counts", r"""
SELECT CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])(the|and|of|for)($|[^\p{L}\p{N}_])') THEN 'english' WHEN contains(text, '@') THEN 'mail' WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(der|die|und)($|[^\p{L}\p{N}_])') THEN 'german' ELSE 'other' END AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.class_counts(table(spark, sf, "documents"), "text", [(r"(?U)\b(the|and|of|for)\b", "english"), ("@", "mail"), (r"(?iU)\b(der|die|und)\b", "german")])


@query("g6_serialised_nodes", """
WITH a AS (SELECT c_custkey AS id, 'customer' AS type, NULL::DATE AS date, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT o_custkey AS id, 'buyer' AS type, max(o_orderdate)::DATE AS date, CASE WHEN o_custkey % 5 > 0 THEN 'buyer ' || o_custkey END AS name, count(*)::VARCHAR AS orders FROM orders GROUP BY o_custkey)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.type, b.type) AS type, CASE WHEN a.id IS NULL THEN b.date END AS date, coalesce(b.name, a.name) AS name, a.segment, b.orders FROM a FULL JOIN b ON a.id = b.id""")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    """Customers have no date of their own, buyers have; either side's name may be missing."""
    name = lambda own, keep: F.when(keep > 0, own)
    a = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("type"), F.create_map(F.lit("name"), name(F.col("c_name"), F.col("c_custkey") % 3), F.lit("segment"), "c_mktsegment").alias("attributes"), F.lit("1990-01-01").cast("date").alias("made"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").cast("date").alias("made"), F.count(F.lit(1)).cast("string").alias("n"))
    b = o.select("id", F.lit("buyer").alias("type"), F.lit(None).cast("date").alias("start"), "made", F.create_map(F.lit("name"), name(F.concat(F.lit("buyer "), F.col("id").cast("string")), F.col("id") % 5), F.lit("orders"), "n").alias("attributes"))
    of = lambda k: F.try_element_at("attributes", F.lit(k)).alias(k)
    return jobs.serialised([a, b], {"buyer": ("start", "made"), "customer": ()}).select("id", "type", "date", of("name"), of("segment"), of("orders"))


@query("g8_meeting_topics", """
WITH i AS (SELECT l_orderkey AS meeting, l_orderkey * 10 + l_linenumber AS item, l_partkey AS paper, l_suppkey AS file, l_returnflag AS flag FROM lineitem),
f AS (SELECT item, file FROM i WHERE flag = 'A' UNION SELECT i.item, p_partkey + 100000 FROM i JOIN part ON p_partkey = i.paper AND p_size < 20 WHERE flag <> 'N')
SELECT DISTINCT i.meeting, i.item, coalesce(x.files, '') AS files FROM i LEFT JOIN (SELECT item, string_agg(file::VARCHAR, ',' ORDER BY file) AS files FROM f GROUP BY 1) x USING (item)""")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("meeting"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_partkey").alias("paper"), F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("flag"))
    papers = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("paper"), (F.col("p_partkey") + 100000).alias("file"))
    found = jobs.meeting_topics(i.select("meeting", "item").distinct(), i.where("flag = 'A'").select("item", "file"), i.where("flag <> 'N'").select("item", "paper"), papers)
    return found.select("meeting", "item", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


@query("g11_dated_events", """
WITH n AS (SELECT 'order' AS type, o_orderkey AS key, o_orderdate AS date, o_custkey % 100 AS owner FROM orders UNION ALL SELECT 'ship', l_orderkey * 10 + l_linenumber, l_shipdate, l_partkey % 100 FROM lineitem WHERE l_shipdate IS NOT NULL),
g AS (SELECT *, CASE WHEN floor((epoch_us(date::TIMESTAMP) - epoch_us(lag(date::TIMESTAMP) OVER w)) / 86400000000) > 2 OR lag(date) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM n WINDOW w AS (PARTITION BY owner ORDER BY date, type, key))
SELECT type, owner, count(*) AS events, max(grp)::BIGINT AS groups FROM (SELECT *, sum(s) OVER (PARTITION BY owner ORDER BY date, type, key ROWS UNBOUNDED PRECEDING) AS grp FROM g) GROUP BY 1, 2""")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and shipments as typed objects, dated by their type's column, and grouped by gaps of over two days."""
    o = table(spark, sf, "orders").select(F.lit("order").alias("type"), F.col("o_orderkey").alias("key"), "o_orderdate", F.lit(None).cast("timestamp").alias("l_shipdate"), (F.col("o_custkey") % 100).alias("owner"))
    l = table(spark, sf, "lineitem").select(F.lit("ship").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.lit(None).cast("timestamp").alias("o_orderdate"), F.col("l_shipdate").cast("timestamp").alias("l_shipdate"), (F.col("l_partkey") % 100).alias("owner"))  # noqa: E741
    events = timeline.dated(o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).unionByName(l), {"order": ["o_orderdate"], "ship": ["l_shipdate", "o_orderdate"]})
    grouped = timeline.gap_groups(events.withColumn("tie", F.struct("type", "key")), ["owner"], "date", "tie", 2)
    return grouped.groupBy("type", "owner").agg(F.count(F.lit(1)).alias("events"), F.max("group_no").alias("groups"))


@query("u5_merged_graphs", """
WITH n AS (SELECT 'nation_' || n_nationkey AS id, n_name AS label, 0 AS part FROM nation WHERE n_nationkey < 15 UNION ALL SELECT 'nation_' || c_nationkey, 'of customers', 1 FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT id, label FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY part) = 1""")
def u5(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], "source string, target string, relation string")
    a = table(spark, sf, "nation").where("n_nationkey < 15").select(graph.node_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    b = table(spark, sf, "customer").select(graph.node_id("nation", "c_nationkey").alias("id"), F.lit("of customers").alias("label")).distinct()
    return graph.merge_graphs([(a, none), (b, none)])[0]


@query("s5_column_names", """
WITH k AS (SELECT DISTINCT unnest([event_type, upper(event_type) || ' Time', 'start', 'order', (user_id % 10) || 'x', 'a-b', '']) AS key FROM events)
SELECT key, CASE WHEN c = '' THEN 'k' WHEN regexp_matches(c, '^[0-9]') THEN 'k_' || c ELSE c END AS column_name FROM (SELECT key, CASE key WHEN 'start' THEN 'start_date' WHEN 'order' THEN 'order_col' ELSE regexp_replace(lower(key), '\\W', '_', 'g') END AS c FROM k)""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array("event_type", F.concat(F.upper("event_type"), F.lit(" Time")), F.lit("start"), F.lit("order"), F.concat((F.col("user_id") % 10).cast("string"), F.lit("x")), F.lit("a-b"), F.lit(""))
    return table(spark, sf, "events").select(F.explode(keys).alias("key")).distinct().withColumn("column_name", tx.column_name(F.col("key")))


@query("a15_merged_clusters", f"""
WITH RECURSIVE {CLUSTERS_SQL}, sized AS (SELECT representative AS word, count(*) AS n FROM clusters GROUP BY 1 HAVING count(*) >= 2),
mo AS (SELECT sized.word, translate(sized.word, {LETTERS}) AS t, row_number() OVER (ORDER BY n DESC, tfidf DESC, sized.word) AS k FROM sized JOIN w ON w.word = sized.word),
mfold AS (
  SELECT 0::BIGINT AS k, []::STRUCT(w VARCHAR, t VARCHAR)[] AS heads, NULL::VARCHAR AS word, NULL::VARCHAR AS merged UNION ALL
  SELECT mo.k, CASE WHEN h IS NULL THEN list_append(heads, {{'w': mo.word, 't': mo.t}}) ELSE heads END, mo.word, coalesce(h, mo.word)
  FROM (SELECT f.k, f.heads, mo.word AS x, list_filter(f.heads, lambda r: round(1 - levenshtein(r.t, mo.t) / greatest(length(r.t), length(mo.t))::DOUBLE, 6) >= 0.7)[1].w AS h FROM mfold f JOIN mo ON mo.k = f.k + 1) s JOIN mo ON mo.word = s.x)
SELECT clusters.word, merged AS representative FROM clusters JOIN mfold ON mfold.word = clusters.representative""")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of two words and more put together where their representatives are similar at a lower ratio."""
    words = cut(heaviest_words(spark, sf))  # a thousand rows, read for both clusterings
    return chunks.merged_clusters(chunks.kept_clusters(chunks.word_clusters(words))[0], words, least=0.7)


@query("a14_unclustered_words", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT word FROM clusters WHERE representative IN (SELECT representative FROM clusters GROUP BY 1 HAVING count(*) < 2)")
def a14_rest(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.kept_clusters(chunks.word_clusters(heaviest_words(spark, sf)))[1]


@query("v2_extracted_entities", r"""
SELECT doc_id AS doc, entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{3,}|\d{4,}')) AS entity FROM documents) GROUP BY 1, 2""")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("type"), "text")
    return jobs.entities_of(docs, lambda text, _: re.findall(r"[A-Z]{3,}|[0-9]{4,}", text))
