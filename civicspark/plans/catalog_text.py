"""More registered queries: rules over texts, pair jobs and tag jobs, on texts put together from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import chunks, graph, pairs, places, tags
from civicspark.plans.catalog import PROFORMS, TAGS_SQL, query, tag_rows
from civicspark.sources import entities
from civicspark.sources.tables import table


@query("j10_registry_join", """
SELECT l_orderkey, l_linenumber, o_orderkey AS item FROM lineitem JOIN orders ON l_shipdate::DATE = o_orderdate::DATE AND l_linenumber = o_orderkey % 7""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("Protokoll "), F.date_format("l_shipdate", "d.M.yyyy"), F.lit(" TOP "), F.col("l_linenumber").cast("string"))
    registry = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 7).cast("string").alias("number"), F.col("o_orderkey").alias("item"))
    return pairs.registry_join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")), registry).select("l_orderkey", "l_linenumber", "item")


BALLOT = ("Ja", "Nein", "Enthaltung")
SIDES = {"accepted": "accepted", "agreed": "accepted", "rejected": "rejected"}


@query("t11_t12_ballots", """
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_quantity::INT END AS yes, (l_tax * 100)::INT * 5 AS no, CASE l_returnflag WHEN 'A' THEN 'agreed' WHEN 'R' THEN 'rejected' ELSE 'postponed' END AS stated FROM lineitem),
c AS (SELECT *, CASE WHEN yes > no THEN 'accepted' WHEN yes < no THEN 'rejected' END AS counted FROM v)
SELECT l_orderkey, l_linenumber, yes, no, counted, CASE WHEN counted IS NULL OR stated = 'postponed' THEN 'n/a' WHEN (stated = 'agreed') = (counted = 'accepted') THEN 'ok' ELSE 'warn' END AS verdict FROM c""")
def ballots(spark: SparkSession, sf: str) -> DataFrame:
    """Four layouts: headings with the number on the next line, table cells, an earlier count, and a label whose number belongs to the next label."""
    yes, no, layout = F.col("l_quantity").cast("int").cast("string"), (F.round(F.col("l_tax") * 100).cast("int") * 5).cast("string"), F.col("l_linenumber") % 4
    text = (
        F.when(layout == 0, F.concat(F.lit("## JA\n"), yes, F.lit("\n## NEIN\n"), no, F.lit("\n1234")))
        .when(layout == 1, F.concat(F.lit("| ## JA | | "), yes, F.lit(" | NEIN | "), no, F.lit(" |")))
        .when(layout == 2, F.concat(F.lit("Ja: 1\nNein 999\nJahr 77\nJa: "), yes, F.lit("\nNein | "), no))
        .otherwise(F.concat(F.lit("Enthaltung - Ja 1234\nNein: "), no))
    )
    stated = F.when(F.col("l_returnflag") == "A", "agreed").when(F.col("l_returnflag") == "R", "rejected").otherwise("postponed")
    counts = {k: tx.count_after(F.col("text"), label, BALLOT) for k, label in (("yes", "Ja"), ("no", "Nein"))}
    read = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stated.alias("stated"), text.alias("text")).withColumns(counts)
    counted = read.withColumn("counted", tx.majority(F.col("yes"), F.col("no")))
    return counted.select("l_orderkey", "l_linenumber", "yes", "no", "counted", tx.outcome_check(F.col("counted"), F.col("stated"), SIDES).alias("verdict"))


#: An item's heading and the section that decides.
ITEM = r"(?i)Punkt\s*([0-9IVX]+(?:\.[0-9]+)?)\s*der Tagesordnung"
SECTION = r"(?is)Beschluss:?\s*\n+([A-Za-zÄÖÜäöüß\.\-, \t]+)"
OUTCOMES = [(tx.spoken_outcome(w), v) for w, v in (("vertagt", "postponed"), ("zugestimmt", "accepted"), ("abgelehnt", "rejected"))]


@query("t13_t14_decisions", """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS form, o_orderkey % 3 AS item, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE NULL END AS word FROM orders)
SELECT o_orderkey, CASE WHEN form = 3 AND word IS NULL THEN 'postponed' ELSE word END AS outcome, form < 3 AND item <> 1 AS top_match, coalesce(word = 'accepted', false) AS result_match FROM o""")
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A section that decides or says nothing, the text after the item's heading, or the whole beginning. Items: the asked one, one that begins like it, any."""
    word = F.when(F.col("o_orderstatus") == "F", "einstimmig Zugestimmt").when(F.col("o_orderstatus") == "O", "wird abgelehnt").otherwise("zur Kenntnis (vertagtes)")
    form, item = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    heading = F.concat(F.lit("Vertagt war: Punkt "), F.when(item == 1, "12").otherwise("1"), F.lit(" der Tagesordnung\n"))
    number = F.when(item == 2, None).otherwise("1")
    text = F.when(form < 2, F.concat(heading, F.lit("einst vertagt, Punkt 1 der Tagesordnung.\nBeschluss:\n\n"), word, F.lit("\n(vertagt)"))).when(form == 2, F.concat(heading, word)).otherwise(F.concat(F.lit("Ohne Punkt "), word, F.when(F.col("o_orderstatus") == "P", " vertagt").otherwise("")))
    rows = table(spark, sf, "orders").select("o_orderkey", number.alias("number"), text.alias("text"))
    found = rows.withColumn("outcome", tx.decision(F.col("text"), SECTION, OUTCOMES, ITEM))
    top, result = tx.item_verified(F.col("text"), F.col("number"), F.lit("accepted"), F.col("outcome"), ITEM)
    return found.select("o_orderkey", "outcome", top.alias("top_match"), result.alias("result_match"))


@query("t16_eras", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' AND (o_orderdate::DATE <= DATE '1993-12-31' OR year(o_orderdate) = 1995) THEN 'old' WHEN o_orderpriority LIKE '%URGENT%' AND o_orderdate::DATE >= DATE '1996-01-01' THEN 'new' WHEN o_orderpriority LIKE '%HIGH%' THEN 'high' END AS party FROM orders")
def eras(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("URGENT", "old", [(None, "1993-12-31"), ("1995-01-01", "1995-12-31")]), ("URGENT", "new", [("1996-01-01", None)]), ("urgent", "never", None), ("HIGH", "high", None)]
    return table(spark, sf, "orders").select("o_orderkey", tx.valid_at(F.col("o_orderdate").cast("date"), rules, F.col("o_orderpriority")).alias("party"))


@query("t17_t18_t19_address_gate", """
SELECT c_custkey, c_custkey % 6 IN (0, 1, 2) AS address_only, CASE c_custkey % 6 WHEN 0 THEN '…Büro: GARTENSTRASSE 21, 12345 Musterstadt…' WHEN 1 THEN '…Gartenstrasse 12-14 12345 musterstadt…' WHEN 2 THEN '…' || left('Gartenstrasse 3a · 12345 Musterstadt und gartenstrasse 4/5; 12345 Musterstadt', 73) || '…'
  WHEN 3 THEN '…Umbau der Gartenstrasse…' WHEN 4 THEN '…Gartenstrasse 1, 12345 Musterstadt. Umbau der Gartenstrasse…' END AS evidence FROM customer""")
def address_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges, letters, missing commas and other marks, case, a second mention, and a name inside a longer word."""
    forms = ["[X]Büro: GARTENSTRASSE 21, 12345\nMusterstadt", "[x]Gartenstrasse 12-14 12345 musterstadt", "Gartenstrasse 3a · 12345 Musterstadt und gartenstrasse 4/5; 12345 Musterstadt", "Umbau [x]der Gartenstrasse", "Gartenstrasse 1, 12345 Musterstadt. Umbau der Gartenstrasse", "Kleingartenstrasse"]
    text = F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % 6 + 1).cast("int"))
    clean = tx.without_noise(text, [r"\[x\]"])
    return table(spark, sf, "customer").select("c_custkey", tx.only_as_address(clean, "Gartenstrasse", "Musterstadt").alias("address_only"), tx.excerpt(clean, F.lit(" gartenstrasse ")).alias("evidence"))


@query("t10_dates_in_texts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def dates_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """English forms before dotted ones before ISO, wherever they stand; a form that is there but says no date decides too."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("on 2001-02-03, 01.02.2003, at 16:54 "), F.date_format(d, "d MMM yyyy"))).when(kind == 1, F.concat(F.lit("am 2001-02-03 und "), F.date_format(d, "dd.MM.yyyy"))).when(kind == 2, F.concat(F.lit("5.3.2024 x "), F.date_format(d, "yyyy-MM-dd"))).when(kind == 3, F.upper(F.date_format(d, "d MMMM yyyy"))).otherwise("31 Feb 2020, 01.02.2003")
    return table(spark, sf, "orders").select("o_orderkey", tx.date_in_text(text).alias("day"))


@query("t27_allowed_queries", r"""
WITH q AS (SELECT doc_id, regexp_replace(regexp_replace(CASE doc_id % 3 WHEN 0 THEN '  ' || left(text, 100) || '[€ 5] @ #1 „x“ ' WHEN 1 THEN left(text, 300) ELSE left(text, 20) || '<b>' END, '^\s+', ''), '\s+$', '') AS q FROM documents)
SELECT doc_id, length(q) BETWEEN 1 AND 250 AND regexp_full_match(q, '[\p{L}\p{N}\s.,;:!?()\[\]{}„“«»"''’`\-–—/&%+*#@=_|~°§$€]+') AS allowed FROM q""")
def allowed(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("doc_id") % 3
    asked = F.when(form == 0, F.concat(F.lit("  "), F.left("text", F.lit(100)), F.lit("[€ 5] @ #1 „x“ "))).when(form == 1, F.left("text", F.lit(300))).otherwise(F.concat(F.left("text", F.lit(20)), F.lit("<b>")))
    return table(spark, sf, "documents").select("doc_id", tx.allowed_query(asked).alias("allowed"))


@query("t29_path_parts", r"""
WITH p AS (SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN replace(url, '/', '\') ELSE url || CASE WHEN page_id % 3 = 0 THEN '/a_b-c.tar.PDF' ELSE '' END END, '\', '/') AS path FROM pages),
q AS (SELECT page_id, string_split(path, '/') AS parts FROM p), r AS (SELECT page_id, parts[-1] AS filename, CASE WHEN len(parts) > 1 THEN parts[-2] ELSE '' END AS folder, len(string_split(parts[-1], '.')) AS dots FROM q)
SELECT page_id, folder, filename, CASE WHEN dots > 1 THEN lower(string_split(filename, '.')[-1]) ELSE '' END AS extension, CASE WHEN dots > 1 THEN regexp_replace(filename, '\.[^.]*$', '') ELSE filename END AS stem, string_split(string_split(CASE WHEN dots > 1 THEN regexp_replace(filename, '\.[^.]*$', '') ELSE filename END, '-')[1], '_')[1] AS prefix FROM r""")
def paths(spark: SparkSession, sf: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id")
    path = F.when(page % 2 == 0, F.replace(url, F.lit("/"), F.lit("\\"))).when(page % 3 == 0, F.concat(url, F.lit("/a_b-c.tar.PDF"))).otherwise(url)
    return table(spark, sf, "pages").select("page_id", *tx.path_parts(path))


@query("s16_street_register", """
SELECT p_brand || ' ' || p_partkey AS name, 1900 + p_size AS year, p_type AS description FROM part WHERE p_partkey % 6 IN (0, 1, 2) UNION ALL
SELECT p_brand || ' ' || p_type, CASE WHEN p_partkey % 6 = 3 THEN 1800 + p_size ELSE -1 END, '' FROM part WHERE p_partkey % 6 IN (3, 4)""")
def register(spark: SparkSession, sf: str) -> DataFrame:
    """One register for each size: headings with a last year, one after "vor" or "um", a first year, a century, and headings that hold nothing but a year."""
    own, year, kind = F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    last = F.lpad(year, 2, "0")
    heading = F.when(kind == 0, F.concat(own, F.lit(" 19"), last)).when(kind == 1, F.concat(own, F.lit(", vor dem 1.1. 19"), last)).when(kind == 2, F.concat(own, F.lit(" um 19"), last)).when(kind == 3, F.concat(F.lit("18"), last, F.lit(" "), F.concat_ws(" ", "p_brand", "p_type"))).when(kind == 4, F.concat(F.concat_ws(" ", "p_brand", "p_type"), F.lit(" im 18.Jahrhundert"))).otherwise(F.concat(F.lit("19"), last))
    section = F.concat(heading, F.when(kind < 3, F.concat(F.lit("\n"), "p_type", F.lit("\nmore"))).otherwise(""))
    whole = table(spark, sf, "part").groupBy("p_size").agg(F.array_join(F.array_sort(F.collect_list(section)), "## ").alias("text"))
    return entities.street_register(whole).select("name", "year", "description")


@query("t23_t7_parsed_columns", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE o_orderdate::DATE::TIMESTAMP END AS moment, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority ELSE 'Haushalt' END AS kind, CASE WHEN o_orderkey % 4 < 2 THEN (100 + o_orderkey % 500)::VARCHAR END AS code FROM orders""")
def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Moments in five forms, one of them with a blank for the T, which is none; types of a family with and without a code, and any other as it stands."""
    d, form, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5, F.col("o_orderkey") % 4
    written = F.when(form == 0, F.date_format(d, "d.M.yyyy")).when(form == 1, F.date_format(d, " yyyy-MM-dd ")).when(form == 2, F.date_format(d, "yyyy-MM-dd'T'00:00:00.250'+02:00'")).when(form == 3, F.date_format(d, "yyyy-MM-dd 00:00:00")).otherwise(F.date_format(d, "yyyy-MM-dd'T'00:00:00'Z'"))
    code = (F.col("o_orderkey") % 500 + 100).cast("string")
    said = F.when(kind == 0, F.concat(F.lit("Haushalt THH "), code)).when(kind == 1, F.concat(F.lit(" haushalt "), code)).when(kind == 2, "Haushalt der Stadt 77").otherwise(F.col("o_orderpriority"))
    of, number = tx.folded_type(said, [("Haushalt", r"^Haushalt\b", r"^Haushalt\s+(?:THH\s+)?([0-9]{3,4})$")])
    return table(spark, sf, "orders").select("o_orderkey", tx.parse_moment(written).alias("moment"), of.alias("kind"), number.alias("code"))


@query("s7_associations", "SELECT DISTINCT 'o' || l_orderkey AS src_sid, 'p' || l_partkey AS tgt_sid FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10")
def associations(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "lineitem").select(F.concat(F.lit("order/"), "l_orderkey").alias("id"), F.lit("part").alias("field"), F.concat(F.lit("part/"), "l_partkey").alias("value"))
    orders = table(spark, sf, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("id"), F.concat(F.lit("o"), "o_orderkey").alias("sid"))
    parts = table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("part/"), "p_partkey").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("sid"))
    return entities.associations(values, orders.unionByName(parts), "part")


@query("j11_candidate_documents", "SELECT DISTINCT l_orderkey AS pair, l_partkey AS document FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 1")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_partkey").alias("document"), "l_returnflag", "l_linenumber")
    return pairs.candidate_documents([rows.where("l_returnflag = 'R'").select("pair", "document"), rows.where("l_linenumber = 1").select("pair", "document")])


@query("e17_role_fill", "SELECT o_orderkey AS pair, coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') THEN 'answered' END) AS outcome FROM orders")
def role_fill(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("outcome"))
    roles = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_returnflag").alias("role"))
    return pairs.role_fill(known, roles, {"A": "answered"})


@query("e21_e22_grounding", "SELECT l_orderkey AS pair, max(CASE WHEN l_linenumber = 1 THEN l_shipdate::DATE END)::VARCHAR AS asked, max(CASE WHEN l_linenumber > 1 THEN l_shipdate::DATE END)::VARCHAR AS answered FROM lineitem GROUP BY 1")
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(F.lit("day"), F.col("l_shipdate").cast("date").cast("string"), F.lit("flag"), F.col("l_returnflag"))
    said = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.when(F.col("l_linenumber") == 1, "request").otherwise("response").alias("stage")).agg(F.max_by(fields, F.col("l_shipdate")).alias("fields"))
    clean = pairs.flag_fields(said.withColumn("flagged", F.lit(None).cast("map<string,string>")), ["flag"])
    out = pairs.grounding(clean)
    return out.select("pair", F.try_element_at("request", F.lit("day")).alias("asked"), F.try_element_at("response", F.lit("day")).alias("answered"))


@query("e23_e24_thresholded_tags", f"WITH {TAGS_SQL} SELECT item, tag FROM tags WHERE confidence >= CASE tag WHEN 't1' THEN 0.8 ELSE 0.9 END AND tag IN ('t1', 'q0')")
def thresholded(spark: SparkSession, sf: str) -> DataFrame:
    scores = tag_rows(spark, sf).where("confidence is not null").select("item", "tag", F.col("confidence").alias("score"), F.lit("x").alias("qualifier"))
    least = spark.createDataFrame([("t1", 0.8), ("q0", 0.9), ("gone", 0.0)], "tag string, threshold double")
    kept = tags.above_threshold(scores, tags.drop_tag(least, scores, ["gone"])[0], ["t1"])
    vocabulary = spark.createDataFrame([("t1", "x"), ("q0", None)], "tag string, qualifier string")
    good, rest = tags.within_vocabulary(kept, vocabulary)
    return good.unionByName(rest.where("qualifier is null")).select("item", "tag")


@query("e10_stale_links", "SELECT c_custkey AS item, CASE WHEN c_custkey % 4 = 0 THEN 'nowhere' ELSE n_name END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 <> 0")
def stale(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    links = c.select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 4 == 0, "nowhere").otherwise(F.col("n_name")).alias("place"))
    items = c.select(F.col("c_custkey").alias("item"), F.concat(F.lit("in "), F.upper("n_name")).alias("item_name"))
    return places.still_valid(links, items)[0].select("item", "place")


@query("t24_web_links", "SELECT conv_id, turn, 'https://portal.example/thread?id=' || conv_id AS link FROM conversations")
def web_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.web_link("https://portal.example/", F.lit("Thread"), F.col("conv_id")).alias("link"))


@query("t26_thread_turns", r"""
WITH c AS (SELECT conv_id, turn, text, string_split_regex(trim(text), '\s+') AS w, conv_id % 3 > 0 AS thematic, CASE WHEN turn % 3 > 0 THEN (turn % 5) / 5.0 END AS confidence, CASE WHEN turn % 2 = 0 THEN 'roads' END AS topic, conv_id % 7 > 0 AS sure FROM conversations),
a AS (SELECT *, len([i FOR i IN range(1, len(w) + 1) IF regexp_replace(lower(w[i]), '[,.!?:;]+$', '') IN ('it', 'that', 'this', 'these', 'they', 'de', 'der', 'a', 'en') AND (i = len(w) OR regexp_matches(w[i + 1], '^\p{Ll}'))]) > 0 AS anaphora FROM c)
SELECT conv_id, turn, CASE WHEN thematic AND sure AND (anaphora OR (topic IS NULL AND coalesce(confidence, 0) < 0.5)) THEN 'followup' ELSE 'break' END AS action FROM a""")
def thread_turns(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    signals = (F.col("conv_id") % 3 > 0, F.when(turn % 3 > 0, (turn % 5) / 5), F.when(turn % 2 == 0, F.lit("roads")), F.col("conv_id") % 7 > 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.thread_turn(F.col("text"), *signals, PROFORMS, 0.5).alias("action"))


@query("u7_answer_scope", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice > 1500)")
def scope(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_retailprice")
    chosen = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("key"))
    return graph.answer_scope(chosen, part, part.where("p_size < 10"), part.where("p_retailprice > 1500"))


@query("e3_backfill", "SELECT doc_id AS doc, length(text)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backfilled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    have = chunks.backfill(docs.join(table(spark, sf, "labels").select(F.col("doc_id").alias("doc")), "doc", "left_semi"), docs.limit(0))
    return chunks.replace_chunks(have, chunks.backfill(docs, have)).join(have.select("doc"), "doc", "left_anti").select("doc", F.length("text").cast("long").alias("chars"))


@query("a30_topic_clusters", f"""
WITH RECURSIVE {TAGS_SQL}, r AS (SELECT doc_id AS item, doc_id AS place FROM documents WHERE doc_id % 50 = 0),
held AS (SELECT DISTINCT place, item, tag FROM r JOIN tags USING (item)), n AS (SELECT count(*) AS n FROM (SELECT tag FROM held GROUP BY 1 HAVING count(*) >= 2)),
l AS (SELECT place, item, list_sort(list(tag)) AS tags, row_number() OVER (ORDER BY place, item) AS k FROM held WHERE item IN (SELECT item FROM r ORDER BY place, item LIMIT 5) GROUP BY 1, 2),
fold AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS seen, NULL::BIGINT AS place, NULL::BIGINT AS item, NULL::VARCHAR AS label UNION ALL
  SELECT k2, CASE WHEN x IS NULL THEN seen ELSE list_append(seen, x) END, p2, i2, x
  FROM (SELECT f.seen, l.k AS k2, l.place AS p2, l.item AS i2, list_filter(l.tags, lambda t: NOT list_contains(f.seen, t))[1] AS x FROM fold f JOIN l ON l.k = f.k + 1)),
o AS (SELECT place, item, label FROM fold WHERE label IS NOT NULL)
SELECT place, item, label FROM o WHERE (SELECT n FROM n) >= 3 AND (SELECT count(*) FROM o) >= 2""")
def topics(spark: SparkSession, sf: str) -> DataFrame:
    related = table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("item"), F.col("doc_id").alias("place"))
    return tags.topic_clusters(tag_rows(spark, sf), related, query_words=2)
