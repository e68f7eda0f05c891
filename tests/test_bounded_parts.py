"""Jobs over large tables: what one task is dealt does not grow with the table, and nothing is made twice."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from civicspark.operators import chunks, graph, jobs, places, quality
from civicspark.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.tasks_for(spark.range(3)) == cores and tables.tasks_for(spark.range(101 * cores), rows=10) == 10 * cores + cores // 10 + 1


def test_protocols_are_judged_once_in_the_parts_asked_for(spark):
    day = dt.date(2024, 5, 3)
    pairs = spark.createDataFrame([(1, "2", day, None), (2, "2", day, "accepted"), (3, "2", day, None)], "pair int, number string, day date, outcome string")
    said = lambda item, word: f"03.05.2024\nTOP {item}\nDecision: {word}"
    rows = [(1, 1, said(3, "accepted")), (1, 2, said(2, "rejected")), (1, 3, said(2, "rejected")), (1, 4, said(2, "accepted")), (2, 1, said(2, "accepted")), (2, 2, None), (3, 1, "TOP 2\nDecision: none"), (9, 1, said(2, "accepted"))]
    candidates = spark.createDataFrame([(p, d, "Minutes", t) for p, d, t in rows * 2], "pair int, document int, name string, text string")
    rules = [("accepted", "accepted"), ("rejected", "rejected")], r"(?s)Decision:(.{0,400})", r"(?i)\bTOP\s*(\d+)"
    known = jobs.attached_protocols(pairs, candidates, *rules, tasks=7)
    plan = plan_of(known)
    assert plan.count("Exchange hashpartitioning") == plan.count(", 7), REPARTITION_BY_NUM") == 2 and plan.count("Window ") == 1
    got = {(r.pair, r.document): (r.derived, r.attached, r.source) for r in known.collect()}
    none = (None, False, False)
    assert got == {(1, 1): ("rejected", False, False), (1, 2): ("rejected", False, True), (1, 3): ("rejected", True, False), (1, 4): ("rejected", False, False), (2, 1): (None, True, False), (2, 2): none, (3, 1): none}
    attached, derived = jobs.protocols(pairs, candidates, *rules)
    assert sorted(map(tuple, attached.collect())) == [(1, 3), (2, 1)] and [tuple(r) for r in derived.collect()] == [(1, "rejected", 0.7, "protocol")]


def test_snapshots_meet_in_one_exchange_of_each_and_nulls_as_in_a_full_join(spark):
    row = lambda q, k, d, **signals: (q, k, d, signals or None)
    schema = "query_id int, key int, distance double, signals map<string,double>"
    a = spark.createDataFrame([row(1, 1, 0.1, s=0.5), row(1, 2, 0.2), row(2, 1, 0.3), row(3, None, 0.1), row(None, 1, 0.1), row(5, 1, 0.1, s=0.1, t=0.1)], schema)
    b = spark.createDataFrame([row(1, 1, 0.2, s=0.9), row(1, 2, 0.2, s=0.1), row(2, 2, 0.3), row(3, None, 0.1), row(4, 1, 0.1), row(5, 1, None, s=0.2)], schema)
    found = quality.search_parity(a, b, tasks=7)
    plan = plan_of(found)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count(", 7), REPARTITION_BY_NUM") == 1
    got = sorted(map(tuple, found.collect()), key=str)
    want = [(1, 1, "distance", 0.1, 0.2), (1, 1, "signal s", 0.5, 0.9), (1, 2, "signals", None, None), (2, 1, "missing key", 0.3, None), (2, 2, "extra key", None, 0.3), (3, None, "missing key", 0.1, None), (3, None, "extra key", None, 0.1)]
    want += [(None, None, "missing query", None, None), (5, 1, "distance", 0.1, None), (5, 1, "signals", None, None), (5, 1, "signal s", 0.1, 0.2)]
    assert got == sorted(want, key=str)
    assert quality.search_parity(a.where(F.col("query_id") == 1), b.where("query_id = 4")).select("finding").collect() == [("missing query",)]


def test_words_are_counted_where_texts_are_read(spark):
    texts = ["the red red house and a Red car", "red cars, 4 carsé", None, "", "car"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    found = chunks.word_weights(docs, ["the", "and"])
    plan = plan_of(found)
    assert "doc#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line) and plan.count("hashpartitioning(word") == 1
    got = {r.word: (r.total, r.docs, r.tfidf) for r in found.collect()}
    told = {"red": (4, 2), "house": (1, 1), "car": (2, 2), "cars": (1, 1), "carsé": (1, 1)}
    assert got == {w: (n, d, round(n / d * math.log(5 / d), 6)) for w, (n, d) in told.items()}


def test_edges_that_no_node_touches_are_not_made_distinct(spark):
    lines = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 7), (3, 9)], "a int, b int")
    made = graph.edges([(lines, graph.Link("ab", "a", "a", "b", "b")), (lines, graph.Link("back", "a", "a", "b", "b", reverse=True))])
    seeds = spark.createDataFrame([("a_1",), ("b_7",)], "node string")
    found = graph.neighbourhood(F.broadcast(seeds), made, 5)
    plan = plan_of(found)
    # each of the four readings meets the seeds before anything is grouped or moved
    assert plan.count("BroadcastHashJoin") == 4 and all("HashAggregate" not in part.split("BroadcastHashJoin")[-1].splitlines()[0] for part in plan.split("Scan")[:-1])
    assert all(plan.splitlines()[i + 1].lstrip(" :+-*()0123456789").startswith(("Project", "Filter", "BroadcastExchange")) for i, line in enumerate(plan.splitlines()) if "BroadcastHashJoin" in line)
    got = sorted(tuple(r)[:5] for r in found.collect())
    assert got == sorted([("a_1", "b_7", "ab", "a_1", "b_7"), ("a_1", "b_8", "ab", "a_1", "b_8"), ("a_1", "b_7", "back", "b_7", "a_1"), ("a_1", "b_8", "back", "b_8", "a_1"), ("b_7", "a_1", "back", "b_7", "a_1"), ("b_7", "a_2", "back", "b_7", "a_2"), ("b_7", "a_1", "ab", "a_1", "b_7"), ("b_7", "a_2", "ab", "a_2", "b_7")])


def test_linked_names_are_compared_once_or_after_the_cap(spark):
    links = spark.createDataFrame([(q, i, g) for q in (1, 2, 3) for i in range(6) for g in ("content", None)] + [(1, 6, "boilerplate"), (9, 1, None)], "query_id int, item int, gate_status string")
    queries = spark.createDataFrame([(1, "big ring"), (2, "big ring"), (3, None)], "query_id int, query string")
    names = ["small ring", "big ring", None, "big ring", "big rings", "xyz", "big ring"]
    items = spark.createDataFrame(list(enumerate(names)), "item int, name string")
    found = places.linked_items(links, queries, items, 4)
    plan = plan_of(found)
    assert plan.count("HashAggregate(keys=[_query") == 2  # the texts that are compared are made distinct before
    got = sorted((r.query_id, r.place, r.item, r.sim) for r in found.collect())
    near = got[2][3]
    assert 0.4 < near < 1 and [g for g in got if g[0] < 3] == [(q, p, i, s) for q in (1, 2) for p, i, s in ((1, 1, 1.0), (2, 3, 1.0), (3, 4, near), (4, 0, got[3][3]))]
    assert [g for g in got if g[0] == 3] == [(3, p, p - 1, None) for p in (1, 2, 3, 4)]
    files = items.select(F.col("item").alias("file"), "name", F.when(F.col("item") == 2, dt.datetime(2024, 1, 2)).alias("date"))
    meetings = spark.createDataFrame([(4, dt.datetime(2023, 1, 1)), (4, dt.datetime(2025, 1, 1)), (2, dt.datetime(2022, 1, 1))], "file int, start timestamp")
    told = places.linked_files(links.withColumnRenamed("item", "file"), queries, files, meetings, 3)
    assert plan_of(told).split("Window [row_number")[0].count("Join [query_id") == 2  # totals and texts join what the cap left
    assert sorted((r.query_id, r.place, r.file, r.total) for r in told.collect()) == [(q, p, f, 6) for q in (1, 2, 3) for p, f in ((1, 4), (2, 2), (3, 0))]
