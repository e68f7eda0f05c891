"""What grows with the input stays in shuffles: results by hand, and plans that gather nothing in one place."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from civicspark.operators import blocks, graph, places, ranking, resolve, trie
from civicspark.plans import catalog_answers, catalog_import, catalog_streams
from civicspark.sources import entities
from civicspark.streaming import incremental


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_in_names_meet_as_a_whole_and_names_are_not_broadcast(spark):
    names = [f"Supplier#{i:04} Board" for i in range(300)] + ["  Ab   C ", "", None, "éß"]
    terms = ["supplier#00", "0299 board", "b c", "b", "c", "é", "a", "", None, "zz", "supplier#0001 board and more"]
    found = resolve.holding(spark.createDataFrame([(t,) for t in terms * 2], "term string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = {(t, n) for t in terms if t for n in names if n is not None and t in " ".join(n.lower().split())}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = plan_of(found)
    assert "SortMergeJoin" in plan and "contains" not in plan.lower()


def test_many_keys_of_one_name_are_compared_once(spark):
    items = spark.createDataFrame([(k, ["big ring", "big rings", "small ring", None][k % 4]) for k in range(400)], "key int, name string")
    asked = spark.createDataFrame([(1, "big ring"), (2, "big ring"), (3, None), (4, "zzz")], "query_id int, query string")
    found = ranking.lexical_recall(asked, items, n=120)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "key").collect())
    order = list(range(0, 400, 4)) + list(range(1, 400, 4))[:20]
    assert got == [(q, place, key) for q in (1, 2) for place, key in enumerate(order, 1)]
    plan = plan_of(ranking.lexical_recall(asked, items, n=120, stop_terms=["small"]))
    assert all("BroadcastHashJoin" not in line or "[t#" not in line for line in plan.splitlines())


def test_names_of_candidates_are_not_broadcast(spark):
    ranked = spark.createDataFrame([(1, 2, 1)], "query_id int, key int, rank int")
    names = {"File": spark.createDataFrame([(2, "two"), (3, "three")], "key int, name string")}
    found = ranking.fused_candidates([("File", "lexical", ranked)], names, {"File": names["File"]}, per_signal=5)
    assert "Broadcast" not in plan_of(found) and found.first().name == "two"


def test_cosines_made_at_once_are_bounded_for_large_batches():
    queries = np.eye(4)[np.arange(2000) % 4]
    items = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([[float(i % 4 == k) for k in range(4)] for i in range(500)])], ["key", "vector"])
    found = list(blocks._blocks(iter([items]), queries))
    assert max(cosines.size for _, cosines in found) <= 1 << 18
    assert [k for kept, _ in found for k in kept.column("key").to_pylist()] == list(range(500))


def test_queries_of_one_text_are_resolved_once(spark, monkeypatch):
    seen, inner = [], places._resolved
    monkeypatch.setattr(places, "_resolved", lambda queries, *rest: seen.append(queries.count()) or inner(queries, *rest))
    asked = spark.createDataFrame([(1, "main  steel"), (2, "Main steel"), (3, None), (4, " "), (5, "xyz")], "query_id int, query string")
    names = spark.createDataFrame([("a", 1, "steel"), ("b", 2, "brass")], "kind string, name_id int, name string")
    got = sorted(tuple(r) for r in places.resolve_places(asked, names, ["eel"]).collect())
    assert seen == [2] and got == [(q, "a", 1, "steel", 1.0, True) for q in (1, 2)]


def test_a_word_is_looked_up_once_for_all_terms(spark, monkeypatch):
    seen, inner = [], graph._terms_in
    monkeypatch.setattr(graph, "_terms_in", lambda word, *rest: seen.append(word) or inner(word, *rest))
    wanted = {k: [f"term{k}", "old"] for k in range(500)} | {"none": ["of olden"], "marks": ["c++", "é"]}
    texts = [(1, "old term7 olden term7"), (2, "of olden term7"), (3, "c++é term77x"), (4, "")]
    assert set(graph._answered(iter(texts), wanted)) == {(1, 7), (2, 7), (2, "none"), (3, "marks")}
    assert sorted(seen) == ["c", "of", "old", "olden", "term7", "term77x", "é"]
    # questions are read as a whole in one pass, and rows of one text are given once
    docs = spark.createDataFrame([(1, "Old Bridges"), (1, "old BRIDGE"), (2, None)], "doc int, text string")
    asked = spark.createDataFrame([("a", "old"), ("a", "bridge"), ("b", "bridges"), ("c", "no")], "question string, term string")
    found = graph.holding_all_terms(docs, asked)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a"), (1, "b")]
    assert plan_of(graph.holding_all_terms(docs, asked)).count("MapInArrow") == 1 and graph.holding_all_terms(docs, asked.where("question = 'c'")).collect() == []


def test_thread_files_do_not_grow_in_number_with_the_threads(spark, tmp_path):
    turns = [(k, t, "user", f"line\none {k}") for k in range(100) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    path = Path(catalog_import.thread_files(spark, str(tmp_path)))
    files = list(path.rglob("*.txt"))
    assert 0 < len(files) <= 32 and all(f.parent == path for f in files)
    docs, rejects = entities.read_folder(spark, str(path), "*.txt", lines=True)
    assert (docs.count(), rejects.count()) == (97, 3)


def test_texts_are_not_copied_for_names_of_a_few_gigabytes(spark):
    names = spark.range(180_000).select(F.col("id").alias("name_id"), F.format_string("a%d b%d c%d", "id", "id", "id").alias("name"))
    docs = spark.createDataFrame([(1, "x a7 b7 c7 a9 b9"), (2, "a179999  B179999, c179999"), (3, None)], "doc int, text string")
    found = trie.name_matches(docs, names)
    plan = plan_of(found)
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Exchange" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, "a7 b7 c7", 1, 4), (2, 179999, "a179999 b179999 c179999", 0, 3)]


def test_a_worker_builds_a_table_of_names_once(monkeypatch):
    built, inner = [], trie.trie
    monkeypatch.setattr(trie, "trie", lambda names, way: built.append(way) or inner(names, way))
    names = pa.table({"name_id": [2, 1, 3], "name": ["a b", "a b", "A"]})
    tables = [trie._once(key, names, "words") for key in ("one", "one", "two")]
    assert len(built) == 2 and tables[0] is tables[1] and list(trie._built) == ["two"]
    assert list(trie.matches("a b", tables[0])) == [(0, 1, 1, 3, "A"), (0, 2, 3, 1, "a b"), (0, 2, 3, 2, "a b")]


def test_a_micro_batch_is_written_by_all_tasks_and_stays_one(spark, tmp_path):
    seen = []

    def start(stream):
        def apply(batch, number):
            files = {r[0] for r in batch.select("_metadata.file_path").distinct().collect()}
            seen.append((number, len(files), sorted(r["id"] for r in batch.collect())))

        return stream.select("id", "_metadata").writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    catalog_streams.run_in_batches(spark, spark.range(0, 90, 1, 3), F.when(F.col("id") % 2 == 0, 0).when(F.col("id") == 1, 1).when(F.col("id") > 1, 3), 4, start)
    assert [s[:2] for s in seen] == [(0, 3), (1, 1), (2, 0), (3, 3)]  # a batch without rows is one too
    assert [s[2] for s in seen] == [list(range(0, 90, 2)), [1], [], list(range(3, 90, 2))]


def test_threads_are_handed_over_with_their_state(spark, tmp_path):
    own = spark.newSession()
    own.conf.set(catalog_streams.STORE, catalog_streams.ROCKS)
    schema = "conv_id string, turn int, text string, followup boolean"
    made = incremental.thread_state(own.readStream.schema(schema).parquet(str(tmp_path)))
    assert "FlatMapGroupsInPandasWithState" in made._jdf.queryExecution().analyzed().toString()
    rows = own.createDataFrame([(c, t, f"{c} {t}", None if t == 3 else True) for c in ("a", "ü", None) for t in range(8)], schema)

    def start(turns):
        return incremental.thread_state(turns).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()

    catalog_streams.run_in_batches(own, rows, F.floor(F.col("turn") / 3), 3, start)
    got = {(r.conv_id, r.turn): (r.query, r.concatenated, r.turns, r.forced_break) for r in own.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 24
    for c in ("a", "ü", None):
        assert got[c, 3] == (f"{c} 3", False, 4, False) and got[c, 4] == (" · ".join(f"{c} {t}" for t in range(5)), True, 5, False)
        assert got[c, 5] == (f"{c} 5", False, 1, True) and got[c, 7] == (f"{c} 5 · {c} 6 · {c} 7", True, 3, False)


def test_a_large_name_is_written_by_several_tasks_and_a_small_one_to_one_file(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    own.conf.set("spark.sql.shuffle.partitions", "50")
    rows = own.range(0, 40000, 1, 8).select(F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    entities.write_by(rows, "name", str(tmp_path / "by"))
    files = lambda name: len(list((tmp_path / "by" / f"name={name}").glob("*.parquet")))
    assert files("small") == 1 and 1 < files("large") <= 8
    assert own.read.parquet(str(tmp_path / "by")).count() == 40000


def test_features_are_objects_or_any_other_json(spark):
    bodies = ['{"features": [{"properties": {"NAME": "A", "b": [1, 2.50]}, "geometry": {"é": "{\\"x"}}, {"properties": "{a", "geometry": [1, {"c": null}]}, {"properties": null, "geometry": 5}, 7, null, {"properties": {}, "geometry": true}]}']
    bodies += ['{"features": {"0": {"properties": {"NAME": "no list"}}}}', '{"features": "x"}', '{"features": null}', '[{"features": [{"properties": {"NAME": "no object"}}]}]', '{"features": [', None]
    found = entities.features(spark.createDataFrame(list(enumerate(bodies)), "doc int, body string"))
    assert "array<variant>" not in found._jdf.queryExecution().analyzed().toString()
    got = [tuple(r) for r in found.orderBy("doc", "place").collect()]
    assert got == [(0, 0, "A", '{"NAME":"A","b":[1,2.5]}', '{"é":"{\\"x"}'), (0, 1, None, '"{a"', '[1,{"c":null}]'), (0, 2, None, "null", "5"), (0, 3, None, None, None), (0, 4, None, None, None), (0, 5, None, "{}", "true")]


def test_only_the_best_documents_of_a_query_leave_a_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vector = lambda k: [float(v) for v in rng.integers(-1, 2, 3)]  # noqa: E731  few of them, so that scores tie
    parts = spark.createDataFrame([(k // 2, k % 2, vector(k)) for k in range(800)], "doc int, chunk int, vector array<double>").repartition(4).cache()
    queries = spark.createDataFrame([(k, [1.0, k - 1.0, 0.5]) for k in range(3)], "query_id int, query_vector array<double>")
    every = ranking.top_per(ranking.best_chunk(queries, parts), ["query_id"], [F.desc("score"), F.col("doc")], 5).drop("rank")
    assert sorted(map(tuple, ranking.best_chunk(queries, parts, 5).collect())) == sorted(map(tuple, every.collect()))
    assert blocks.best_parts(queries, parts, 5).count() <= 3 * 5 * 4
    # a bound that is found on the way drops no document, whatever the order
    monkeypatch.setattr(blocks, "HELD", 8)
    docs, scores = rng.integers(0, 60, 400), np.round(rng.random((2, 400)), 1)
    given = ((pa.record_batch({"doc": docs[k : k + 7], "key": np.arange(400)[k : k + 7]}), scores[:, k : k + 7]) for k in range(0, 400, 7))
    kept = pa.Table.from_batches(blocks._kept(pa.array([0, 1]), given, 4, float("inf"), "doc", ["doc", "key"])).to_pylist()
    best = {(q, d): min((-s, k) for k, (e, s) in enumerate(zip(docs, scores[q])) if e == d) for q in (0, 1) for d in set(docs)}
    want = [(q, d, k, -s) for q in (0, 1) for s, d, k in sorted((s, d, k) for (p, d), (s, k) in best.items() if p == q)[:4]]
    assert [(r["query_id"], r["doc"], r["key"], r["score"]) for r in kept] == want


def test_all_orders_are_expanded_and_lists_of_neighbours_are_made_once_for_a_node(spark, small, monkeypatch):
    rng = np.random.default_rng(8)
    name = lambda: f"{'mapc'[rng.integers(4)]}_{rng.integers(12)}"
    # one direction of an edge, or the first three of a relation would not be settled
    edges = sorted({(*sorted((name(), name())), f"r{rng.integers(2)}") for _ in range(160)})
    edges = [e for e in edges if e[0] != e[1]]
    lists: dict = {}
    for s, t, r in edges:
        for here, node in {(s, t), (t, s)}:
            lists.setdefault((here, r), []).append((node, s, t, r))
    near = lambda at: [e for r in ("r0", "r1") for e in sorted(lists.get((at, r), []))[:3] if e[0][0] != "c"]
    seeds, nodes, found = [f"m_{k}" for k in range(12)], {}, set()
    for seed in seeds:
        nodes[seed, seed] = 0
        for number, kind in enumerate(["m", "a", "p", "a"]):
            at = [seed] if number == 0 else [n for s, n in nodes if s == seed and n[0] == kind]
            told = [e for n in at for e in near(n)]
            found |= {(seed, *e[1:]) for e in told}
            for e in told:
                nodes.setdefault((seed, e[0]), number)
    graph_ = spark.createDataFrame(edges, "source string, target string, relation string")
    asked = spark.createDataFrame([(s,) for s in seeds * 2], "node string")
    looked, inner = [], graph._near
    monkeypatch.setattr(graph, "_near", lambda at, *rest: looked.append([r.node for r in at.collect()]) or inner(at, *rest))
    for sent, kinds in ((100_000, 100), (0, 0)):
        monkeypatch.setattr(graph, "NEAR_SENT", sent)
        monkeypatch.setattr(graph, "KINDS", kinds)
        looked.clear()
        got, told = graph.expanded_in_rounds(asked, graph_, ["a", "p", "a"], skip=["c"], per_relation=3)
        assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in nodes.items())
        assert sorted(map(tuple, told.collect())) == sorted(found)
        tally = {(r.seed, r.relation): tuple(r)[2:] for r in graph.tallied_in_rounds(asked, graph_, ["a", "p", "a"], skip=["c"], per_relation=3).collect()}
        of = {k: [e[1:3] for e in found if (e[0], e[3]) == k] for k in {(e[0], e[3]) for e in found}}
        assert tally == {k: (len(v), len({s for s, _ in v}), len({t for _, t in v}), min(v)[0]) for k, v in of.items()}
        assert sum(map(len, looked)) == 2 * len({n for at in looked for n in at})
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert catalog_answers.g8(spark, small).select("seed").distinct().count() == lines
