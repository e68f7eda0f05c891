"""Tags in detail, clusters, topics, snapshots, threads, links, summaries, names with years and features on rows written by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import clusters, filters, quality, ranking, tags, timeline
from civicspark.sources import entities


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_details_of_tags_fill_what_old_rows_lack(spark):
    t = spark.createDataFrame([(1, "b", None, None, None), (1, "a", "kg", "rule", 0.4), (1, "a", "topic", "model", 0.9), (2, "a", "kg", "manual", 0.0), (None, "x", None, None, None)], "item int, tag string, scheme string, source string, confidence double")
    items = spark.createDataFrame([(1,), (1,), (7,)], "item int")
    assert [tuple(r) for r in tags.details(t, items).collect()] == [(1, "a", "kg", "rule", 0.4), (1, "a", "topic", "model", 0.9), (1, "b", None, None, 1.0)]
    assert [tuple(r) for r in tags.details(t, scheme="kg").collect()] == [(1, "a", "kg", "rule", 0.4), (2, "a", "kg", "manual", 0.0)]
    assert tags.details(t).count() == 5 and tags.details(t.where("false"), items).count() == 0


def test_grounding_report_counts_both_sides(spark):
    q = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("b", None)], "tag string, qualifier string")
    v = spark.createDataFrame([("a", "x"), ("a", "x"), ("c", "x")], "tag string, qualifier string")
    assert rows(tags.grounding_report(*tags.within_vocabulary(q, v))) == [("a", 1, 2), ("b", 0, 2)]


MEMBERS = [("x/plan_a.tar.pdf", 1), ("y\\plan_a.md", 1), ("plan-b", 1), ("Plan-b", 1), ("zoo of", 2), ("noise here", -1), ("noise", -1), ("noise", -1), ("lost", None)]


def test_cluster_words_sizes_and_noise(spark):
    m = spark.createDataFrame(MEMBERS, "name string, cluster int")
    assert rows(clusters.sizes(m)) == [(-1, 3), (1, 4), (2, 1)]
    assert rows(clusters.summary(m)) == [(2, 8, 3, 37.5)]
    assert rows(clusters.summary(m.where("false"))) == [(0, 0, 0, None)]
    assert [tuple(r) for r in clusters.token_hints(m).orderBy("cluster", "place").collect()] == [(1, 4, 1, "plan_a", 2), (1, 4, 2, "Plan", 1), (1, 4, 3, "plan", 1), (1, 4, 4, "tar", 1), (2, 1, 1, "zoo", 1)]
    assert {r["cluster"] for r in clusters.token_hints(m, largest=2).collect()} == {1}  # noise takes the other place
    assert clusters.token_hints(m, k=1).where("cluster = 1").count() == 1
    assert clusters.token_hints(m.where("false")).count() == 0


def test_topic_focus_takes_the_first_of_equal_topics_and_none_under_the_threshold(spark):
    topics = spark.createDataFrame([("late", 5, [1.0, 0.0]), ("early", 2, [2.0, 0.0]), ("other", 9, [0.0, 1.0])], "topic string, place int, vector array<double>")
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.2, 1.0]), ("c", [-1.0, -1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0, None])], "query_id string, query_vector array<double>")
    assert rows(ranking.topic_focus(q, topics)) == [("a", "early", 1.0), ("b", "other", 0.980581), ("c", None, 0.0), ("d", None, 0.0), ("e", None, 0.0), ("f", None, 0.0)]
    assert rows(ranking.topic_focus(q.where("query_id = 'b'"), topics, least=0.99)) == [("b", None, 0.980581)]
    assert rows(ranking.topic_focus(q.where("query_id = 'a'"), topics.where("false"))) == [("a", None, 0.0)]


def plain_parity(old, new, tolerance=0.02):
    out = set()
    by = lambda rows: {q: {k: (d, s) for q2, k, d, s in rows if q2 == q} for q in {r[0] for r in rows}}
    a, b = by(old), by(new)
    far = lambda x, y: (x is None) != (y is None) or (x is not None and abs(x - y) > tolerance)
    for q, keys in a.items():
        if q not in b:
            out.add((q, None, "missing query"))
        elif set(keys) != set(b[q]):
            out |= {(q, k, "missing key") for k in set(keys) - set(b[q])} | {(q, k, "extra key") for k in set(b[q]) - set(keys)}
        else:
            for k, (d, s) in keys.items():
                e, t = b[q][k]
                out |= {(q, k, "distance")} if far(d, e) else set()
                s, t = s or {}, t or {}
                out |= {(q, k, "signals")} if set(s) != set(t) else set()
                out |= {(q, k, f"signal {n}") for n in set(s) & set(t) if far(s[n], t[n])}
    return out


def test_search_parity_equals_plain_loops(spark):
    schema = "query_id string, key int, distance double, signals map<string,double>"
    old = [("gone", 1, 0.1, {}), ("set", 1, 0.1, {"name": 0.1}), ("set", 2, 0.1, None), ("same", 1, None, None), ("same", 2, 0.30, {"name": 0.3, "content": 0.1}), ("far", 1, 0.1, {"name": 0.1}), ("far", 2, None, {"name": 0.1}), ("far", 3, 0.1, {"name": 0.1, "content": None})]
    new = [("set", 2, 0.9, None), ("set", 3, 0.1, None), ("same", 1, None, {}), ("same", 2, 0.31, {"content": 0.115, "name": 0.3}), ("far", 1, 0.2, {"content": 0.1}), ("far", 2, 0.5, {"name": 0.9}), ("far", 3, 0.1, {"name": 0.1, "content": 0.2}), ("fresh", 1, 0.1, {})]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    found = quality.search_parity(a, b)
    got = {(r["query_id"], r["key"], r["finding"]) for r in found.collect()}
    assert got == plain_parity(old, new) and len(got) == found.count() == 8
    assert rows(found.where("finding = 'distance'"), "key", "before", "after") == [(1, 0.1, 0.2), (2, None, 0.5)]
    assert quality.search_parity(a, a).count() == 0 and quality.search_parity(a.where("false"), b).count() == 0
    assert {r["finding"] for r in quality.search_parity(a, b.where("false")).collect()} == {"missing query"}


def test_refused_turns_stay_out_of_the_thread(spark):
    t = [(1, i, q) for i, q in enumerate([" one ", "", None, "two <b>", "two", "x" * 251, "three", "four", "five", "six", "seven"])]
    got = timeline.effective_queries(spark.createDataFrame(t, "thread int, turn int, q string"), "thread", "turn", "q").orderBy("turn").collect()
    assert [r["turn"] for r in got] == [0, 4, 6, 7, 8, 9, 10]
    assert [r["query"] for r in got][:3] == ["one", "one · two", "one · two · three"]
    assert got[-1]["query"] == "three · four · five · six · seven"
    long = spark.createDataFrame([(1, i, chr(97 + i) * 250) for i in range(5)], "thread int, turn int, q string")
    last = timeline.effective_queries(long, "thread", "turn", "q").where("turn = 4").first()["query"]
    assert len(last) == 750 and last.endswith("e" * 250) and last.startswith("c" * 244 + " · d")


def test_unreferenced_items_are_in_no_table(spark):
    items = spark.createDataFrame([(1,), (2,), (3,), (None,)], "key int")
    links = lambda *ks: spark.createDataFrame([(k,) for k in ks], "at int")
    assert rows(quality.unreferenced(items, "key", [(links(1, 1, None), "at"), (links(9), "at"), (links(3), "at")])) == [(2,), (None,)]
    assert rows(quality.unreferenced(items, "key", [(links(1).where("false"), "at")])) == [(1,), (2,), (3,), (None,)]


def test_unreferenced_meets_a_hot_key_as_one_row(spark):
    items = spark.range(4).select(F.col("id").alias("key"))
    hot = spark.range(5000).select(F.lit(1).cast("long").alias("at"))
    found = quality.unreferenced(items, "key", [(hot, "at"), (hot, "at")])
    assert rows(found) == [(0,), (2,), (3,)]
    assert "HashAggregate" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text, want",
    [
        ("```markdown\n# A\nb\n```  ", "# A\nb"), ("```\nopen", "open"), ("``` only", ""), ("plain ``` text", "plain ``` text"), (" \n x ", "x"), ("```a\r\nb\r\n   ```", "b"), ("", ""), ("```\n```", ""), ("```\nx\n```\ny", "x\n```\ny"), (None, None),
    ],
)
def test_code_fences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(tx.without_code_fence(F.col("t")).alias("t"))
    assert df.first()["t"] == want


def test_long_texts_give_way_to_their_summary(spark):
    docs = spark.createDataFrame([(1, " short "), (2, "y" * 21), (3, "z" * 21), (4, "w" * 21), (5, "done"), (6, None), (7, "v" * 20)], "doc int, text string")
    said = spark.createDataFrame([(1, "no"), (2, "```\n" + "s" * 30 + "\n```"), (3, None)], "doc int, summary string")
    kept = quality.summary_texts(docs, said, spark.createDataFrame([(5,), (5,)], "doc int"), cutoff=20)
    assert rows(kept) == [(1, False, "short"), (2, True, "s" * 20), (7, False, "v" * 20)]
    assert quality.summary_texts(docs.where("false"), said).count() == 0


def test_named_items_keep_undated_ones_and_list_each_file_once(spark):
    items = spark.createDataFrame([(1, "a plan", 10), (2, "plan b", 11), (3, "plan c", 12), (4, "plan d", None), (5, None, 10), (6, "other", 10), (7, "PLAN", 10)], "key int, name string, owner int")
    moments = spark.createDataFrame([(10, "2020-05-01 10:00:00"), (11, "2018-01-01 00:00:00"), (12, None)], "owner int, moment string").withColumn("moment", F.to_timestamp("moment"))
    link = lambda *xs: spark.createDataFrame(xs, "key int, file string")
    links = {"z_later": link((1, "f1"), (1, "f0"), (1, None)), "auxiliary": link((1, "f2"), (1, "f1"), (2, "g"))}
    got = filters.named_items(items, moments, links, "plan", 2019, 2021).collect()
    assert [(r["key"], str(r["date"]), r["files"]) for r in got] == [(1, "2020-05-01", ["f1", "f2", "f0"]), (3, "None", []), (4, "None", [])]
    assert [r["key"] for r in filters.named_items(items, moments, links, "p_an").collect()] == [2, 1, 3, 4]
    assert [r["key"] for r in filters.named_items(items, moments, links, "plan", year_end=2019).collect()] == [2, 3, 4]


def test_features_of_collections(spark, tmp_path):
    one = {"type": "FeatureCollection", "features": [{"properties": {"NAME": "A", "n": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {}, "geometry": None}, {"properties": {"NAME": 5}}]}
    docs = spark.createDataFrame([(1, json.dumps(one)), (2, "no json"), (3, "[]"), (4, '{"features": {}}'), (5, None), (6, '{"features": []}')], "doc int, body string")
    got = entities.features(docs).orderBy("place").collect()
    assert [(r["doc"], r["place"], r["name"]) for r in got] == [(1, 0, "A"), (1, 1, None), (1, 2, "5")]
    assert json.loads(got[0]["geometry"]) == {"type": "Point", "coordinates": [1, 2]} and json.loads(got[0]["properties"])["n"] == 1
    entities.write_by(entities.features(docs), "name", str(tmp_path / "out"))
    assert (tmp_path / "out" / "name=A").is_dir() and spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert Row(name="A") in entities.features(docs).select("name").collect()
