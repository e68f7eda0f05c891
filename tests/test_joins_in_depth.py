"""Prefix-filtered string joins, blocked vector searches and the name trie, each against plain loops."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from civicspark.operators import blocks, chunks, graph, pairs, places, qgrams, ranking, trie


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def ratio(a, b):
    return 1 - distance(a, b) / max(len(a), len(b))


def strings(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdeé", k=r.randrange(1, 14))) for _ in range(n // 3)]
    out = set(base) | {"a", "b", "ab"}
    while len(out) < n:
        s = list(r.choice(base))
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(len(s) + 1)
            s[at : at + r.randrange(2)] = r.choice(["", "a", "c", "zz"])
        out.add("".join(s))
    return sorted(out - {""})


@pytest.mark.parametrize("least", [0.55, 0.65, 0.75, 0.8, 0.95, 1.0])
def test_prefixes_lose_no_pair(spark, least):
    names = strings(int(least * 100), 160)
    given = spark.createDataFrame([(n,) for n in names * 2] + [(None,), ("",)], "name string")
    got = {(r.name, r.other): r.ratio for r in qgrams.similar_strings(given, given.withColumnRenamed("name", "other"), least).collect()}
    want = {(a, b): ratio(a, b) for a in names for b in names if ratio(a, b) >= least - 1e-9}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    once = qgrams.similar_strings(given, given.withColumnRenamed("name", "other"), least, once=True)
    assert {tuple(r)[:2] for r in once.collect()} == {k for k in want if k[0] < k[1]}


def test_few_candidates_among_distinct_names(spark):
    """Two thousand names of twelve letters from a wide alphabet: under 5 % of pairs are compared, and no join is a nested loop."""
    r = random.Random(1)
    names = sorted({"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(2000)})
    given = spark.createDataFrame([(n, n) for n in names], "name string, other string")
    met = qgrams.candidates(given.select("name"), given.select("other"), 0.75)
    assert met.count() < 0.05 * len(names) ** 2
    plan = qgrams.similar_strings(given, given, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        qgrams.candidates(given, given, 0.5)


def test_known_names_stay(spark):
    known = spark.createDataFrame([("Main Road",), ("MAIN ROAD",), ("Hill",)], "name string")
    asked = spark.createDataFrame([("Main Road",), ("Main Raod",), ("x",)], "name string")
    got = {r.name: (r.corrected, r.ratio) for r in pairs.corrected(asked, known, 0.7).collect()}
    assert got["Main Road"] == ("Main Road", 1.0) and got["x"] == ("x", None) and got["Main Raod"][0] == "Main Road"


# --- vectors -------------------------------------------------------------------------------------


def cosine(a, b):
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / norms, 6) + 0.0 if norms else 0.0


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(5)
    rows = [(k, f"d{k % 7}", [round(r.gauss(0, 1), 1) for _ in range(4)]) for k in range(300)]
    rows += [(300, "d0", [0.0] * 4), (301, "d1", None), (302, "d1", [1.0, None, 0.0, 0.0]), (303, "d2", [1.0]), (304, "d3", [float("nan")] * 4), (305, "d9", rows[0][2])]
    items = spark.createDataFrame(rows, "key long, doc string, vector array<double>").repartition(5)
    usable = [r for r in rows if r[2] and len(r[2]) == 4 and None not in r[2] and r[2][0] == r[2][0]]
    asked = [r for r in usable if r[0] % 10 == 0]
    queries = spark.createDataFrame([(k, v) for k, _, v in asked], "query_id long, query_vector array<double>")
    return queries, items, asked, usable


@pytest.fixture(params=[2000, 7])
def at_once(request, monkeypatch):
    """One matrix for all, and a batch dealt into blocks."""
    monkeypatch.setattr(blocks, "QUERIES_AT_ONCE", request.param)
    monkeypatch.setattr(blocks, "ITEMS_AT_ONCE", 100)
    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(blocks, "HELD", 50)


def test_best_items(vectors, at_once):
    queries, items, asked, usable = vectors
    got = sorted(tuple(r) for r in ranking.vector_recall(queries, items, 0.9, 6).collect())
    want = []
    for q, _, v in asked:
        ranked = sorted((-cosine(v, w), k) for k, _, w in usable if round(1 - cosine(v, w), 6) < 0.9)[:6]
        want += [(q, k, -s + 0.0, place + 1) for place, (s, k) in enumerate(ranked)]
    assert got == sorted(want)


def test_best_parts_and_labels_and_histogram(spark, vectors, at_once):
    queries, items, asked, usable = vectors
    parts = items.select("doc", F.col("key").alias("chunk"), "vector")
    got = {(r.query_id, r.doc): (r.score, r.chunk) for r in ranking.best_chunk(queries, parts).collect()}
    want = {}
    for q, _, v in asked:
        for k, d, w in usable:
            s = (cosine(v, w), -k)
            want[q, d] = max(want.get((q, d), s), s)
    assert got == {k: (s, -c) for k, (s, c) in want.items()}
    middles = queries.select(F.concat(F.lit("l"), "query_id").alias("label"), F.col("query_vector").alias("centroid"))
    got = {r.key: (r.label, r.score) for r in ranking.nearest_centroid(items, middles, "label", 0.2).collect()}
    best = {k: max((cosine(v, w), f"l{q}") for q, _, v in asked) for k, _, w in usable}
    assert got == {k: (label, s) for k, (s, label) in best.items() if s >= 0.2}
    got = {r.bucket: r.n for r in blocks.distance_histogram(queries, items).collect()}
    want = {}
    for q, _, v in asked:
        for k, _, w in usable:
            if q != k:
                d = round(1 - cosine(v, w), 6)
                b = 0 if d < 0 else 21 if d >= 2 else int(d / 0.1) + 1
                want[b] = want.get(b, 0) + 1
    assert got == want


def test_no_queries_and_no_items(spark, vectors, at_once):
    queries, items, *_ = vectors
    assert ranking.vector_recall(queries.limit(0), items).count() == 0
    assert ranking.vector_recall(queries, items.limit(0)).count() == 0


def test_an_item_of_several_vectors_counts_once(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "key long, vector array<double>")
    middle = spark.createDataFrame([("x", [0.9, 0.1]), ("y", [0.0, 1.0])], "label string, centroid array<double>")
    assert {tuple(r) for r in ranking.nearest_centroid(items, middle, "label", 0.1).collect()} == {(1, "y", 1.0), (2, "y", 0.8)}


# --- trie ----------------------------------------------------------------------------------------


def literal_spans(text, name):
    return [m.span() for m in re.finditer(r"(?<!\w)" + re.escape(name) + r"(?!\w)", text, re.IGNORECASE)]


def literal_longest(text, names):
    found = sorted(((s - e, s, e, n.casefold(), k, n) for k, n in names for s, e in literal_spans(text, n)))
    kept = []
    for m in found:
        if all(m[1] >= o[2] or o[1] >= m[2] for o in kept):
            kept.append(m)
    return {(m[1], m[2], m[4]) for m in kept}


def literal_left(text, names):
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for _, n in sorted(names, key=lambda x: (-len(x[1]), x[1].casefold()))) + r")(?!\w)", re.IGNORECASE)
    ids = {n.casefold(): k for k, n in names}
    return {(*m.span(), ids[m.group().casefold()]) for m in pattern.finditer(text)}


NAMES = list(enumerate(["Am Bach", "Am Bach-Ost", "Bach", "Ost", "St. Georg", "Weststadt", "Alte Allee", "Allee 5", "5 Linden", "-x-", "A.", "a b c", "c d", "d e"]))
PARTS = ["Am Bach", "am bach-OST", "Nordweststadt", "Weststadt", "St. Georg", "St.Georg", "Alte Allee 5 Linden", "a b c d e", "y-x-z", "-x-", "A.b", "A. ", "Bach_", "Ost-Bach", ",", "\n", "é"]


def test_literal_names_both_ways(spark):
    r = random.Random(2)
    texts = [(k, "".join(r.choice(PARTS) + r.choice([" ", "", ", "]) for _ in range(r.randrange(9)))) for k in range(150)] + [(500, None)]
    docs, names = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(NAMES, "name_id long, name string")
    for choice, plain in (("longest", literal_longest), ("leftmost", literal_left)):
        got = {(x.doc, x.start, x.end, x.name_id) for x in trie.name_matches(docs, names, choice, "literal").collect()}
        assert got == {(k, *m) for k, t in texts if t for m in plain(t, NAMES)}, choice
    streets = {(x.doc, x.start, x.end, x.name_id) for x in places.street_matches(docs, names.unionByName(spark.createDataFrame([(99, " bach ")], "name_id long, name string"))).collect()}
    assert streets == {(k, *m) for k, t in texts if t for m in literal_left(t, NAMES)}


def test_names_that_are_dealt_give_the_same(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    names = [(k, " ".join(r.choices(words, k=r.randrange(1, 4)))) for k in range(60)]
    texts = [(k, " ".join(r.choices(words, k=40))) for k in range(50)]
    docs, known = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(names, "name_id long, name string")
    want = sorted(tuple(x) for x in trie.name_matches(docs, known, "longest").collect())
    monkeypatch.setattr(trie, "NAMES_AT_ONCE", 25)
    monkeypatch.setattr(trie, "TEXTS_AT_ONCE", 20)
    assert sorted(tuple(x) for x in trie.name_matches(docs, known, "longest").collect()) == want
    assert len(want) > 500


def test_many_matches_in_one_text_take_no_square_of_time(spark):
    root = trie.trie([(0, "a b"), (1, "b a b"), (2, "a")])
    text = "a b " * 40_000
    start = time.perf_counter()
    kept = trie.longest_first(trie.matches(text, root))
    assert time.perf_counter() - start < 5
    assert len(kept) > 30_000


# --- tables and graphs -----------------------------------------------------------------------------


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "doc long, chunk_index int, text string"
    chunks.store_chunks(spark.createDataFrame([(k, 0, f"t{k}") for k in range(60)], schema), path, buckets=8)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "chunks").glob("bucket=*/*.parquet")}
    before = files()
    chunks.store_chunks(spark.createDataFrame([(7, 0, "new"), (7, 1, "more"), (99, 0, "first")], schema), path, buckets=8)
    after = files()
    touched = {p.parent for p in after.keys() ^ before.keys()}
    assert 1 <= len(touched) <= 2 and all(after[p] == before[p] for p in before.keys() & after.keys()) and len({p.parent for p in before} - touched) >= 6
    got = sorted((r.doc, r.chunk_index, r.text) for r in spark.read.parquet(path).collect())
    assert got == sorted([(k, 0, f"t{k}") for k in range(60) if k != 7] + [(7, 0, "new"), (7, 1, "more"), (99, 0, "first")])


def test_rounds_expand_each_node_once(spark):
    edges = [("m_1", "a_1", "item"), ("m_1", "a_2", "item"), ("a_1", "c_1", "heard"), ("c_1", "p_1", "paper"), ("p_1", "f_1", "file"), ("p_1", "a_2", "back"), ("a_1", "o_1", "by"), ("o_1", "x_1", "by"), ("f_1", "z_1", "far"), ("m_2", "a_9", "item")]
    graph_ = spark.createDataFrame(edges, "source string, target string, relation string")
    seeds = spark.createDataFrame([("m_1",), ("m_2",), ("m_3",)], "node string")
    nodes, found = graph.expanded_in_rounds(seeds, graph_, ["a", "c", "p"], skip=["o"])
    assert {(r.seed, r.node, r.round) for r in nodes.collect()} == {("m_1", "m_1", 0), ("m_1", "a_1", 0), ("m_1", "a_2", 0), ("m_1", "c_1", 1), ("m_1", "p_1", 1), ("m_1", "f_1", 3), ("m_2", "m_2", 0), ("m_2", "a_9", 0), ("m_3", "m_3", 0)}
    assert {tuple(r)[1:3] for r in found.where("seed = 'm_1'").collect()} == {e[:2] for e in edges if not {"o_1", "z_1", "m_2"} & set(e)}
    # a limit of one neighbour of a relation
    assert {r.node for r in graph.expanded_in_rounds(seeds.where("node = 'm_1'"), graph_, [], per_relation=1)[0].collect()} == {"m_1", "a_1"}


def test_documents_that_hold_all_terms(spark, monkeypatch):
    monkeypatch.setattr(graph, "TERMS_AT_ONCE", 2)
    docs = spark.createDataFrame([(1, "The Old Bridge"), (2, "bridges of olden times"), (3, None), (4, "")], "doc long, text string")
    asked = spark.createDataFrame([(1, "old"), (1, "BRIDGE"), (2, "bridge"), (2, "of"), (3, "of"), (4, "times"), (4, "olden"), (4, "bridges"), (5, "nowhere")], "question long, term string")
    assert {tuple(r) for r in graph.holding_all_terms(docs, asked).collect()} == {(1, 1), (2, 1), (1, 2), (2, 2), (2, 4)}


def test_candidates_say_what_found_them(spark):
    ranked = lambda rows, more="": spark.createDataFrame(rows, f"query_id long, key string, rank int{more}")
    recalls = [("File", "lexical", ranked([(1, "a", 1), (1, "b", 2)])), ("File", "content", ranked([(1, "b", 1, 0.12345, 3), (1, "c", 2, 0.5, 0)], ", distance double, chunk int")), ("Paper", "name", ranked([(1, "a", 1, 0.25), (1, "q", 2, 0.3), (1, "gone", 3, 0.3)], ", distance double"))]
    names = {"File": spark.createDataFrame([("a", "A")], "key string, name string"), "Paper": spark.createDataFrame([("a", "PA"), ("gone", "G")], "key string, name string")}
    required = {"Paper": spark.createDataFrame([("a",), ("q",)], "key string")}
    got = {r.id: (r.name, r.score, tuple(r.signals)) for r in ranking.fused_candidates(recalls, names, required).collect()}
    assert got == {"File_a": ("A", round(1 / 61, 5), (True, None, None, None)), "File_b": (None, round(1 / 62 + 1 / 61, 5), (True, None, 0.1235, 3)), "File_c": (None, round(1 / 62, 5), (None, None, 0.5, None)), "Paper_a": ("PA", round(1 / 61, 5), (None, 0.25, None, None))}
