"""Text functions and operators on small hand-made inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import chunks, filters, graph, pairs, places, quality, ranking, tags, timeline


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


def test_trigrams_and_similarity(spark):
    assert sorted(one(spark, tx.trigrams(F.col("a")), a="Cat")) == ["  c", " ca", "at ", "cat"]
    assert one(spark, tx.trigram_similarity(F.col("a"), F.col("b")), a="word", b="words") == pytest.approx(4 / 7)
    assert one(spark, tx.trigram_similarity(F.col("a"), F.col("b")), a="", b="") == 0
    assert one(spark, tx.word_similarity(F.col("a"), F.col("b")), a="Südquartier", b="alles über Südquartier heute") == 1


def test_cosine(spark):
    assert one(spark, tx.cosine_similarity(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, tx.cosine_similarity(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0


@pytest.mark.parametrize(("text", "day"), [("2024-03-05T10:11:12+02:00", "2024-03-05 10:11:12"), ("2024-03-05T10:11:12.500Z", "2024-03-05 10:11:12"), ("2024-03-05 10:11:12", None), ("5.3.2024", "2024-03-05 00:00:00"), ("31.02.2024", None), ("2024-03-05", "2024-03-05 00:00:00"), ("05.03.2024", "2024-03-05 00:00:00"), ("soon", None), (None, None)])
def test_moments(spark, text, day):
    got = one(spark, tx.parse_moment(F.col("a")), a=text)
    assert got == (dt.datetime.fromisoformat(day) if day else None)


@pytest.mark.parametrize(
    ("text", "day"),
    [("am 05.03.2024 war", dt.date(2024, 3, 5)), ("am 5.3.2024 war", None), ("on 7 May 2021 we", dt.date(2021, 5, 7)), ("16:54 21 oct 2025", dt.date(2025, 10, 21)), ("01.02.2003 7 September 2021", dt.date(2021, 9, 7)), ("2001-01-01, 05.03.2024", dt.date(2024, 3, 5)), ("x 2020-01-02 y", dt.date(2020, 1, 2)), ("31 Feb 2020 2020-01-02", None), ("y" * 1200 + "2020-01-02", None), ("none", None)],
)
def test_dates_in_text(spark, text, day):
    assert one(spark, tx.date_in_text(F.col("a")), a=text) == day


BALLOT = ("Ja", "Nein", "Enthaltung")
ITEM, SECTION = r"(?i)Punkt\s*([0-9]+)\s*der Tagesordnung", r"(?is)Beschluss:?\s*\n+([^\n]+)"


@pytest.mark.parametrize(("text", "count"), [("Ja: 3\nNein: 4\nJa | 21", 21), ("nothing", None), ("## JA\n45", 45), ("| ## ja | | 45 |", 45), ("Ja Nein 5", 5), ("Nein Ja 5", None), ("Ja" + " " * 41 + "5", None), ("Ja 1234", None), ("Jahr 5", None)])
def test_ballot_counts(spark, text, count):
    assert one(spark, tx.count_after(F.col("a"), "Ja", BALLOT), a=text) == count


def test_ballots(spark):
    sides = {"zugestimmt": "accepted", "abgelehnt": "rejected"}
    check = lambda yes, no, stated: one(spark, tx.outcome_check(tx.majority(F.lit(yes), F.lit(no)), F.col("a"), sides), a=stated)
    assert check(3, 1, "abgelehnt") == "warn" and check(3, 1, "zugestimmt") == "ok" and check(1, 3, "abgelehnt") == "ok"
    assert check(5, 5, "abgelehnt") == "n/a" and check(3, 1, "vertagt") == "n/a" and check(3, 1, None) == "n/a"


@pytest.mark.parametrize(
    ("text", "outcome"),
    [("abgelehnt? Nein. Beschluss:\nzugestimmt.", "accepted"), ("abgelehnt. Beschluss:\nohne Worte", None), ("abgelehnt Punkt 3 der Tagesordnung zugestimmt", "accepted"), ("Punkt 3 der Tagesordnung" + " " * 2000 + "zugestimmt", None), ("ohne Punkt abgelehnten", "rejected"), ("x" * 1200 + " abgelehnt", None), ("unabgelehnt", None)],
)
def test_decisions(spark, text, outcome):
    rules = [(tx.spoken_outcome("abgelehnt"), "rejected"), (tx.spoken_outcome("zugestimmt"), "accepted")]
    assert one(spark, tx.decision(F.col("a"), SECTION, rules, ITEM), a=text) == outcome


def test_items_of_protocols(spark):
    top = lambda text, number: one(spark, tx.item_verified(F.col("a"), F.col("b"), F.lit("x"), F.lit("x"), ITEM)[0], a=text, b=number)
    assert top("Punkt 1 der Tagesordnung", "1") and not top("Punkt 12 der Tagesordnung", "1") and top("Punkt 12 der Tagesordnung", None)
    assert not top("Punkt 2 der Tagesordnung, Punkt 1 der Tagesordnung", "1") and not top("nichts", None)


def test_pair_confidence(spark):
    types, results = [("antrag", "motion")], [("zugestimmt", "accepted")]
    told = lambda kind, result, role, decisive: tuple(one(spark, pairs.classify(F.col("a"), F.col("b"), F.col("c"), F.lit(decisive), types, results), a=kind, b=result, c=role))
    assert told(" Antrag", "wird zugestimmt", "berät", True) == ("motion", "accepted", 1.0, "db-column")
    assert told("Antrag", "unklar", "berät", False) == ("motion", None, 0.7, "db-partial")
    assert told("Antrag", None, "berät", True) == ("motion", None, 0.7, "db-partial")
    assert told("Antrag", None, None, True) == ("motion", None, 0.5, "db-partial")
    assert told("Brief", "wird zugestimmt", "berät", True) == (None, None, 0.0, "column")


@pytest.mark.parametrize(
    ("text", "only"),
    [("Büro: Gartenstraße 21, 12345 Musterstadt", True), ("gartenstraße 13\n12345 Musterstadt", True), ("Gartenstraße 12-14 12345 Musterstadt", True), ("Gartenstraße 3 a / 5 b · 12345 Musterstadt", True), ("Gartenstraße 21, 12345 Anderswo", False), ("Gartenstraße 21, 12345 Musterstadt. Umbau der Gartenstraße", False), ("nichts", False), (None, False)],
)
def test_address_only(spark, text, only):
    assert one(spark, tx.only_as_address(F.col("a"), "Gartenstraße", "Musterstadt"), a=text) is only
    assert one(spark, tx.only_as_address(F.col("a"), "St. Georg (Süd)", "Musterstadt"), a="St. Georg (Süd) 5, 12345 Musterstadt") is True


@pytest.mark.parametrize(("name", "want"), [("sechs", "…" + "x" * 54 + " SECHS " + "y" * 4 + "…"), ("nie", None), (" ", None), ("chs", None)])
def test_excerpts(spark, name, want):
    assert one(spark, tx.excerpt(F.col("a"), F.col("b")), a="Sechser " + "x" * 59 + " SECHS\n" + "y" * 4 + " ", b=name) == (want.replace("x" * 54, "x" * 59) if want else None)


@pytest.mark.parametrize(("query", "ok"), [("x" * 251, False), (" " + "x" * 250 + "  ", True), ("a<b", False), ("   ", False), ("", False), (None, False), ("[a] {b} „c“ «d» @ # = _ | ~ ° $ € * ’ `", True), ("größe 5½ 世界", True), ("a\u200bb", False), ("🙂", False), ("a\nb", True)])
def test_allowed_queries(spark, query, ok):
    assert one(spark, tx.allowed_query(F.col("a")), a=query) is ok


def test_teasers(spark):
    told = lambda text, summary=None: one(spark, tx.teaser(F.col("a"), F.col("b"), words=3, excerpt_length=7, ceiling=20), a=text, b=summary)
    assert told("a\nb  c") == "a b  c" and told(None) == "" and told("x" * 30) == "x" * 20
    assert told("a b\nc d e") == "a b c d" and told("a b c d", "one") == "a b c d" and told("a b c d", "one two\nthree four") == "one two three" and told("a b c d", "one\ntwo") == "one\ntwo"


@pytest.mark.parametrize(("path", "parts"), [("a/b/C-d_e.x.PDF", ("b", "C-d_e.x.PDF", "pdf", "C-d_e.x", "C")), ("a\\b\\c", ("b", "c", "", "c", "c")), ("c.", ("", "c.", "", "c", "c")), ("", ("", "", "", "", ""))])
def test_path_parts(spark, path, parts):
    assert tuple(spark.createDataFrame([(path,)], "a string").select(*tx.path_parts(F.col("a"))).first()) == parts


@pytest.mark.parametrize(("text", "want"), [("Haushalt THH 1100", ("Haushalt", "1100")), (" haushalt 123 ", ("Haushalt", "123")), ("Haushalt 12", ("Haushalt", None)), ("Haushaltsrede", ("Haushaltsrede", None)), ("Antrag", ("Antrag", None)), (" ", (None, None)), (None, (None, None))])
def test_folded_types(spark, text, want):
    kind, code = tx.folded_type(F.col("a"), [("Haushalt", r"^Haushalt\b", r"^Haushalt\s+(?:THH\s+)?([0-9]{3,4})$")])
    assert (one(spark, kind, a=text), one(spark, code, a=text)) == want


def test_eras(spark):
    rules = [("Green", "G1", [(None, "2000-01-01"), ("2005-01-01", "2005-12-31")]), ("Green", "G2", [("2000-01-02", None)]), ("green", "any", None)]
    at = lambda day, text: one(spark, tx.valid_at(F.lit(day).cast("date"), rules, F.col("a")), a=text)
    assert [at(d, "the Greens") for d in ("1999-01-01", "2005-06-01", "2006-01-01", None)] == ["G1", "G1", "G2", None]
    assert at(None, "green") == "any" and at("1999-01-01", "blue") is None


def test_noise_and_keys(spark):
    assert one(spark, tx.without_noise(F.col("a"), [r"hall \d"]), a="in Hall 5now") == "in now"
    assert one(spark, tx.column_name(F.col("a")), a="") == "k"


def test_unicode_boundaries(spark):
    assert one(spark, tx.any_match(F.col("a"), [r"\bänderungsantrag"]), a="ein Änderungsantrag") is True
    assert one(spark, tx.strip_terms(F.col("a"), ["Antrag"]), a="Änderungsantrag zum  Antrag") == "Änderungsantrag zum"


def test_small_text_rules(spark):
    assert one(spark, tx.column_name(F.col("a")), a="start") == "start_date" and one(spark, tx.column_name(F.col("a")), a="1 x") == "k_1_x"
    assert one(spark, tx.file_key(F.col("a")), a="00012.pdf") == "12"
    assert one(spark, tx.has_anaphora(F.col("a"), ["it", "that"]), a="what about it") is True
    assert one(spark, tx.has_anaphora(F.col("a"), ["it", "that"]), a="it Musterstadt") is False


def test_filter_specs():
    good = [{"facet": "year", "op": "range", "from": "2021", "to": "2022", "basis": "meeting"}, {"facet": "tag", "scheme": "topic", "op": "in", "values": ["a"]}, {"facet": "authoritative", "op": "eq", "value": False}]
    assert filters.validate(good) == good and filters.validate(None) == []
    assert filters.validate([{"facet": "role", "values": [1]}]) == [{"facet": "role", "op": "in", "values": ["1"]}]
    assert filters.validate([{"facet": "year", "op": "range", "from": 2020}]) == [{"facet": "year", "op": "range", "from": 2020, "to": None, "basis": "paper"}]
    for bad in ({"facet": "tag", "values": ["a"]}, {"facet": "organization", "op": "eq", "value": "x"}, {"facet": "role", "op": "range", "from": 1}, "text", {"facet": "x", "op": "in", "values": ["a"]}, {"facet": "tag", "op": "eq", "value": True}, {"facet": "tag", "op": "in", "values": []}, {"facet": "year", "op": "range"}, {"facet": "authoritative", "op": "eq"}, {"facet": "year", "op": "range", "from": 1, "basis": "moon"}):
        with pytest.raises(filters.FilterError):
            filters.validate([bad])


def test_fusion(spark):
    rows = spark.createDataFrame([("x", 1, "a", 1), ("x", 1, "b", 2), ("y", 1, "b", 1), ("y", 1, "c", 2)], "signal string, query_id int, key string, rank int")
    got = {r.key: (r.score, r.signals) for r in ranking.fuse(rows).collect()}
    assert got["b"] == (pytest.approx(1 / 61 + 1 / 62, abs=1e-8), "x,y") and got["a"][0] == pytest.approx(1 / 61, abs=1e-8)


def test_gap_groups(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day), (2, day + dt.timedelta(days=30, hours=23, minutes=59, seconds=59)), (3, day + dt.timedelta(days=61, hours=23, minutes=59, seconds=59)), (4, day + dt.timedelta(days=92))]
    got = timeline.gap_groups(spark.createDataFrame(rows, "id int, ts timestamp").withColumn("o", F.lit(1)), ["o"], "ts", "id").orderBy("id").collect()
    assert [r.group_no for r in got] == [1, 1, 2, 2]


def test_chunks_are_gapless_and_bounded(spark):
    text = "".join(f"# part {i}\n" + "line of words\n" * (i * 97 % 400) for i in range(12)) + "y" * 9000 + "\nend"
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, "x" * 8001)], "doc int, text string")
    rows = chunks.chunk(docs).orderBy("doc", "chunk_index").collect()
    for doc, whole in ((1, text), (2, "short"), (3, ""), (4, "x" * 8001)):
        own = [r for r in rows if r.doc == doc]
        assert "".join(r.text for r in own) == whole
        assert all(a.char_end == b.char_start for a, b in zip(own, own[1:], strict=False)) and own[0].char_start == 0 and own[-1].char_end == len(whole)
        assert all(whole[r.char_start : r.char_end] == r.text for r in own)
        assert all(len(r.text) <= 8000 or "\n" not in r.text[:-1] for r in own)
    assert [r.chunk_index for r in rows if r.doc == 2] == [0] and min(r.chunk_index for r in rows if r.doc == 1) == 1


def test_similar_words_match_all_pairs(spark):
    words = ["haus", "hause", "hausen", "maus", "abc", "abd", "bcd", "strasse", "strasze", "straße", "antrag", "antrags", "anträge", "x", "lorem", "loremx"]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d2 = [i + 1]
            for j, y in enumerate(b):
                d2.append(min(d2[-1] + 1, d[j + 1] + 1, d[j] + (x != y)))
            d = d2
        return d[-1]

    want = {(a, b) for a in words for b in words if a < b and min(len(a), len(b)) >= 3 and round(1 - distance(a, b) / max(len(a), len(b)), 6) >= 0.8}
    got = {(r.a, r.b) for r in chunks.similar_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == want


def test_word_clusters_are_greedy(spark):
    rows = [("haus", 5.0), ("hause", 4.0), ("hausen", 3.0), ("tor", 1.0)]
    got = {r.word: r.representative for r in chunks.word_clusters(spark.createDataFrame(rows, "word string, tfidf double")).collect()}
    assert got == {"haus": "haus", "hause": "haus", "hausen": "hausen", "tor": "tor"}


def test_places(spark):
    docs = spark.createDataFrame([(1, "In der Südquartier und der Neuen Südquartier Mitte"), (2, "Obersüdquartier")], "doc int, text string")
    names = spark.createDataFrame([(1, "Südquartier"), (2, "Neuen Südquartier"), (3, "Südquartier Mitte")], "name_id int, name string")
    got = sorted((r.doc, r.name) for r in places.longest_only(places.dictionary_matches(docs, names)).collect())
    assert got == [(1, "Neuen Südquartier"), (1, "Südquartier")]


def test_pairs(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, w string")
    assert sorted(map(tuple, pairs.merge_keep(old, new, "k").collect())) == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    said = spark.createDataFrame([(1, "request", {"cost": "5", "bad": "?"}), (1, "response", {"ok": "1"})], "pair int, stage string, fields map<string,string>").withColumn("flagged", F.lit(None).cast("map<string,string>"))
    flagged = pairs.flag_fields(said, ["bad"])
    assert pairs.grounding(flagged).first().request == {"cost": "5"}
    names = spark.createDataFrame([("Protokoll 05.03.2024 TOP 4.1",), ("ohne",)], "name string")
    registry = spark.createDataFrame([(dt.date(2024, 3, 5), "4.1", 7)], "date date, number string, item int")
    assert [r.item for r in pairs.registry_join(names, registry).collect()] == [7]


def test_tags(spark):
    have = spark.createDataFrame([("i", "t", "s", "rule", 0.5)], "item string, tag string, scheme string, source string, confidence double")
    new = spark.createDataFrame([("i", "t", "s", "model", 0.9), ("i", "u", "s", "model", 0.4), ("i", "u", "s", "model", 0.8), ("j", "v", "s", "guess", 0.1), ("j", "v", "s", "rule", 1.5)], have.schema)
    kept, rejected = tags.assign(have, new)
    assert sorted((r.tag, r.confidence) for r in kept.collect()) == [("t", 0.5), ("u", 0.8)] and rejected.count() == 2
    good, bad = tags.within_vocabulary(spark.createDataFrame([("a", "x"), ("a", "y")], "tag string, qualifier string"), spark.createDataFrame([("a", "x")], "tag string, qualifier string"))
    assert (good.count(), bad.count()) == (1, 1)


def test_graph_merge_and_triples(spark):
    n1, n2 = spark.createDataFrame([("a", "first")], "id string, name string"), spark.createDataFrame([("a", "second"), ("b", "b")], "id string, name string")
    e = spark.createDataFrame([("a", "b", "r")], "source string, target string, relation string")
    nodes, edges = graph.merge_graphs([(n1, e), (n2, e)])
    assert {r.id: r.name for r in nodes.collect()} == {"a": "first", "b": "b"} and edges.count() == 1
    triples = spark.createDataFrame([("x", None), (None, "y"), ("x", "y"), (None, None)], "object_literal string, object_ref string")
    assert graph.valid_triples(triples).count() == 2


def test_chunk_report(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc int")
    have = spark.createDataFrame([(1, 0), (1, 1)], "doc int, chunk_index int")
    vectors = spark.createDataFrame([(1, 0), (3, 0)], "doc int, chunk_index int")
    assert {r.finding: r.n for r in quality.chunk_report(docs, have, vectors).collect()} == {"documents without chunks": 1, "chunks without vector": 1, "vectors without chunk": 1}
