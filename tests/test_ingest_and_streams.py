"""JSON entities to tables, and the streaming forms."""

from __future__ import annotations

import datetime as dt
import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from civicspark.operators import pairs
from civicspark.sources import entities, nested
from civicspark.streaming import incremental

BASE = "https://x.org/schema/"


def write(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_entities(spark, tmp_path):
    meeting = {"id": "https://x/m/1", "type": BASE + "Meeting", "name": "M", "start": "2024-01-02T10:00:00+01:00", "organization": ["https://x/o/1", "https://x/o/2"], "size": 3, "open": True, "location": {"id": "https://x/l/9", "type": BASE + "Location", "room": "R", "deep": [[{"x": {"y": [{"id": "https://x/l/10", "type": BASE + "Location", "z": {"id": "no type"}}]}}]]}}
    write(tmp_path, "a.json", meeting)
    write(tmp_path, "b.json", {"id": "https://x/o/1", "type": BASE + "Organization", "name": "O1"})
    write(tmp_path, "c.json", {"id": "https://x/o/2", "type": BASE + "Organization", "name": "O2"})
    write(tmp_path, "d.json", "{broken")
    docs, rejects = entities.read_folder(spark, str(tmp_path))
    assert rejects.count() == 1
    found = nested.flatten(docs)
    assert sorted((r.type, r.key) for r in found.collect()) == [("Location", "10"), ("Location", "9"), ("Meeting", "1"), ("Organization", "1"), ("Organization", "2")]
    assert {r.key: r.parent for r in found.collect()}["9"] == "https://x/m/1"
    assert {r.key: (r.parent, r.field) for r in found.collect()}["10"] == ("https://x/l/9", "y")
    values = entities.fields(found).persist()
    links = {(r.type, r.field): (r.target_type, r.many) for r in entities.relations(values, found).where("field <> 'id'").collect()}
    assert links == {("Meeting", "organization"): ("Organization", True), ("Meeting", "location"): ("Location", False)}
    kinds = {(r.type, r.column): r.kind for r in entities.column_types(values).collect()}
    assert kinds[("Meeting", "start_date")] == "timestamp_ntz" and kinds[("Meeting", "size")] == "bigint" and kinds[("Meeting", "open")] == "boolean" and kinds[("Meeting", "name")] == "string"
    ids = found.select("id", F.xxhash64("id").alias("sid"))
    assert entities.associations(values, ids, "organization").count() == 2
    assert entities.foreign_keys(values, ids, "location").where("location_sid is not null").count() == 1


def test_upsert_and_evolution(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    stored = spark.createDataFrame([("a", day(5), "old"), ("b", day(5), "old"), ("c", day(5), "old")], "id string, modified timestamp, v string")
    new = spark.createDataFrame([("a", day(6), "new", 1), ("b", day(4), "late", 1), ("c", None, "undated", 1), ("d", day(1), "first", 1), ("d", day(2), "second", 1)], "id string, modified timestamp, v string, extra int")
    got = {r.id: (r.v, r.extra) for r in entities.upsert(stored, new).collect()}
    assert got == {"a": ("new", 1), "b": ("old", None), "c": ("undated", 1), "d": ("second", 1)}


def test_street_register(spark):
    text = "Am Bach, vor 1900\nA brook.\nmore## 1875 Lindenallee## Gartenstraße nach 1920\nGardens## Alter Weg im 18. Jahrhundert## 1999## Neue Straße, um 1950\n## Kanal 1907 "
    rows = entities.street_register(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r.name, r.year, r.description) for r in rows] == [("Am Bach", 1900, "A brook."), ("Lindenallee", 1875, ""), ("Gartenstraße", 1920, "Gardens"), ("Alter Weg im", -1, ""), ("Neue Straße", 1950, ""), ("Kanal", 1907, "")]


def test_baseline(spark):
    runs = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 1)), (dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1), None)], "started timestamp, baseline timestamp, end_state timestamp")
    assert incremental.baseline(runs).first().baseline == dt.datetime(2024, 1, 1)
    assert incremental.baseline(runs.limit(0)).first().baseline == dt.datetime(1970, 1, 1)


def test_import_stream_rewrites_touched_ranges_only(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "id string, modified timestamp, v string"
    run = lambda: incremental.import_stream(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "state"), str(tmp_path / "check"), ranges=8).awaitTermination()
    state = lambda: {r.id: r.v for r in incremental.imported(spark, str(tmp_path / "state")).collect()}
    ranges = lambda n: {p.name for p in (tmp_path / "state" / "data" / f"version={n}").glob("range=*")}
    write(source, "1.json", "\n".join(json.dumps({"id": f"k{k}", "modified": "2024-01-02", "v": "new"}) for k in range(40)))
    run()
    assert len(ranges(0)) == 8
    write(source, "2.json", '{"id": "k1", "modified": "2024-01-01", "v": "late"}\n{"id": "k2", "modified": "2024-01-03", "v": "newer"}\n{"id": "k3", "v": "undated"}')
    run()
    want = {f"k{k}": "new" for k in range(40)} | {"k2": "newer", "k3": "undated"}
    assert state() == want and 1 <= len(ranges(1)) <= 3 and len(ranges(0)) == 8  # what was replaced stays for one batch
    write(source, "3.json", '{"id": "k2", "modified": "2024-01-04", "v": "newest"}')
    run()
    assert state() == want | {"k2": "newest"} and len(ranges(0)) == 8 - len(ranges(1)) and len(ranges(2)) == 1


def test_a_batch_that_failed_or_runs_again(spark, tmp_path):
    """Data without a manifest is not seen, and a batch that is run again starts from the manifest before it."""
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    run = lambda: incremental.import_stream(spark.readStream.schema("id string, modified timestamp, v string").json(str(source)), str(state), str(tmp_path / "check"), ranges=2).awaitTermination()
    write(source, "1.json", '{"id": "a", "modified": "2024-01-01", "v": "1"}')
    run()
    write(source, "2.json", '{"id": "a", "modified": "2024-01-02", "v": "2"}\n{"id": "b", "modified": "2024-01-01", "v": "1"}')
    run()
    shutil.rmtree(state / "manifest" / "batch=1")  # as if the second batch had died before its commit
    assert {r.id: r.v for r in incremental.imported(spark, str(state)).collect()} == {"a": "1"}
    (tmp_path / "check" / "commits" / "1").unlink()
    for crc in (tmp_path / "check" / "commits").glob(".1.crc"):
        crc.unlink()
    run()
    assert {r.id: r.v for r in incremental.imported(spark, str(state)).collect()} == {"a": "2", "b": "1"}


def test_ladder_of_reads(spark, tmp_path):
    base = dt.datetime(2024, 1, 2)
    rows = [("2024-01-02T01:00:00+02:00", "2024-01-05T00:00:00Z"), ("2024-01-03T00:00:00", "2024-01-05T00:00:00Z"), ("soon", None), (None, None)]
    items = spark.createDataFrame(rows, "modified string, created string")
    read = lambda df: lambda: df
    steps = lambda a, b: [("modified", read(a)), ("created", read(b)), ("full", read(items))]
    honest = items.where("modified is null or modified > '2024-01-03'")
    assert incremental.ladder(steps(honest, items), base, str(tmp_path / "a"))[1] == "modified"
    got, mode = incremental.ladder(steps(items, items), base, str(tmp_path / "b"))  # 01:00+02:00 is the day before
    assert mode == "created" and got.count() == 4
    old = items.withColumn("created", F.lit("2023-01-01"))
    assert incremental.ladder(steps(items, old), base, str(tmp_path / "c"))[1] == "full"
    assert incremental.high_water(items, "modified", F.lit(base)).first().mark == dt.datetime(2024, 1, 3)
    assert incremental.high_water(items.limit(0), "modified", F.lit(base)).first().mark == base


def test_session_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts").orderBy("ts").limit(300)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.sessions(stream, "user_id", "ts", gap="6 hours", late="0 seconds").writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted((r.user_id, str(r.start), str(r.end), r.n) for r in df.collect())
    assert rows(spark.table("sessions_out")) == rows(incremental.sessions(events, "user_id", "ts", gap="6 hours"))


def test_thread_state(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, t, f" q{t} ", t != 3) for t in range(7)] + [(2, 0, "x" * 240, True), (2, 1, "<no>", True), (2, 2, "", True), (2, 3, "y" * 240, True), (2, 4, "z" * 240, True), (2, 5, "w" * 240, True)]
    for part in (lambda r: r[1] < 4, lambda r: r[1] >= 4):
        own.createDataFrame([r for r in rows if part(r)], "conv_id long, turn long, text string, followup boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema("conv_id long, turn long, text string, followup boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.thread_state(stream).writeStream.format("memory").queryName("threads_out").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.conv_id, r.turn): (r.query, r.concatenated, r.turns, r.forced_break) for r in own.table("threads_out").collect()}
    assert got[1, 0] == ("q0", False, 1, False) and got[1, 2] == ("q0 · q1 · q2", True, 3, False) and got[1, 3] == ("q3", False, 4, False)
    assert got[1, 4] == ("q0 · q1 · q2 · q3 · q4", True, 5, False) and got[1, 5] == ("q5", False, 1, True) and got[1, 6] == ("q5 · q6", True, 2, False)
    assert sorted(k for k in got if k[0] == 2) == [(2, 0), (2, 3), (2, 4), (2, 5)]  # refused turns leave no trace
    assert got[2, 5][0] == " · ".join(["x" * 240, "y" * 240, "z" * 240, "w" * 240])[-750:]


def test_idle_threads_are_forgotten(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, source = "conv_id long, turn long, text string, followup boolean", tmp_path / "in"
    source.mkdir()
    stream = incremental.thread_state(own.readStream.schema(schema).json(str(source)), idle_ms=500)
    q = stream.writeStream.format("memory").queryName("idle_out").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    got = lambda: {r.turn: (r.query, r.turns) for r in own.table("idle_out").collect()}

    def until(done):
        end = time.monotonic() + 40
        while not done() and time.monotonic() < end:
            time.sleep(0.3)

    try:
        write(source, "1.json", '{"conv_id": 1, "turn": 0, "text": "first", "followup": false}')
        until(lambda: 0 in got())
        time.sleep(4)  # the timer goes off in a later batch
        write(source, "2.json", '{"conv_id": 1, "turn": 1, "text": "second", "followup": true}')
        until(lambda: 1 in got())
        assert got() == {0: ("first", 1), 1: ("second", 1)}
    finally:
        q.stop()


def test_gazetteer_and_outputs_by_name(spark, tmp_path):
    names = spark.createDataFrame([("Nord",), ("Süd",), ("West",)], "name string")
    shapes = spark.createDataFrame([("Nord", "POINT"), ("West", "AREA")], "name string, geo string")
    new = entities.gazetteer(names, shapes, names.where("name = 'West'"))
    assert sorted((r.name, r.geo) for r in new.collect()) == [("Nord", "POINT"), ("Süd", None)]
    entities.write_by(new, "name", str(tmp_path / "by"), "json")
    assert len([p for p in (tmp_path / "by").iterdir() if p.is_dir()]) == 2
    assert spark.read.json(str(tmp_path / "by")).count() == 2


def test_mandate_holders_by_party(spark, tmp_path):
    people = spark.createDataFrame([("A", "x", "Stadtrat"), ("A", "w", "Stadtrat"), ("B", None, "Stadtrat"), ("C", "x", "Gast"), ("D", "x", "BÜRGERMEISTER")], "name string, party string, role string")
    held = entities.mandate_holders(people, ["stadtr", "bürgermeister"])
    assert sorted((r.name, r.party) for r in held.collect()) == [("A", "w"), ("D", "x")]
    assert entities.mandate_holders(people.limit(0), ["stadtr"]).count() == 0
    entities.write_by(held, "party", str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out" / "party=w")).count() == 1


def test_facet_stream_refreshes_by_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: incremental.facet_stream(spark.readStream.schema("kind string, year long").json(str(source)), ["kind", "year"], str(tmp_path / "facets"), str(tmp_path / "check")).awaitTermination()
    write(source, "1.json", '{"kind": "a", "year": 2024}\n{"kind": "b"}')
    run()
    write(source, "2.json", '{"kind": "a", "year": 2023}')
    run()
    rows = lambda n: {(r.facet, r.value): r.n for r in spark.read.parquet(str(tmp_path / "facets" / f"version={n}")).collect()}
    assert rows(0) == {("kind", "a"): 1, ("kind", "b"): 1, ("year", "2024"): 1}
    assert rows(1) == {("kind", "a"): 2, ("kind", "b"): 1, ("year", "2024"): 1, ("year", "2023"): 1}


def test_signal_priority_takes_plain_words_only(spark):
    pairs.register_signal_priority(spark, ["agenda", "minutes"])
    assert [r[0] for r in spark.sql("SELECT signal_priority(s) FROM VALUES ('minutes'), ('agenda'), ('x'), (NULL) AS t(s)").collect()] == [1, 0, 2, 2]
    with pytest.raises(ValueError):
        pairs.register_signal_priority(spark, ["a' THEN 1"])


def test_leaves_links_and_files_at_any_depth(spark):
    deep: object = {"downloadUrl": "http://a/b.PDF?x=1", "fileName": "B"}
    for k in range(3000):
        deep = [deep] if k % 2 else {"k": deep}
    body = {"id": "https://x/1", "type": "https://s/Paper/", "date": "2024-03-05T00", "startDate": "2024", "n": [1, True, None, 2.5], "text": "see https://in.text/a.pdf now", "files": ["https://a/c.docx", "http://www.a/d.txt?q=1", {"u": "x.pdf", "fileName": ""}], "dot": "/a.b/.pdf"}
    rows = [(1, json.dumps(body)), (2, json.dumps(deep)), (3, "{broken"), (4, None), (5, '"http://just.a/string"'), (6, "[]")]
    docs = spark.createDataFrame(rows, "doc long, body string")
    got = {(r.path, r.kind, r.value, r.listed) for r in nested.leaves(docs.where("doc = 1")).collect()}
    assert ("$.n[1]", "boolean", "true", True) in got and ("$.n[2]", "null", None, True) in got and ("$.files[2].u", "string", "x.pdf", False) in got
    assert {(r.doc, r.link) for r in nested.links(docs).collect()} == {(1, "https://x/1"), (1, "https://s/Paper/"), (1, "https://a/c.docx"), (1, "http://www.a/d.txt?q=1"), (2, "http://a/b.PDF?x=1"), (5, "http://just.a/string")}
    assert {(r.doc, r.url, r.filename, r.file_type) for r in nested.file_references(docs, ["pdf", "docx"]).collect()} == {(1, "https://a/c.docx", "c.docx", "docx"), (1, "x.pdf", "x.pdf", "pdf"), (2, "http://a/b.PDF?x=1", "B", "pdf")}
    fixed = {r.doc: r.body for r in nested.rewritten(docs, [("^http:", "https:"), (r"//www\.", "//")]).collect()}
    assert fixed.keys() == {1, 2, 5, 6} and json.loads(fixed[1])["files"][1] == "https://a/d.txt?q=1" and json.loads(fixed[1])["text"] == body["text"] and fixed[5] == '"https://just.a/string"'
    assert tuple(docs.where("doc = 1").select(nested.resource_date(F.col("body")), nested.resource_type(F.col("body"))).first()) == ("2024-03-05", "Paper")
