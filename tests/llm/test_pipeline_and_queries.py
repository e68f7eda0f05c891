"""The pipeline's stages, the registered queries and their SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from civicspark.llm import decontaminate, queries

TABLES = "documents labels benchmark".split()


def compared(spark, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    return sorted(str(tuple(r[c] for c in order)) for r in got.collect()), sorted(str(r) for r in want.select(*order).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, small, name):
    got, want = compared(spark, name, small)
    assert got == want


def test_a_query_for_each_operator():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14))


def test_pipeline_keeps_columns_and_takes_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before, sizes = docs.count(), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if name == "decontamination":
            bench = spark.read.parquet(f"{small}/benchmark.parquet")
            left = decontaminate.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
            assert not any(r[-1] for r in left)
        if name == "pii":
            assert docs.where("text rlike '[a-z0-9]@[a-z]+[0-9]*[.]example'").count() == 0
    assert before > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0 and sizes[4] > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, small, k):
    more = "label size comp text_hash base offered spans copy_no mix_copy_no row_key row_file key row_no base_ any_digit_in_text first predicted".split()
    columns = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in more)])
    given = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words a@b.de here", "en", "s", 3), (3, "a b c " * 500, "en", "s", 3), (3, "a b c " * 500, "en", "s", 3)]
    rows = [(*r, *(f"{c} {i}" for c in more)) for i, r in enumerate(given)]
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, spark.createDataFrame(rows, columns), small)
    assert out.columns[: len(rows[0])] == [c.split()[0] for c in columns.split(", ")] and len(out.columns) == len(rows[0]) + (k == 4)
    assert all(tuple(r)[5 : len(rows[0])] in {x[5:] for x in rows} for r in out.collect())
    assert out.count() >= (1 if k == 4 else 4)
    assert stage(spark, spark.createDataFrame([], columns), small).count() == 0


def test_run_matches_plain_stages(spark, small):
    """All stages in a row, with near-duplicates and contamination judged by all pairs and plain loops."""
    import re

    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    back = lambda rows: spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    stages = dict(corpus_pipeline.STAGES)
    rows = [r.asDict() for r in stages["toxicity"](spark, back(rows), small).collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate({i: i + 32 for i in range(65, 91)})) for r in rows]
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= 80 * (len(own[i]) + len(own[j]) - both):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    rows = [min((r for r, g in zip(rows, group, strict=True) if g == k), key=lambda r: r["doc_id"]) for k in set(group)]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r[0] for r in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in rows], bench) if r[-1]}
    rows = [r.asDict() for r in stages["pii"](spark, back([r for r in rows if r["doc_id"] not in bad]), small).collect()]
    want = sorted((r.doc_id, r.copy_no, r.text) for r in stages["mixing"](spark, back(rows), small).collect())
    assert sorted((r.doc_id, r.copy_no, r.text) for r in corpus_pipeline.run(spark, small).collect()) == want
