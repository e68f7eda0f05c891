"""The pipeline's stages on rows whose id is null or repeats."""

from __future__ import annotations

import random

import corpus_pipeline
from civicspark.llm import mixing, toxicity
from civicspark.llm.common import row_keyed, table

COLUMNS = "doc_id long, text string, source string"


def written(spark, path, rows, columns=COLUMNS):
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_keys_are_distinct_and_stay(spark, tmp_path):
    docs = written(spark, tmp_path / "t", [(None, words(k % 5), "s") for k in range(50)])
    for given in (docs, docs.where("source = 's'"), docs.unionByName(docs)):
        keyed, key = row_keyed(given)
        first, again = ({r[key]: r.text for r in keyed.select(key, "text").collect()} for _ in range(2))
        assert len(first) == given.count() and first == again


def test_near_copies_without_an_id_or_of_one_id(spark, small, tmp_path):
    rows = [(None, words(1), "s"), (None, words(1), "s"), (7, words(1), "s"), (7, words(1) + " end", "s"), (7, words(2), "s"), (None, words(3), "s"), (None, words(3), "s"), (None, None, "s")]
    out = corpus_pipeline.drop_near_duplicates(spark, written(spark, tmp_path / "t", rows), small).collect()
    assert sorted(str(r.doc_id) for r in out) == ["7", "7", "None", "None"]
    assert len({r.text for r in out}) == 4 and {r.text for r in out} >= {words(2), words(3), None}


def test_contaminated_rows_go_and_others_of_the_id_stay(spark, small, tmp_path):
    item = next(r.text for r in table(spark, small, "benchmark").collect() if r.text and len(r.text.split()) > 30)
    rows = [(None, item, "s"), (9, item, "s"), (9, words(4), "s"), (None, words(5), "s")]
    out = corpus_pipeline.drop_contaminated(spark, written(spark, tmp_path / "t", rows), small).collect()
    assert sorted(r.text for r in out) == sorted([words(4), words(5)])


def test_toxic_rows_go_and_others_of_the_id_stay(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, small, "labels")))
    text_of = lambda p: docs.join(found.where(f"predicted = {p}").select("doc_id"), "doc_id").orderBy("doc_id").first().text
    toxic, clean = text_of(1), text_of(0)
    rows = [(None, toxic), (-5, toxic), (-5, clean)]  # ids without a label
    docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True).write.parquet(str(tmp_path / "t"))
    out = corpus_pipeline.drop_toxic(spark, spark.read.parquet(str(tmp_path / "t")), small)
    assert [r.text for r in out.where("doc_id is null or doc_id = -5").collect()] == [clean]


def test_mix_emits_each_row_by_its_own_rank(spark, tmp_path):
    rows = [(None if k % 3 == 0 else 1 if k % 3 == 1 else k, f"{words(k, 8)} {k}", f"s{k % 2}") for k in range(300)]
    docs = written(spark, tmp_path / "t", rows)
    copies = [r.copies for r in mixing.mix_sources(docs).collect()]
    out = mixing.emit_mix(docs).collect()
    assert len(out) == sum(copies) and len({(r.text, r.copy_no) for r in out}) == len(out)
