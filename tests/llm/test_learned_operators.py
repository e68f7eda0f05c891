"""Trained operators: held-out accuracy, odd inputs, and what each learns from."""

from __future__ import annotations

import pytest

from civicspark.llm import langid, quality, toxicity
from civicspark.llm.common import table

ODD = [(1, None), (2, ""), (3, "\x00\x01"), (4, "x" * 100_000), (5, "12 34 !!"), (5, "12 34 !!"), (6, "é" * 30)]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in ODD], "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


@pytest.mark.parametrize(("fit", "score", "label", "least"), [(toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", 0.9), (quality.fit_quality, quality.score_quality, "quality", 0.97)])
def test_labels_are_learned(tables, odd, fit, score, label, least):
    docs, labels = tables
    model = fit(docs, labels)
    assert model == fit(docs.repartition(5), labels.repartition(3))
    rows = score(docs, model).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert len(rows) > 50 and sum(r[0] == r[1] for r in rows) >= least * len(rows)
    found = score(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 5}) == 1
    assert score(odd.limit(0), model).count() == 0
    # no labels at all, or of one class: a constant
    for some in (labels.limit(0), labels.where(f"{label} = 1")):
        assert len({r.score for r in score(odd, fit(docs, some)).collect()}) == 1
    # labels of held-out rows are not looked at
    flipped = labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - {label} else {label} end as {label}")
    assert fit(docs, flipped) == model


def test_languages(spark, tables, odd):
    docs, _ = tables
    model = langid.fit_languages(docs)
    rows = langid.identify_languages(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    found = {r.doc_id: r for r in langid.identify_languages(odd, model).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {1, 2, 3, 5}
    assert all(found[i].rejected and found[i].score == 0 for i in (1, 2, 3, 5))
    assert langid.identify_languages(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(odd, langid.fit_languages(docs.limit(0))).collect()} == {"und"}
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'xx' else lang end as lang")
    assert langid.fit_languages(changed) == model
