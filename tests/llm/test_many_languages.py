"""Language identification over more languages than one plan has branches for."""

from __future__ import annotations

from civicspark.llm import langid


def test_no_language_is_left_out_of_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit_in_one_task", lambda sample, *_: seen.extend(sample.collect()) or b"")
    rows = [(k, f"text {k}", f"l{k % 230:03d}") for k in range(1600)]
    langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=460)
    counts = {}
    for r in seen:
        counts[r.lang] = counts.get(r.lang, 0) + 1
    assert len(counts) == 230
