"""Scores of the trained operators against plain loops over one text at a time."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
import pytest

from civicspark.llm import langid, quality, toxicity
from civicspark.llm.common import crc32_of_id, label_sample, table

TEXTS = [b"", b"a", b"Some Text, 12 times over: some text!", "für größere Städte — ja".encode(), b"x" * 500, b"One line.\n\nAnother  line of many words " * 20, b"\x00\xff odd"]
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")


def folded(text: bytes) -> list[int]:
    fold = lambda c: c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    return [32, *map(fold, text), 32]


def grams(text: bytes, lengths: tuple, multiplier: int, shift: int) -> list[int]:
    data = folded(text)
    return [((sum(b << (8 * k) for k, b in enumerate(data[i : i + n])) + n) * int(multiplier) & MASK) >> shift for n in lengths for i in range(len(data) - n + 1)]


def test_toxicity(tables):
    model = toxicity.fit_toxicity(*tables)
    got = np.load(io.BytesIO(model))
    weight = dict(zip(got["codes"].tolist(), got["weights"].tolist(), strict=True))
    want = [1 / (1 + math.exp(-float(got["bias"][0]) - sum(weight.get(c & 0xFFFFFFFF, 0.0) for c in set(grams(t, toxicity.LENGTHS, toxicity.MULTIPLIER, 32))))) for t in TEXTS]
    assert np.allclose(toxicity.scorer(model)(pa.array(TEXTS, pa.binary())), want)


def test_ngrams_chosen_by_spark(spark, monkeypatch):
    """Counted in tasks that hand on their counts again and again, the choice is that of one plain count."""
    monkeypatch.setattr(toxicity, "FEATURES", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").limit(60)
    texts = [bytes(r.text, "utf-8") for r in docs.orderBy("doc_id").collect()]
    texts += [b"", b"x" * 100_000, texts[0], texts[0]]
    labels = [i % 2 for i in range(len(texts))]
    sample = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text binary, label int").repartition(3)
    got = toxicity.choose_ngrams(toxicity.count_ngrams(sample), sum(labels), len(labels) - sum(labels))
    want = toxicity.choose_here([toxicity.distinct_codes(t).tobytes() for t in texts], np.array(labels))
    assert len(got[0]) == 300 and all((a == b).all() for a, b in zip(got, want, strict=True))


def test_a_long_text_sends_only_chosen_ngrams(spark, monkeypatch):
    sent = []
    plain = toxicity.fit_in_one_task
    monkeypatch.setattr(toxicity, "FEATURES", 50)
    monkeypatch.setattr(toxicity, "fit_in_one_task", lambda sample, prepare, *rest: sent.extend(len(prepare(bytes(r.text))) for r in sample.collect()) or plain(sample, prepare, *rest))
    rng = np.random.default_rng(3)
    rows = [(i, ("foul " if i % 2 else "fine ") + "".join(map(chr, rng.integers(97, 123, 40_000 if i < 4 else 40)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert sent and max(sent) <= 4 * 50
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score_toxicity(docs.where("doc_id >= 4"), model).collect())


def test_log_count_ratios():
    docs, labels = [b"spam eggs"] * 4 + [b"ham eggs"] * 5, np.array([1] * 4 + [0] * 5)
    got = np.load(io.BytesIO(toxicity.train([toxicity.distinct_codes(t).tobytes() for t in docs], labels, 0.5)))
    assert set(got["codes"].tolist()) == {c & 0xFFFFFFFF for t in docs for c in grams(t, toxicity.LENGTHS, toxicity.MULTIPLIER, 32)}
    # the weight is a coefficient times the ratio: n-grams of both classes alike have the ratio ln((4.5/5)/(5.5/6)), nearly 0
    spam = {c & 0xFFFFFFFF for c in grams(b"spam", (4,), toxicity.MULTIPLIER, 32)}
    assert all(w > 0 for c, w in zip(got["codes"].tolist(), got["weights"].tolist(), strict=True) if c in spam)


def test_quality_forward_and_gradient(tables):
    docs, labels = tables
    m = dict(np.load(io.BytesIO(quality.fit_quality(docs, labels))))
    want = []
    for t in TEXTS:
        x = np.frombuffer(quality.encode_one(t), np.float32).reshape(-1, quality.WIDTH)
        units, logits = [], []
        for row in x:
            h = np.tanh(((row - m["mean"]) / m["scale"]) @ m["W"] + m["b"])
            units.append(h)
            logits.append(float((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"]))
        share = [math.exp(e) for e in logits]
        bag = sum(s * h for s, h in zip(share, units, strict=True)) / sum(share)
        want.append(1 / (1 + math.exp(-float(bag @ m["c"] + m["c0"][0]))))
        assert len(x) == max(1, -(-len(t.split()) // quality.PASSAGE_WORDS))
    packed = io.BytesIO()
    np.savez(packed, **m)
    assert np.allclose(quality.scorer(packed.getvalue())(pa.array(TEXTS, pa.binary())), want, atol=1e-5)

    rng = np.random.default_rng(3)
    fixed = {k: m[k] for k in ("mean", "scale")}
    own = {k: v.astype(np.float64) for k, v in m.items() if k not in fixed}
    x, bag = rng.normal(size=(7, quality.WIDTH)), np.array([0, 0, 1, 1, 1, 2, 2])
    starts, y, weight = np.array([0, 2, 5]), np.array([1, 0, 1]), np.array([0.5, 0.3, 0.2])
    grad = quality.gradients(own, fixed, x, starts, bag, y, weight)

    def loss(model: dict) -> float:
        p = quality.sigmoid(quality.forward(model | fixed, x, starts, bag)[0])
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    for k in own:
        for at in list(np.ndindex(own[k].shape))[:: max(1, own[k].size // 5)]:
            up, down = ({n: v.copy() for n, v in own.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(grad[k][at], abs=1e-6)


def test_languages(tables):
    model = langid.fit_languages(tables[0])
    got = np.load(io.BytesIO(model))
    names, weights, bias, temperature = list(got["names"]), got["weights"], got["bias"], float(got["temperature"][0])
    said, top, rejected = langid.predictor(model)(pa.array(TEXTS, pa.binary()), np.ones(len(TEXTS), bool))
    for i, t in enumerate(TEXTS):
        buckets = grams(t, langid.LENGTHS, langid.MULTIPLIER, 50)
        z = (sum((weights[b] for b in buckets), np.zeros(len(names))) / max(1, len(buckets)) + bias) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert top[i] == pytest.approx(p.max(), abs=1e-4)
        assert said[i] == names[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4
        assert rejected[i] == (top[i] < float(got["reject"][0]))


def test_answers_are_calibrated(tables):
    docs, _ = tables
    rows = langid.identify_languages(docs, langid.fit_languages(docs)).where("held_out and not rejected").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert right >= 0.97 and abs(right - sum(r.score for r in rows) / len(rows)) < 0.05


def test_sample_places_go_to_ids_with_a_document(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(20)] + [(3, "a"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(4, 5), (None, 1)], "doc_id long, toxic int")
    rows = label_sample(docs, labels, "toxic", 40, 5, 0).collect()
    want = {r.doc_id for r in docs.where("doc_id is not null").where(crc32_of_id() % 5 != 0).collect()}
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    assert {r.doc_id: bytes(r.text) for r in rows}[3] == b"a"
