"""Operator 1: toxicity. Character n-gram linear classifier on naive Bayes log-count ratios.

Features are the character n-grams (4 to 6 bytes of the lower-cased text, all that is no letter or
digit read as one kind of gap) that a document holds, counted once. Each feature's value is its
naive Bayes log-count ratio between toxic and other documents; a logistic regression over those
values is trained in numpy. The score is the probability it gives.

The fit sees at most ``FIT_ROWS`` labelled documents (half of each class as far as there are as
many, chosen by a hash of the id), of any length, and the intercept is set back to the classes' true
shares. Spark counts their n-grams by class and chooses ``FEATURES`` of them by chi-square, so the
task that trains is sent the chosen ones of each document alone: at most 24 kB a row, however long
its text. Everything else runs over every whole text.

Edge cases: a null or empty text has no features and scores what the intercept gives. Without
labelled rows of both classes the model is a constant: the share of label 1 (0 where there is none).
Repeated rows score alike and stay repeated; extra columns are dropped; an empty table gives an
empty table.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import U64, crc32_of_id, ensure_checkpoint_dir, fit_in_one_task, joined_bytes, label_sample, map_arrow, removed, slices, table, utf8

FIT_ROWS = 8000
LENGTHS = (4, 5, 6)
FEATURES = 6000
LEAST_DOCS = 4
#: Codes that a task counts before it hands its counts on.
CODES_IN_TASK = 1 << 21
#: Tasks that the sample's texts are dealt to.
PARTS = 64
SMOOTHING = 0.5
HELD = (5, 0)

#: Letters lower-cased, digits and bytes of other scripts as they are, the rest one gap.
GAP = 0x20
FOLD = np.full(256, GAP, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
MULTIPLIER = U64(0x9E3779B97F4A7C15)
TABLE_BITS = 22


def ngram_codes(data: np.ndarray) -> list[np.ndarray]:
    """A 32-bit code for each n-gram of the bytes, one array for each length."""
    wide = data.astype(U64)
    packed = np.zeros(len(data), U64)
    out = []
    for n in range(1, max(LENGTHS) + 1):
        if len(data) < n:
            break
        packed = packed[: len(data) - n + 1] | (wide[n - 1 :] << U64(8 * (n - 1)))
        if n in LENGTHS:
            out.append((((packed + U64(n)) * MULTIPLIER) >> U64(32)).astype(np.uint32))
    return out


def surrounded(text: bytes) -> np.ndarray:
    return FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]


def distinct_codes(text: bytes) -> np.ndarray:
    codes = ngram_codes(surrounded(text))
    return np.unique(np.concatenate(codes)) if codes else np.empty(0, np.uint32)


class Counts:
    """How many documents hold each code: sorted codes, merged as often as their number doubles."""

    def __init__(self):
        self.codes, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.size += len(codes)
        if self.size > max(1 << 20, len(self.codes)):
            self.merge()

    def merge(self) -> None:
        fresh, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.empty(0, np.uint32), np.empty(0, np.int64))
        codes = np.union1d(self.codes, fresh)
        counts = np.zeros(len(codes), np.int64)
        counts[np.searchsorted(codes, self.codes)] = self.counts
        counts[np.searchsorted(codes, fresh)] += n
        self.codes, self.counts, self.waiting, self.size = codes, counts, [], 0


def places(codes: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``have`` are among the sorted codes, and where."""
    at = np.searchsorted(codes, have)
    ok = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == have) if len(codes) else np.zeros(len(have), bool)
    return ok, at[ok]


def count_ngrams(sample: DataFrame) -> DataFrame:
    """(code, toxic, other): how many documents of the sample hold each n-gram, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Counts(), Counts()]

        def so_far() -> Iterator[pa.RecordBatch]:
            for y, x in enumerate(of):
                x.merge()
                none = np.zeros(len(x.codes), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.codes.astype(np.int64)), pa.array(x.counts if y else none), pa.array(none if y else x.counts)], ["code", "toxic", "other"])
                of[y] = Counts()

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                of[y].add(distinct_codes(text.as_py()))
                if sum(len(x.codes) + x.size for x in of) > CODES_IN_TASK:
                    yield from so_far()
        yield from so_far()

    each = sample.select("label", "text").mapInArrow(run, "code long, toxic long, other long")
    return each.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose_ngrams(counted: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``FEATURES`` codes of the highest chi-square, ties to the smaller code, with their counts; in order of the codes."""
    p, both = F.col("toxic").cast("double"), (F.col("toxic") + F.col("other")).cast("double")
    expect = both * F.lit(float(n1)) / F.lit(float(n1 + n0))
    gain = (p - expect) * (p - expect) / F.greatest(expect, F.lit(1e-9)) + (p - expect) * (p - expect) / F.greatest(both - expect, F.lit(1e-9))
    common = counted.where(F.greatest("toxic", "other") >= LEAST_DOCS)
    rows = sorted(tuple(r) for r in common.orderBy(gain.desc(), "code").limit(FEATURES).collect())
    codes, toxic, other = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.uint32, np.float64, np.float64)))
    return codes, toxic, other


def choose_here(held: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``choose_ngrams`` gives, for documents in memory."""
    n1, n0 = float(labels.sum()), float((1 - labels).sum())
    found: dict[int, list[float]] = {}
    for own, y in zip(held, labels, strict=True):
        for code in np.frombuffer(own, np.uint32).tolist():
            found.setdefault(code, [0.0, 0.0])[1 - y] += 1

    def gain(code: int) -> float:
        p, both = found[code][0], sum(found[code])
        expect = both * n1 / (n1 + n0)
        return (p - expect) * (p - expect) / max(expect, 1e-9) + (p - expect) * (p - expect) / max(both - expect, 1e-9)

    best = sorted(sorted((c for c, n in found.items() if max(n) >= LEAST_DOCS), key=lambda c: (-gain(c), c))[:FEATURES])
    return np.array(best, np.uint32), np.array([found[c][0] for c in best]), np.array([found[c][1] for c in best])


def train(held: list[bytes], labels: np.ndarray, share: float, chosen: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, rounds: int = 400) -> bytes:
    """Weigh the chosen n-grams by log-count ratio, fit the regression; returns the model's bytes.

    held: the chosen codes that each document holds, as the bytes of 32-bit numbers; without a choice,
    all codes that it holds, and the choice is made from them here.
    """
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    codes, p, q = chosen or choose_here(held, labels)
    ratio = np.log((p + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (n0 + 2 * SMOOTHING))
    rows, cols = [], []
    for i, own in enumerate(held):
        at = places(codes, np.frombuffer(own, np.uint32))[1]
        cols.append(at)
        rows.append(np.full(len(at), i))
    rows_, cols_ = np.concatenate(rows), np.concatenate(cols)
    values = ratio[cols_]
    w, bias = np.zeros(len(codes)), 0.0
    speed = np.full(len(codes) + 1, 1e-8)
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    for _ in range(rounds):  # AdaGrad over all rows at once
        z = np.bincount(rows_, values * w[cols_], minlength=len(held)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g = np.append(np.bincount(cols_, values * gap[rows_], minlength=len(codes)) + 1e-5 * w, gap.sum())
        speed += g * g
        step = 0.1 * g / np.sqrt(speed)
        w -= step[:-1]
        bias -= step[-1]
    shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6))  # trained as if both classes were as common
    return _pack(codes, w * ratio, bias + shift, False)


def _pack(codes: np.ndarray, weights: np.ndarray, bias: float, constant: bool) -> bytes:
    out = io.BytesIO()
    np.savez(out, codes=codes, weights=weights, bias=np.array([bias]), constant=np.array([constant]))
    return out.getvalue()


def scorer(model: bytes):
    """A function from an Arrow batch with doc_id, held_out and text to one with scores."""
    got = np.load(io.BytesIO(model))
    codes, weights, bias, constant = got["codes"], got["weights"].astype(np.float64), float(got["bias"][0]), bool(got["constant"][0])
    maybe = np.zeros(1 << TABLE_BITS, bool)
    maybe[codes >> np.uint32(32 - TABLE_BITS)] = True

    def scores(column: pa.Array) -> np.ndarray:
        if constant:
            return np.full(len(column), bias)
        total = np.full(len(column), bias)
        for start, end in slices(column):
            data, bounds = joined_bytes(column, start, end)
            # a gap before, between and after texts keeps n-grams inside one text, as in training
            spread = np.full(len(data) + 2 * (end - start), GAP, np.uint8)
            owner = np.repeat(np.arange(end - start), np.diff(bounds))
            spread[np.arange(len(data)) + 2 * owner + 1] = FOLD[data]
            edges = bounds[:-1] + 2 * np.arange(end - start)
            seen = []
            for n, found in zip(LENGTHS, ngram_codes(spread), strict=False):
                at = np.flatnonzero(maybe[found >> np.uint32(32 - TABLE_BITS)])
                slot = np.searchsorted(codes, found[at])
                ok = (slot < len(codes)) & (codes[np.minimum(slot, len(codes) - 1)] == found[at])
                at, slot = at[ok], slot[ok]
                row = np.searchsorted(edges, at, side="right") - 1
                last = np.append(edges[1:], len(spread))[row]
                inside = at + n <= last
                seen.append(row[inside] * len(codes) + slot[inside])
            once = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
            total[start:end] += np.bincount(once // len(codes), weights[once % len(codes)], minlength=end - start)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return scores


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "toxic") -> bytes:
    """Model bytes from labelled documents outside the held-out fold."""
    share = labels.where(F.col(label).isNotNull() & (crc32_of_id() % HELD[0] != HELD[1])).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/toxicity-{uuid.uuid4().hex}"
    label_sample(docs, labels, label, rows, *HELD).repartition(PARTS, "doc_id").write.parquet(path)
    sample = spark.read.parquet(path)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if n1 and n0:
        chosen = choose_ngrams(count_ngrams(sample), n1, n0)

        def held(text: bytes) -> bytes:
            own = distinct_codes(text)
            return own[places(chosen[0], own)[0]].tobytes()

        def fit(_: list, classes: list, each: list[bytes]) -> bytes:
            return train(each, np.array(classes, np.int64), share, chosen)

        model = fit_in_one_task(sample, held, fit, "doc_id", "label")
    else:
        model = _pack(np.empty(0, np.uint32), np.empty(0), share if n1 else 0.0, True)
    removed(spark, path)
    return model


def score_toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scores" not in made:
            made["scores"] = scorer(model)
        score = made["scores"](batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    made: dict = {}
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_of_id() % HELD[0] == HELD[1], F.lit(False)).alias("held_out"), utf8().alias("text"))
    return map_arrow(given, run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
