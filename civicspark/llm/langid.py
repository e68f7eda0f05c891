"""Operator 10: language identification by averaged hashed subword embeddings.

Subwords are the byte n-grams (2 to 4) of the folded text, hashed into ``BUCKETS`` rows of an
embedding table. A text is the mean of its subwords' embeddings; a linear softmax gives the
languages. Both are trained together by stochastic gradient descent in numpy on at most ``FIT_ROWS``
documents of any length, or ``LEAST_EACH`` of each language if that is more (chosen by a hash of the
id, balanced over languages, none of which is left out); a part of them, kept aside, sets the softmax
temperature and the score below which an answer counts as rejected. Since the mean and the
softmax's input are both linear, prediction multiplies the table by the output weights once.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and counts as rejected.
Without a learned language every text is ``und``. Of equally likely languages the first in code-point
order is the answer. Repeated rows are answered alike; extra columns
are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.llm.common import U64, crc32_of_id, cut, fit_in_one_task, joined_bytes, map_arrow, slices, table, utf8
from civicspark.llm.toxicity import FOLD, GAP

FIT_ROWS = 6000
#: Rows that each language may give however many there are; beyond FIT_ROWS / LEAST_EACH languages the sample grows with them.
LEAST_EACH = 20
#: Parts of each language whose first rows are taken before those of the whole language.
PARTS = 64
BUCKETS = 1 << 14
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
HELD = (4, 2)
PRECISION = 0.995
MULTIPLIER = U64(0xD6E8FEB86659FD93)


def subword_buckets(data: np.ndarray) -> list[np.ndarray]:
    wide = data.astype(U64)
    packed = np.zeros(len(data), U64)
    out = []
    for n in range(1, max(LENGTHS) + 1):
        if len(data) < n:
            break
        packed = packed[: len(data) - n + 1] | (wide[n - 1 :] << U64(8 * (n - 1)))
        if n in LENGTHS:
            out.append((((packed + U64(n)) * MULTIPLIER) >> U64(50)).astype(np.int64))
    return out


def shares(text: bytes) -> np.ndarray:
    """The share of each bucket among a text's subwords."""
    return spread(packed_shares(text))


PACKED = np.dtype([("bucket", np.uint16), ("share", np.float32)])


def packed_shares(text: bytes) -> bytes:
    """The buckets that a text has, with their shares."""
    found = subword_buckets(FOLD[np.frombuffer(b" " + text + b" ", np.uint8)])
    bucket, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    out = np.empty(len(bucket), PACKED)
    out["bucket"], out["share"] = bucket, n / max(1, n.sum())
    return out.tobytes()


def spread(packed: bytes) -> np.ndarray:
    own, out = np.frombuffer(packed, PACKED), np.zeros(BUCKETS, np.float32)
    out[own["bucket"]] = own["share"]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(packed: list[bytes], langs: list[str], steps: int = 800, batch: int = 64, rate: float = 20.0, seed: int = 7) -> bytes:
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    order = rng.permutation(len(packed))
    aside, order = order[: len(packed) // 8], order[len(packed) // 8 :]
    epochs = max(6, -(-steps * batch // max(1, len(order))))  # a small sample is seen more often
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.stack([spread(packed[i]) for i in pick])
            mean = x @ table_
            gap = softmax(mean @ out + bias)
            gap[np.arange(len(pick)), y[pick]] -= 1
            gap /= len(pick)
            table_ -= pace * (x.T @ (gap @ out.T))
            out -= 0.05 * pace * (mean.T @ gap)
            bias -= 0.05 * pace * gap.sum(axis=0)
    weights = table_ @ out
    temperature, reject = 1.0, 0.0
    if len(aside) >= 20:
        z = np.stack([spread(packed[i]) @ weights for i in aside]) + bias
        loss = {t: -np.log(softmax(z / t)[np.arange(len(aside)), y[aside]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        temperature = min(loss, key=loss.get)
        p = softmax(z / temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[aside]
        by = np.argsort(-top, kind="stable")
        good = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
        enough = np.flatnonzero(good >= PRECISION)
        reject = float(top[by[enough[-1]]]) if len(enough) else 1.0
        reject = min(reject, 0.99)
    out = io.BytesIO()
    np.savez(out, weights=weights, bias=bias, names=np.array(names), temperature=np.array([temperature]), reject=np.array([reject]))
    return out.getvalue()


def predictor(model: bytes):
    got = np.load(io.BytesIO(model))
    weights, bias, names, temperature, reject = got["weights"], got["bias"], list(got["names"]), float(got["temperature"][0]), float(got["reject"][0])

    def predict(column: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        z = np.zeros((len(column), len(names)))
        for start, end in slices(column):
            data, bounds = joined_bytes(column, start, end)
            data = FOLD[data]
            for i in range(end - start):
                own = np.full(bounds[i + 1] - bounds[i] + 2, GAP, np.uint8)
                own[1:-1] = data[bounds[i] : bounds[i + 1]]
                found = subword_buckets(own)
                counts = np.zeros(BUCKETS, np.float32)
                for f in found:
                    counts += np.bincount(f, minlength=BUCKETS)
                z[start + i] = (counts / max(1, sum(map(len, found)))) @ weights + bias
        p = softmax(z / temperature)
        top = np.where(letters, p.max(axis=1), 0.0)
        said = [names[k] if ok else "und" for k, ok in zip(p.argmax(axis=1), letters, strict=True)]
        return said, top, (top < reject) | ~letters

    return predict


def fit_languages(docs: DataFrame, rows: int = FIT_ROWS) -> bytes:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc32_of_id() % HELD[0] != HELD[1]))
    # two short values for each id: places are given before any text moves
    ids = cut(known.select("doc_id", "lang").distinct().withColumn("draw", F.xxhash64("doc_id")))
    kinds = ids.select("lang").distinct().count()
    if not kinds:
        return b""
    each = max(LEAST_EACH, rows // kinds)
    # the first of 64 parts of each language come first, so that no task sorts a whole one; few rows of a part go on
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("draw", "doc_id"))
    some = ids.withColumn("part", F.pmod("draw", F.lit(PARTS))).withColumn("place", place("part")).where(F.col("place") <= max(LEAST_EACH, 8 * each // PARTS))
    picked = some.withColumn("place", place()).where(F.col("place") <= each).select("doc_id", "lang")
    # as many pairs as the sample has rows: the bound makes this broadcast safe
    sample = known.select("doc_id", "lang", utf8().alias("text")).join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def fit(_: list, langs: list[str], packed: list[bytes]) -> bytes:
        return train(packed, langs)

    return fit_in_one_task(sample, packed_shares, fit, "doc_id", "lang")


def identify_languages(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (the calibrated score is below the cut-off).

    A language named ``und`` in the table would read as the answer for texts without a letter.
    """
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc32_of_id() % HELD[0] == HELD[1], F.lit(False)).alias("held_out"),
        utf8().alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    if not model:
        return given.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    made: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "predict" not in made:
            made["predict"] = predictor(model)
        said, top, rejected = made["predict"](batch.column("text"), batch.column("letters").to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(top), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return map_arrow(given, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs))
