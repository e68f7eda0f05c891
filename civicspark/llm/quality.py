"""Operator 4: quality. Attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words (the last may be shorter). Every passage
is encoded as a vector: shares of byte kinds, word shapes and repeats, and a small hashed histogram
of byte pairs. A one-layer encoder maps it to ``HIDDEN`` units; gated attention (a tanh branch times
a sigmoid branch) weighs the passages of a document, and the weighted sum is scored by a logistic
unit. All weights are learned together from document labels alone, in numpy.

The fit sees at most ``FIT_ROWS`` labelled documents (half of each class as far as there are as many,
chosen by a hash of the id), of any length; the intercept is set back to the classes' true shares. Scoring covers every passage of every whole text.

Edge cases: a null or empty text is one passage without words (all features 0). Without labelled
rows of both classes the score is the share of label 1 (1 where there is no label at all, so that
nothing is thrown away unlearned). Repeated rows score alike and stay repeated; extra columns are
dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import NOT_SPACE, SubstringHash, crc32_of_id, fit_in_one_task, joined_bytes, label_sample, map_arrow, runs, slices, table, utf8

PASSAGE_WORDS = 64
FIT_ROWS = 6000
HIDDEN = 24
HELD = (5, 0)
THRESHOLD = 0.3
PAIRS = 32

#: Byte kinds: lower, upper, digit, white space, sentence marks, brackets and bars, other marks, other scripts.
KIND = np.full(256, 6, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
KIND[[0x20, 9, 10, 11, 12, 13]] = 3
KIND[[ord(c) for c in ".,;:?'\"-"]] = 4
KIND[[ord(c) for c in "()[]{}|/<>"]] = 5
KIND[128:] = 7
KINDS = 8
WIDTH = KINDS + 8 + PAIRS


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of a batch of texts, and the row each passage belongs to."""
    rows = len(bounds) - 1
    starts, ends = runs(NOT_SPACE[data], bounds)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    first_word = np.searchsorted(owner, np.arange(rows))
    nth = np.arange(len(starts)) - first_word[owner]
    opens = np.flatnonzero(nth % PASSAGE_WORDS == 0)
    have = np.zeros(rows, bool)
    have[owner] = True
    bag_of = np.concatenate([owner[opens], np.flatnonzero(~have)])
    x = np.zeros((len(bag_of), WIDTH), np.float32)
    n = len(opens)
    if n:
        passage = np.repeat(np.arange(n), np.diff(np.append(opens, len(starts))))
        # bytes from a passage's first word to the next passage or the text's end
        begin = starts[opens]
        finish = np.append(begin[1:], len(data))
        finish = np.minimum(finish, bounds[owner[opens] + 1])
        of_byte = np.repeat(np.arange(n), finish - begin)
        where = np.arange(len(of_byte)) + np.repeat(begin - np.append(0, np.cumsum(finish - begin)[:-1]), finish - begin)
        b = data[where]
        length = (finish - begin).astype(np.float32)[:, None]
        x[:n, :KINDS] = np.bincount(of_byte * KINDS + KIND[b], minlength=n * KINDS).reshape(n, KINDS) / length
        inner = np.flatnonzero(of_byte[:-1] == of_byte[1:])  # a pair lies within one passage
        pair = (b[inner].astype(np.int64) * 31 + b[inner + 1].astype(np.int64) * 7) % PAIRS
        x[:n, KINDS + 8 :] = np.bincount(of_byte[inner] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / length
        words = np.bincount(passage, minlength=n).astype(np.float32)
        code = SubstringHash(data).at(starts, ends)
        size = ends - starts
        last = data[ends - 1]
        same = np.zeros(len(code), bool)
        same[1:] = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
        by = np.lexsort((code, passage))
        fresh = np.append(True, (passage[by][1:] != passage[by][:-1]) | (code[by][1:] != code[by][:-1]))
        different = np.bincount(passage[by][fresh], minlength=n)
        shape = np.stack([size, size > 12, size == 1, same, KIND[last] == 6, KIND[data[starts]] == 1], axis=1).astype(np.float32)
        for k in range(shape.shape[1]):
            x[:n, KINDS + k] = np.bincount(passage, shape[:, k], minlength=n) / words
        x[:n, KINDS] /= 10
        x[:n, KINDS + 6] = different / words
        x[:n, KINDS + 7] = words / PASSAGE_WORDS
    order = np.argsort(bag_of, kind="stable")
    return x[order], bag_of[order]


def encode_one(text: bytes) -> bytes:
    """The passage vectors of one text, packed."""
    return encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(m: dict, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple:
    """Logit of each bag, with what the backward pass needs; bag: the bag of each row, from 0."""
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    top = np.maximum.reduceat(e, starts)
    a = np.exp(e - top[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ m["c"] + m["c0"][0], h, t, g, a, z


def gradients(m: dict, fixed: dict, x: np.ndarray, starts: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted logistic loss over some bags, by every weight; own: the bag of each row of x."""
    logit, h, t, g, a, z = forward(m | fixed, x, starts, own)
    gap = (sigmoid(logit) - y) * weight
    dz = gap[:, None] * m["c"]
    da = (dz[own] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[own])
    dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
    dp = (a[:, None] * dz[own] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    scaled = (x - fixed["mean"]) / fixed["scale"]
    return {"W": scaled.T @ dp, "b": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ gap, "c0": np.array([gap.sum()])}


def train(packed: list[bytes], labels: np.ndarray, share: float, epochs: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 11) -> bytes:
    """The model's bytes from each document's packed passage vectors and label."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return _pack({"constant": np.array([share])})
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in packed]
    x, bag = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    rng = np.random.default_rng(seed)
    d = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    m = {"W": d(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": d(HIDDEN, HIDDEN), "U": d(HIDDEN, HIDDEN), "w": d(HIDDEN), "c": d(HIDDEN), "c0": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-2}
    first = np.searchsorted(bag, np.arange(len(bags) + 1))
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
    moment, square, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = first[pick + 1] - first[pick]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            starts, own = np.append(0, np.cumsum(sizes)[:-1]), np.repeat(np.arange(len(pick)), sizes)
            grad = gradients(m, fixed, x[rows], starts, own, labels[pick], weight[pick] / len(pick))
            step += 1
            for k, v in grad.items():
                v = v + 1e-4 * m[k]
                moment[k] = 0.9 * moment[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                m[k] = m[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    m["c0"] = m["c0"] + np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return _pack(m | fixed)


def _pack(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def scorer(model: bytes):
    m = dict(np.load(io.BytesIO(model)))

    def scores(column: pa.Array) -> np.ndarray:
        if "constant" in m:
            return np.full(len(column), float(m["constant"][0]))
        out = np.empty(len(column))
        for start, end in slices(column):
            data, bounds = joined_bytes(column, start, end)
            x, bag = encode(data, bounds)
            out[start:end] = sigmoid(forward(m, x, np.searchsorted(bag, np.arange(end - start)), bag)[0])
        return out

    return scores


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "quality") -> bytes:
    share = labels.where(F.col(label).isNotNull() & (crc32_of_id() % HELD[0] != HELD[1])).agg(F.avg(F.col(label).cast("double"))).first()[0]
    sample = label_sample(docs, labels, label, rows, *HELD)
    share = 1.0 if share is None else share

    def fit(_: list, classes: list, packed: list[bytes]) -> bytes:
        return train(packed, np.array(classes, np.int64), share)

    return fit_in_one_task(sample, encode_one, fit, "doc_id", "label") or _pack({"constant": np.array([share])})


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    made: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scores" not in made:
            made["scores"] = scorer(model)
        score = made["scores"](batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_of_id() % HELD[0] == HELD[1], F.lit(False)).alias("held_out"), utf8().alias("text"))
    return map_arrow(given, run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
