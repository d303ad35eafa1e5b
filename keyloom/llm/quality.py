"""Quality rules: repetition and length rules, and a hashed n-gram logistic regression with calibrated probabilities.

The model is trained here on a bounded sample of labelled rows: hashed frequencies of words, word pairs and character
3- and 4-grams (of code points), logistic regression by gradient descent; a held-out part calibrates the logit (Platt).
Every document is then scored whole, in Arrow batches, against a fixed threshold.

Cases: null text has no words (all counts 0, so the length rule fails it); rows without a label, or whose document is
missing or longer than LONGEST, do not train, and of rows with one doc_id one does; with labels of one class only, the model keeps everything; very long texts are scored whole;
repeated rows each give their row; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.shingles import hash_words, let_go, release, windows

#: Rows of each class and characters of a row that train at most, bits of the feature hash, and the least calibrated
#: probability that is kept.
SAMPLE, LONGEST, BITS, KEEP_AT = 1000, 200_000, 18, 0.3
#: The rules' limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_MASK = np.uint64((1 << BITS) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    h = h * _P
    return ((h >> np.uint64(40)) & _MASK).astype(np.int64)


def grams(text: str, words: np.ndarray) -> list[np.ndarray]:
    """Feature slots by kind: words, word pairs, character 3-grams, character 4-grams."""
    out = [_slot(words), _slot(words[:-1] * np.uint64(31) + words[1:] + np.uint64(7))]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    if len(c) >= 4:
        c ^= c >> np.uint32(15)
        three = c[:-2] * np.uint32(0x85EBCA77) + c[1:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        for g in (three, three[:-1] * np.uint32(0x165667B1) + c[3:]):
            g ^= g >> np.uint32(15)
            g *= np.uint32(0x2C1B3C6D)
            out.append((g >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def counts(data: bytes, text: str, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeat = 0
    if len(hashes) >= 3:
        three = windows(hashes, 3)
        order = np.argsort(three)
        same = np.flatnonzero(np.diff(three[order]) == 0)
        again = np.zeros(len(three), bool)
        again[order[same]] = again[order[same + 1]] = True
        if again.any():
            covered = np.zeros(len(hashes), bool)
            for i in range(3):
                covered[i : i + len(again)] |= again
            repeat = int(covered.sum())
    spaces = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    return len(hashes), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS.encode())), len(lines) - len(set(lines)), repeat


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def logit(self, slots: list[np.ndarray]) -> float:
        """Without a vector: the norm of hashed counts is taken per kind, each kind weighing the same."""
        return self.bias + sum(float(self.weights[k][s].sum()) / max(len(s), 1) for k, s in enumerate(slots))

    def probability(self, slots: list[np.ndarray]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(slots) + self.shift, -30, 30)))


def fit(texts: list[str], good: list[int], epochs: int = 60, rate: float = 200.0, l2: float = 1e-6) -> Model:
    """Full-batch gradient descent on mean n-gram frequencies; every fifth row is held out for calibration."""
    y = np.array(good, float)
    train = np.arange(len(texts)) % 5 != 0
    if len(set(y[train])) < 2:
        return Model(np.zeros((4, 1 << BITS), np.float32), 0.0, 0.0, 30.0)
    balance = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    parts: list[list[tuple]] = [[], [], [], []]  # by kind: row, slots and frequencies of each text
    for i, (t, hashes) in enumerate(zip(texts, hash_words(texts, lower=False), strict=True)):
        for k, slots in enumerate(grams(t, hashes)):
            at, n = np.unique(slots.astype(np.int32), return_counts=True)
            parts[k].append((np.full(len(at), i, np.int32), at, (n / max(len(slots), 1)).astype(np.float32)))
    packed = [tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in zip(*p, strict=True)) if p else (np.zeros(0, np.int32),) * 3 for p in parts]
    w, bias = np.zeros((4, 1 << BITS)), 0.0
    z = lambda: bias + sum(np.bincount(r, w[k][a] * v, len(texts)) for k, (r, a, v) in enumerate(packed))
    for _ in range(epochs):
        error = np.where(train, (1 / (1 + np.exp(-np.clip(z(), -30, 30))) - y) * balance, 0) / train.sum()
        for k, (r, a, v) in enumerate(packed):
            w[k] -= rate * (np.bincount(a, error[r] * v, 1 << BITS) + l2 * w[k])
        bias -= rate / 100 * error.sum()
    held, slope, shift = z()[~train], 1.0, 0.0
    target = y[~train]
    target = np.where(target == 1, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
    for _ in range(2000):
        e = 1 / (1 + np.exp(-np.clip(slope * held + shift, -30, 30))) - target
        slope, shift = slope - 0.5 * (e * held).mean(), shift - 0.5 * e.mean()
    return Model(w.astype(np.float32), float(bias), max(float(slope), 1e-3), float(shift))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled documents of each class, chosen by a hash of their id.

    Only this bounded sample comes to the driver. docs: (doc_id, text); labels: (doc_id, quality).
    """
    clean = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = None
    for q in (0, 1):
        one = clean.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = one if chosen is None else chosen.unionByName(one)
    found = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.collect()  # at most 2 * sample rows of at most LONGEST characters
    rows = sorted({(r["doc_id"], r["text"], r["quality"]) for r in rows}, key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
    rows = [r for q in (0, 1) for r in [x for x in rows if x[2] == q][:sample]]
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r[0]) + "order"))
    return fit([r[1] for r in rows], [r[2] for r in rows])


ADDED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("probability", T.DoubleType())]
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]


def _verdicts(texts: list[str | None], model: Model, keep_at: float) -> list[tuple]:
    """The values of ADDED for each text."""
    out = []
    for text, hashes in zip(texts, hash_words(texts, lower=False), strict=True):
        text = text or ""
        data = text.encode()
        c = counts(data, text, hashes)
        failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]
        p = float(model.probability(grams(text, hashes)))
        out.append((*c, failed, not failed and p >= keep_at, p))
    return out


def judge(df: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """df with the rules' counts, base_failed, the calibrated probability of good quality, and kept."""
    names = [n for n, _ in ADDED]
    rest = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, t) for n, t in ADDED)])
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 * 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            out = _verdicts(b.column("text").to_pylist(), shared.value, keep_at)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(x, t) for x, t in zip(columns, _KINDS, strict=True))], names=schema.names)
        release()

    return df.mapInArrow(run, schema)


def keep(df: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of df that `judge` keeps, with df's columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 * 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            yield b.filter(pa.array([v[6] for v in _verdicts(b.column("text").to_pylist(), shared.value, keep_at)], pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
