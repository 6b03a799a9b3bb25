"""Quality by hashed word n-grams: logistic regression with follow-the-regularised-leader updates.

Words are hashed as they are in lower case and as shapes (``A!!``, ``a,``), in
n-grams of one and two, and n-grams that the text had before as repeats.  A
family's features are its counts over its size, so a text's score is the sum
over the families of the mean weight of what it holds: a sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.labelled import ROWS_PER_CLASS, training_rows
from tidewater.llm.quality_rules import split_words
from tidewater.llm.shared import map_batches, slices

#: Size of the weight vector: 2 ** HASH_BITS numbers.
HASH_BITS = 18
#: FTRL-proximal's parameters, passes over the sample, and the scale of a family's mean.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.02, 0.1, 4, 8.0
FAMILIES = ("word", "word pair", "shape", "shape pair", "repeat")
#: Distinct words whose hashes a process keeps.
KEPT = 300_000

_MASK = np.uint64((1 << HASH_BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Upper-case letters as A, other letters as a, digits as 0; runs of the same are two at most of marks, one of letters and digits."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)


class _Words(dict):
    """Word to (hash of the word << 32 | hash of its shape)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = found
        return found


_WORDS = _Words()


def _slots(values: np.ndarray, family: int) -> np.ndarray:
    x = (values + np.uint64(family + 1)) * _MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(23)) & _MASK


def features(text: str | None) -> list[np.ndarray]:
    """For each family the slots of its n-grams, in order."""
    words = split_words(text or "")
    both = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    pair = word[:-1] * _MIX + word[1:]
    form_pair = form[:-1] * _MIX + form[1:]
    # whether each pair of words was in the text before
    again = np.ones(len(pair), dtype=np.uint64)
    if len(pair):
        again[np.unique(pair, return_index=True)[1]] = 0
    return [_slots(word, 0), _slots(pair, 1), _slots(form, 2), _slots(form_pair, 3), _slots(again, 4)]


def logit(weights: np.ndarray, bias: float, found: list[np.ndarray]) -> float:
    return bias + SCALE * sum(float(weights[f].mean()) for f in found if len(f))


def train(rows: list[tuple[str, int]], seed: int = 11) -> tuple[np.ndarray, float]:
    """(weights, bias) from (text, label) rows; no rows or one class: weights of zero and the class's share."""
    size = (1 << HASH_BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    sparse = []
    for text, label in rows:
        at, value = [np.array([size - 1])], [np.array([1.0])]
        for f in features(text):
            if len(f):
                slots, counts = np.unique(f, return_counts=True)
                at.append(slots.astype(np.int64))
                value.append(SCALE * counts / len(f))
        slots, where = np.unique(np.concatenate(at), return_inverse=True)
        sparse.append((slots, np.bincount(where, np.concatenate(value)), label))
    order = np.random.default_rng(seed)
    positive = sum(label for *_, label in sparse)
    weight = {0: len(sparse) / (2 * max(1, len(sparse) - positive)), 1: len(sparse) / (2 * max(1, positive))}
    for _ in range(PASSES):
        for i in order.permutation(len(sparse)):
            slots, x, label = sparse[i]
            zi, ni = z[slots], n[slots]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - label) * x * weight[label]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[slots] = zi + g - sigma * wi
            n[slots] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:-1].astype(np.float32), float(w[-1])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, float], held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Null and empty texts, and those of white space, have no n-gram and score
    what the bias alone gives.  Null doc_id: a row, held out where the condition
    is true.  Repeated rows: a row each.  Empty table: no rows.  Other columns
    aren't read.  The weights, 2 ** HASH_BITS numbers, are broadcast.  A very long
    text is scored whole, with memory for its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in slices(batches):
            score = np.array([logit(weights, bias, features(t)) for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return map_batches(rows, run, SCHEMA)


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: Column, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Fit on a bounded sample of the labels that aren't held out and score all of ``docs``."""
    return quality_scores(docs, train(training_rows(docs, labels, "quality", ~held_out, rows_per_class)), held_out)
