"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word comes in as an embedding of its hash and the pooled embeddings of its
hashed character n-grams.  A forward and a backward gated recurrent unit read
windows of WINDOW words, attention pools their states, and a logistic unit
scores the window.  Windows overlap by a quarter and all of them are scored; a
document's score is that of its worst window.  In training a document's label
is given to that window too (multiple-instance learning), chosen anew in each
pass.  Embeddings start from the class log-odds of words and n-grams in the
training rows, so that the first choices are sensible.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.labelled import ROWS_PER_CLASS, training_rows
from tidewater.llm.quality_rules import split_words
from tidewater.llm.shared import map_batches, slices

WINDOW, STRIDE = 32, 24
#: Sizes: hash tables of words and character n-grams, their embeddings, a direction's state, and the attention.
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 1 << 15, 1 << 15, 6, 6, 8, 8
#: Lengths of character n-grams, and the most bytes of a word that is one position; a longer one is several.
GRAMS, LONGEST_WORD = (3, 4, 5), 40
#: Training: least and most passes, steps wanted, documents a step, step size, weight decay of the recurrent weights, seed.
PASSES, STEPS, BATCH, RATE, DECAY, SEED = (6, 30), 600, 32, 0.01, 1e-5, 5
#: Windows scored at a time, and distinct words whose gate inputs a process keeps.
WINDOWS_AT_ONCE, KEPT = 2048, 150_000
#: Words whose n-grams are in memory together.
WORDS_AT_ONCE = 20_000
#: The score of a text without words.
EMPTY_SCORE = 0.0


_OUTER = ".,!?;:\"'()[]{}|#$%&*<>-_"
_BASE = np.uint32(0x01000193)


def _bare(word: str) -> bytes:
    """A word without case and outer punctuation."""
    word = word.lower()
    return (word.strip(_OUTER) or word).encode("utf-8", "surrogatepass")


def positions(text: str) -> list[str | bytes]:
    """The words of a text, those longer than LONGEST_WORD bytes as parts of their marked bytes that share the longest n-gram."""
    words = split_words(text)
    cut, size = {}, LONGEST_WORD + 2
    for word in set(words):
        if 4 * len(word) > LONGEST_WORD and len(bare := _bare(word)) > LONGEST_WORD:
            marked = b"^%b$" % bare
            cut[word] = [marked[i : i + size] for i in range(0, len(marked) - max(GRAMS), size - max(GRAMS))]
    return [x for word in words for x in cut.get(word, (word,))] if cut else words


def word_slots(words: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of words, those of their n-grams of bytes end to end, and where each word's begin.

    Case and outer punctuation don't count.  A word is marked at both ends, so
    that it has an n-gram even if it is one character; parts of a long word, as
    bytes, have their marks.  Many words are hashed a part at a time.
    """
    if len(words) > WORDS_AT_ONCE:
        parts = [word_slots(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        counts = np.concatenate([np.diff(starts) for *_, starts in parts])
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(counts)])
    bare = [x if isinstance(x, bytes) else _bare(x) for x in words]
    own = np.fromiter(map(zlib.crc32, bare), dtype=np.int64, count=len(bare)) % WORD_ROWS
    marked = [x if isinstance(w, bytes) else b"^%b$" % x for w, x in zip(words, bare, strict=True)]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    width = max(int(sizes.max()), max(GRAMS))
    chars = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in marked), dtype=np.uint8).reshape(-1, width).astype(np.uint32)
    hashes, inside = [], []
    rolled = np.zeros_like(chars)
    for n in range(1, max(GRAMS) + 1):
        m = width - n + 1
        rolled = rolled[:, :m] * _BASE + chars[:, n - 1 :] + np.uint32(1)
        if n in GRAMS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            hashes.append((mixed >> np.uint32(12)) % np.uint32(GRAM_ROWS))
            inside.append(np.arange(m) + n <= sizes[:, None])
    inside = np.concatenate(inside, 1)
    grams = np.concatenate(hashes, 1)[inside].astype(np.int32)
    counts = inside.sum(1)
    return own, grams, np.concatenate([[0], np.cumsum(counts)])


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n words: every STRIDE words, the last one flush with the end."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    return starts if starts[-1] == n - WINDOW else [*starts, n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters, the forward pass and its gradients."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)

        def normal(*shape, scale):
            return r.normal(0, scale, shape).astype(np.float32)

        inputs = WORD_DIM + GRAM_DIM
        self.p = {
            "word": normal(WORD_ROWS, WORD_DIM, scale=0.05), "gram": normal(GRAM_ROWS, GRAM_DIM, scale=0.05),
            "attend": normal(2 * HIDDEN, ATTENTION, scale=0.3), "attend_b": np.zeros(ATTENTION, np.float32), "query": normal(ATTENTION, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"in_{d}": normal(inputs, 3 * HIDDEN, scale=0.4), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"state_{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3)}

    def vectors(self, slots: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vectors of words: the word's embedding, and the mean of its n-grams' with their largest in the first place."""
        words, flat, starts = slots
        grams = self.p["gram"][flat]
        pooled = np.add.reduceat(grams, starts[:-1]) / np.diff(starts)[:, None]
        pooled[:, 0] = np.maximum.reduceat(np.ascontiguousarray(grams[:, 0]), starts[:-1])
        return np.concatenate([self.p["word"][words], pooled], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of word vectors; done once a distinct word."""
        p = self.p
        return np.concatenate([x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]], 1)

    def forward(self, gates: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows.  gates: of distinct words; at: [window, position] into them; size: words of each window."""
        p, (count, length) = self.p, at.shape
        both = np.empty((length, count, 2 * HIDDEN), np.float32)
        saved = {"f": [None] * length, "b": [None] * length}
        steps = np.ascontiguousarray(at.T)
        full = size.min() >= length
        for d, name in enumerate("fb"):
            own = np.ascontiguousarray(gates[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN])
            own[:, : 2 * HIDDEN] *= 0.5  # a sigmoid is a tanh of half its input
            u = p[f"state_{name}"]
            u_zr, u_c, h = np.ascontiguousarray(u[:, : 2 * HIDDEN]) * np.float32(0.5), np.ascontiguousarray(u[:, 2 * HIDDEN :]), np.zeros((count, HIDDEN), np.float32)
            for t in range(length) if name == "f" else reversed(range(length)):
                g = own[steps[t]]
                zr = h @ u_zr
                zr += g[:, : 2 * HIDDEN]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = (r * h) @ u_c
                c += g[:, 2 * HIDDEN :]
                np.tanh(c, out=c)
                new = c - h
                new *= z
                new += h
                inside = None
                if not full:
                    inside = t < size
                    new = np.where(inside[:, None], new, h)
                if keep:
                    saved[name][t] = (h, z, r, c, inside if inside is not None else np.ones(count, bool))
                h = new
                both[t, :, d * HIDDEN : (d + 1) * HIDDEN] = new
        hidden = both.reshape(-1, 2 * HIDDEN) @ p["attend"]
        hidden += p["attend_b"]
        np.tanh(hidden, out=hidden)
        weight = (hidden @ p["query"]).reshape(length, count)
        hidden = hidden.reshape(length, count, ATTENTION)
        if not full:
            weight = np.where(np.arange(length)[:, None] < size, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        if not keep:  # pooled states times the output weights, with the sum over states done first
            return (weight * (both.reshape(-1, 2 * HIDDEN) @ p["out"]).reshape(length, count)).sum(0) + p["out_b"]
        pooled = (weight[..., None] * both).sum(0)
        return pooled @ p["out"] + p["out_b"], (saved, both, hidden, weight, pooled)

    def backward(self, at: np.ndarray, cache, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but the embeddings, and of the gate inputs at every [window, position]."""
        p, (saved, both, hidden, weight, pooled) = self.p, cache
        count, length = at.shape
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (both * d_pooled).sum(-1)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_hidden = d_score[..., None] * p["query"] * (1 - hidden**2)
        g["query"] = (hidden * d_score[..., None]).sum((0, 1))
        g["attend"] = both.reshape(-1, 2 * HIDDEN).T @ d_hidden.reshape(-1, ATTENTION)
        g["attend_b"] = d_hidden.sum((0, 1))
        d_both = weight[..., None] * d_pooled + d_hidden @ p["attend"].T
        d_gates = np.zeros((count, length, 6 * HIDDEN), np.float32)
        for d, name in enumerate("fb"):
            u = p[f"state_{name}"]
            du, dh = np.zeros_like(u), np.zeros((count, HIDDEN), np.float32)
            for t in reversed(range(length)) if name == "f" else range(length):
                h, z, r, c, inside = saved[name][t]
                dh = dh + d_both[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                own = np.where(inside[:, None], dh, 0)
                dc = own * z * (1 - c**2)
                dz = own * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                du[:, : 2 * HIDDEN] += h.T @ np.concatenate([dz, dr], 1)
                du[:, 2 * HIDDEN :] += (r * h).T @ dc
                d_gates[:, t, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dc], 1)
                dh = np.where(inside[:, None], own * (1 - z) + drh * r + np.concatenate([dz, dr], 1) @ u[:, : 2 * HIDDEN].T, dh)
            g[f"state_{name}"] = du
        return g, d_gates


def train(rows: list[tuple[str, int]], seed: int = SEED) -> Network:
    """A network fitted to (text, label) rows; with no rows or one class it stays near its start."""
    net = Network(seed)
    table: dict[str, int] = {}
    docs, labels = [], []
    for text, label in rows:
        ids = np.array([table.setdefault(w, len(table)) for w in positions(text or "")], dtype=np.int64)
        if len(ids):
            docs.append(ids)
            labels.append(label)
    if not docs:
        return net
    slots = word_slots(list(table))
    y = np.array(labels, np.float32)
    _start(net, slots, docs, y)
    owner, at, size = _cut(docs)
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("word", "gram")}
    fast = {k: np.zeros(len(net.p[k]), np.float32) for k in ("word", "gram")}
    r, step = np.random.default_rng(seed), 0
    share = max(1.0, y.sum()) / len(y)
    class_weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    for _ in range(min(PASSES[1], max(PASSES[0], STEPS * BATCH // len(docs)))):
        parts = [np.arange(i, min(i + WORDS_AT_ONCE, len(table))) for i in range(0, len(table), WORDS_AT_ONCE)]
        gates = np.concatenate([net.gates(net.vectors(_of(slots, part))) for part in parts])
        score = np.concatenate([net.forward(gates, at[i : i + WINDOWS_AT_ONCE], size[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(at), WINDOWS_AT_ONCE)])
        ranked = np.lexsort((-score, owner))
        best = ranked[np.concatenate([[True], owner[ranked][1:] != owner[ranked][:-1]])]
        order = r.permutation(len(best))
        for i in range(0, len(order), BATCH):
            own = best[order[i : i + BATCH]]
            who = owner[own]
            used, where = np.unique(at[own], return_inverse=True)
            part = _of(slots, used)
            x = net.vectors(part)
            logits, cache = net.forward(net.gates(x), where.reshape(at[own].shape), size[own], keep=True)
            d = ((sigmoid(logits) - y[who]) * class_weight[who] / len(own)).astype(np.float32)
            g, d_gates = net.backward(at[own], cache, d)
            sums = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(sums, where.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
            dx = np.zeros_like(x)
            for k, name in enumerate("fb"):
                own_sums = sums[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
                g[f"in_{name}"], g[f"bias_{name}"] = x.T @ own_sums, own_sums.sum(0)
                dx += own_sums @ net.p[f"in_{name}"].T
            step += 1
            for k, grad in g.items():
                m, v = adam[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6) + DECAY * net.p[k]).astype(np.float32)
            _embed(net.p["word"], fast["word"], part[0], dx[:, :WORD_DIM])
            counts = np.diff(part[2])
            _embed(net.p["gram"], fast["gram"], part[1], np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0))
    return net


def _of(slots: tuple[np.ndarray, np.ndarray, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of some of the words."""
    words, flat, starts = slots
    counts = starts[used + 1] - starts[used]
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(starts[used], counts)
    return words[used], flat[at], np.concatenate([[0], ends])


def _embed(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """An AdaGrad step for the rows of a table of embeddings, one rate a row."""
    used, where = np.unique(rows, return_inverse=True)
    total = np.zeros((len(used), table.shape[1]), np.float32)
    np.add.at(total, where, grad)
    seen[used] += (total**2).mean(1)
    table[used] -= RATE * total / (np.sqrt(seen[used]) + 1e-6)[:, None]


def _start(net: Network, slots, docs, y) -> None:
    """Class log-odds, from the documents that hold a word or n-gram, as the first number of its embedding."""
    held = np.zeros((2, WORD_ROWS)), np.zeros((2, GRAM_ROWS))
    total = np.array([(y == 0).sum(), (y == 1).sum()]) + 1.0
    for ids, label in zip(docs, y.astype(int), strict=True):
        words, grams, _ = _of(slots, np.unique(ids))
        held[0][label][np.unique(words)] += 1
        held[1][label][np.unique(grams)] += 1
    for table, counts in zip(("word", "gram"), held, strict=True):
        odds = np.log((counts[1] + 0.5) / total[1]) - np.log((counts[0] + 0.5) / total[0])
        sure = (counts.sum(0) / (counts.sum(0) + 2.0)).astype(np.float32)
        net.p[table][:, 0] = np.clip(odds * sure, -3, 5) / 2
    for d in "fb":  # states start out following these numbers
        net.p[f"in_{d}"][0, 2 * HIDDEN :] += 0.5
        net.p[f"in_{d}"][WORD_DIM, 2 * HIDDEN :] += 0.5
    net.p["out"][:] = np.abs(net.p["out"])
    net.p["out_b"][:] = -1


def _cut(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word ids padded to WINDOW, words) of all windows of some documents."""
    owner, at, size = [], [], []
    for k, ids in enumerate(docs):
        starts = windows(len(ids))
        n = min(len(ids), WINDOW)
        part = np.zeros((len(starts), WINDOW), np.int64)
        part[:, :n] = ids[np.array(starts, dtype=np.int64)[:, None] + np.arange(n)]
        owner.append(np.full(len(starts), k))
        at.append(part)
        size.append(np.full(len(starts), n))
    return np.concatenate(owner), np.concatenate(at), np.concatenate(size)


class Scorer:
    """Scores texts with a network; keeps the gate inputs of up to KEPT distinct words."""

    def __init__(self, net: Network):
        self.net, self.table = net, {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)
        self.used = 0

    def _ids(self, texts: list[list[str | bytes]]) -> list[np.ndarray]:
        if self.used > KEPT:
            self.table.clear()
            self.used = 0
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.table]
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            rows = self.net.gates(self.net.vectors(word_slots(part)))
            if self.used + len(rows) > len(self.gates):
                self.gates = np.concatenate([self.gates[: self.used], np.zeros((max(len(rows), self.used, 50_000), 6 * HIDDEN), np.float32)])
            self.gates[self.used : self.used + len(rows)] = rows
            self.table.update(zip(part, range(self.used, self.used + len(rows)), strict=True))
            self.used += len(rows)
        return [np.fromiter(map(self.table.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text, that of its worst window."""
        words = [positions(t or "") for t in texts]
        ids = self._ids(words)
        out = np.full(len(texts), EMPTY_SCORE)
        filled = [k for k, x in enumerate(ids) if len(x)]
        if not filled:
            return out
        owner, at, size = _cut([ids[k] for k in filled])
        logits = np.concatenate([self.net.forward(self.gates, at[i : i + WINDOWS_AT_ONCE], size[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(at), WINDOWS_AT_ONCE)])
        worst = np.full(len(filled), -np.inf)
        np.maximum.at(worst, owner, logits)
        out[filled] = sigmoid(worst)
        return out


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _shared(spark, net: Network):
    return spark.sparkContext.broadcast(net)


def toxicity_scores(docs: DataFrame, net: Network, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Null and empty texts, and those of white space, score EMPTY_SCORE.  Null
    doc_id: a row, held out where the condition is true.  Repeated rows: a row
    each.  Empty table: no rows.  Other columns aren't read.  The network, of a
    fixed size of about 2 MB, is broadcast.  A very long text is scored whole;
    its word numbers are in memory, its windows some thousands at a time.
    """
    shared = _shared(docs.sparkSession, net)

    def run(batches):
        own = Scorer(shared.value)
        for batch in slices(batches, 64):
            score = own.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return map_batches(rows, run, SCHEMA)


def classify_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Fit on a bounded sample of the labels that aren't held out and score all of ``docs``."""
    return toxicity_scores(docs, train(training_rows(docs, labels, "toxic", ~held_out, rows_per_class)), held_out)


def keep_civil(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names.

    Null and empty texts, and those of white space, score EMPTY_SCORE and stay.
    A very long text is scored by all its windows, some thousands in memory at a
    time.  A score of the threshold itself goes.  Rows are judged alone, so
    repeated ones stay or go together.  Empty table: no rows.
    """
    shared = _shared(docs.sparkSession, net)

    def run(batches):
        own = Scorer(shared.value)
        for batch in slices(batches, 64):
            yield batch.filter(pa.array(own.scores(batch.column(batch.schema.names.index("text")).to_pylist()) < threshold))

    return map_batches(docs, run, docs.schema)
