"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over a document's word ids measure how
many of its characters lie inside duplicated n-grams, and line hashes how many
lie in duplicated lines.  A document is rejected where a share is too large.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.shared import WORD, map_batches, slices

#: The largest share of characters in duplicated n-grams that a kept document may have, by n (published repetition filters for web text).
DUPLICATE_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The largest share of the characters in the most frequent n-gram, by n.
TOP_NGRAM_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of lines that repeat an earlier one, of their characters, and of symbols to words.
DUPLICATE_LINE_SHARE, DUPLICATE_LINE_CHARS, SYMBOLS_PER_WORD = 0.30, 0.20, 0.10
#: Base rules of the contract.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word id, well spread."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which values occur twice or more; of each repeated value the first index in sorted order, and its count."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    mask = np.zeros(len(values), dtype=bool)
    if not same.any():
        return mask, order[:0], order[:0]
    in_run = np.zeros(len(values), dtype=bool)
    in_run[1:] |= same
    in_run[:-1] |= same
    mask[order[in_run]] = True
    starts = np.flatnonzero(in_run & ~np.concatenate([[False], same]))
    ends = np.flatnonzero(in_run & ~np.concatenate([same, [False]]))
    return mask, order[starts], ends - starts + 1


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words that begins at one of ``starts``."""
    edges = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(edges[:size]) > 0


def repeated_windows(ids: np.ndarray, distinct: int, longest: int):
    """(n, starts, firsts, counts) for n = 2, 3, ...: where windows of n words begin that occur twice or more.

    A window of n words is only repeated where its first n - 1 words are, so
    each length hashes just the windows that the shorter one left.  Up to three
    words the number of a window is exact; a longer one's rolls on from it.
    """
    n = len(ids)
    at, key, wide = np.arange(n), ids, distinct < 1 << 21
    for size in range(2, longest + 1):
        inside = at + size <= n
        at, key = at[inside], key[inside]
        if size <= 3:
            key = (key << 21) | ids[at + size - 1] if wide else np.unique(np.stack([key, ids[at + size - 1]]), axis=1, return_inverse=True)[1].ravel() if len(at) else key
        else:
            key = (key if size > 4 else _mixed(key)) * _BASE + _mixed(ids[at + size - 1])
        mask, firsts, counts = repeats(key)
        firsts = at[firsts]
        at, key = at[mask], key[mask]
        yield size, at, firsts, counts
        if not len(at):
            return


def split_words(text: str) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def measure(text: str | None) -> dict:
    """All counts and shares of one text; a null text counts as empty."""
    text = text or ""
    words = split_words(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(lengths.sum())
    table = dict.fromkeys(words)
    table = dict(zip(table, range(len(table)), strict=True))
    ids = np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup_lines = len(lines) - len(set(lines))
    in_words = lambda xs: sum(len(w) for x in xs for w in WORD.findall(x))
    dup_line_chars = in_words(lines) - in_words(set(lines)) if dup_lines else 0
    repeat_words, top, dup = 0, dict.fromkeys(TOP_NGRAM_SHARE, 0.0), dict.fromkeys(DUPLICATE_NGRAM_SHARE, 0.0)
    before = None
    for size, starts, firsts, counts in repeated_windows(ids, len(table), max(DUPLICATE_NGRAM_SHARE)):
        if not len(starts):
            break
        if size == 3:
            repeat_words = int(covered(starts, 3, n).sum())
        if size in TOP_NGRAM_SHARE:
            if before is None:
                before = np.concatenate([[0], np.cumsum(lengths)])
            best = firsts[counts == counts.max()]
            top[size] = float((before[best + size] - before[best]).max() * counts.max()) / chars
        if size in DUPLICATE_NGRAM_SHARE:
            dup[size] = float(lengths[covered(starts, size, n)].sum()) / chars
    symbols = len(SYMBOL.findall(text))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "n_lines": len(lines),
        "dup_line_chars": dup_line_chars, "top_ngram_share": top, "dup_ngram_share": dup,
    }


def verdict(m: dict) -> tuple[bool, bool, str]:
    """(base_failed, kept, first reason of a rejection or '')."""
    n = m["n_words"]
    base = n < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * n
    why = "base" if base else ""
    if not why and m["n_symbols"] > SYMBOLS_PER_WORD * n:
        why = "symbols"
    if not why and m["n_dup_lines"] > DUPLICATE_LINE_SHARE * m["n_lines"]:
        why = "duplicate_lines"
    if not why and m["dup_line_chars"] > DUPLICATE_LINE_CHARS * max(m["word_chars"], 1):
        why = "duplicate_line_chars"
    if not why:
        why = next((f"top_{k}_gram" for k, most in TOP_NGRAM_SHARE.items() if m["top_ngram_share"][k] > most), "")
    if not why:
        why = next((f"duplicate_{k}_grams" for k, most in DUPLICATE_NGRAM_SHARE.items() if m["dup_ngram_share"][k] > most), "")
    return base, not why, why


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, reason string, dup_line_chars long, top_ngram_share double, dup_ngram_share double"
)


def _rows(batches):
    for batch in slices(batches):
        found = [measure(t) for t in batch.column(1).to_pylist()]
        said = [verdict(m) for m in found]
        longs = [pa.array([m[k] for m in found], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()), *longs,
                pa.array([s[0] for s in said], pa.bool_()), pa.array([s[1] for s in said], pa.bool_()), pa.array([s[2] for s in said], pa.string()),
                pa.array([m["dup_line_chars"] for m in found], pa.int64()),
                pa.array([max(m["top_ngram_share"].values()) for m in found], pa.float64()),
                pa.array([max(m["dup_ngram_share"].values()) for m in found], pa.float64()),
            ],
            names=[f.split()[0] for f in SCHEMA.split(", ")],
        )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of counts, shares and a verdict for each row of ``docs`` (doc_id, text, ...).

    Null text: an empty one, so no words and base_failed.  Null or repeated
    doc_id: a row for each row.  Empty table: no rows.  Other columns, whatever
    their names, aren't read.  Very long texts are measured whole; the work is
    n log n in their words.  It is one pass without a shuffle.
    """
    return map_batches(docs.select("doc_id", "text"), _rows, SCHEMA)


def _kept(batches):
    for batch in slices(batches):
        yield batch.filter(pa.array([verdict(measure(t))[1] for t in batch.column(batch.schema.names.index("text")).to_pylist()], pa.bool_()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Null and empty texts, and those of white space, go: they have too few words.
    Very long texts are measured whole.  Rows are judged alone, so repeated rows
    and ties stay or go together.  Empty table: no rows.
    """
    from pyspark.sql.types import StructType

    ship_schema = StructType.fromJson(docs.schema.jsonValue())
    return map_batches(docs, _kept, ship_schema)
