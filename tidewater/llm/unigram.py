"""A unigram model over a public vocabulary of pieces, and its token counts.

The vocabulary file ranks its pieces; a piece's log-probability is that of a
Zipf-Mandelbrot law of its rank.  A text is a space and then itself; a piece
never holds a space after another character, nor a line feed, so pre-tokens
(spaces and what follows, or a line feed) are segmented apart.  A character
without a piece is its UTF-8 bytes, each a piece of the last rank.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import map_batches, slices

#: Fixed value: how a vocabulary writes a space.
SPACE = "▁"
#: The shift of the Zipf-Mandelbrot law.
SHIFT = 2.7
#: Trie nodes, and characters of pre-tokens with their counts, that a process keeps; the trie goes beyond by one pre-token at most.
TRIE_NODES, KEPT_CHARS = 400_000, 3_000_000

_PRE = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Vocabulary:
    """Pieces with spaces as spaces, their ids and log-probabilities, and bytes' ids."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.id_of, self.score, self.text_of = {}, {}, [b""] * size
        for b, i in self.bytes.items():
            self.text_of[i] = bytes([b])
        for i in range(size):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace(SPACE, " ")
                self.id_of[piece], self.text_of[i] = i, piece.encode()
        self.texts = np.array([*self.text_of, None], dtype=object)[:-1]
        total = math.log(sum(1 / (r + SHIFT) for r in range(1, len(self.id_of) + 2)))
        for rank, piece in enumerate(sorted(self.id_of, key=self.id_of.get), 1):
            self.score[piece] = -math.log(rank + SHIFT) - total
        self.byte_score = -math.log(len(self.id_of) + 1 + SHIFT) - total
        self.longest = max(map(len, self.id_of))
        #: Scores of the pieces by text, and -inf for what only ends one: no piece ends with what isn't here.
        self.endings = {piece[n:]: -math.inf for piece in self.id_of for n in range(1, len(piece))} | self.score

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        """The text of ids: the pieces' bytes without the space in front."""
        return b"".join(self.texts[np.asarray(ids, np.int64)].tolist())[1:].decode("utf-8", "surrogatepass")


_VOCABULARIES: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def pre_tokens(text: str) -> list[str]:
    """Spaces and what follows them, what follows a line feed, and line feeds, of a space and the text; none of an empty text."""
    if not text:
        return []
    text = " " + text
    if "  " in text or "\0" in text:
        return _PRE.findall(text)
    return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


class Trie:
    """Distinct pre-tokens by their characters; a node has the best score of its prefix and that segmentation's pieces.

    A prefix that pre-tokens share is one node, whose score is computed once
    from those of the nodes above it; terminals keep counts.  Of equal scores
    the fewest pieces win.
    """

    def __init__(self, words: Vocabulary, most_nodes: int = TRIE_NODES):
        self.words, self.most_nodes = words, most_nodes
        self.computed = 0  # forward scores, for the tests
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, text: str) -> tuple[float, int]:
        """(best score, pieces) of a pre-token."""
        if len(self.best) >= self.most_nodes:
            self.clear()
        children, path, node = self.children, [0], 0
        for char in text:
            child = children.get((node, char))
            if child is None:
                break
            path.append(child)
            node = child
        if len(path) <= len(text):
            self._grow(text, path)
        return self.best[path[-1]], self.count[path[-1]]

    def _grow(self, text: str, path: list[int]) -> None:
        """Add the nodes of a pre-token below ``path``, each with its best score and pieces from those of the shorter prefixes."""
        score, endings, children = self.words.score.get, self.words.endings.get, self.children
        known = len(path)
        best, count, node = [self.best[n] for n in path], [self.count[n] for n in path], path[-1]
        for at in range(known, len(text) + 1):
            found, n = -math.inf, 0
            for k in range(at - 1, -1, -1):
                s = endings(text[k:at])
                if s is None:  # nor does a longer one end a piece
                    break
                s += best[k]
                if s > found or s == found and count[k] + 1 < n:
                    found, n = s, count[k] + 1
            char = text[at - 1]
            if score(char) is None:
                size = len(char.encode("utf-8", "surrogatepass"))
                s = best[at - 1] + size * self.words.byte_score
                if s > found or s == found and count[at - 1] + size < n:
                    found, n = s, count[at - 1] + size
            best.append(found)
            count.append(n)
            child = children[node, char] = len(self.best)
            path.append(child)
            node = child
            self.best.append(found)
            self.count.append(n)
        self.computed += len(path) - known


class Counter(dict):
    """Pre-token to its number of pieces, by the trie; bounded."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.trie, self.chars = Trie(words), 0

    def __missing__(self, text: str) -> int:
        if self.chars >= KEPT_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(text)
        n = self[text] = self.trie.insert(text)[1]
        return n


_COUNTERS: dict[str | None, Counter] = {}


def counter(path: str | None = None) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


SCHEMA = "doc_id long, n_pre_tokens long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_pre_tokens and n_tokens, the pieces of the best segmentation, for each row of ``docs``.

    Null and empty texts have none.  Null or repeated doc_ids: a row each.
    Empty table: no rows.  Other columns aren't read.  It is one pass without a
    shuffle; the trie and the kept counts are bounded, so a very long text costs
    the memory of its longest pre-token beside that.
    """

    def run(batches):
        counts = counter(vocabulary_path)
        for batch in slices(batches):
            parts = [pre_tokens(t or "") for t in batch.column(1).to_pylist()]
            totals = [sum(map(counts.__getitem__, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, parts), pa.int64()), pa.array(totals, pa.int64())], [f.split()[0] for f in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
