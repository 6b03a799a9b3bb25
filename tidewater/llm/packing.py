"""Hierarchical multi-length packing of token ids into sequences.

Context sizes are tiers, each a power of two.  A document fills as many of the
longest windows as it can; what is left of it is routed to the smallest tier
that holds it.  Each tier, longest first, opens a window for its largest
remainder and fills the gap with the largest remainders of shorter tiers that
fit; the last of them is cut to close the window.  Full windows of any tier
need no padding, so a task pads one sequence at most.  Windows are dealt to
step groups of equal numbers of tokens, whose last ones in a task tiers share.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.bpe import encoder
from tidewater.llm.shared import map_batches, slices

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of remainders that a task holds before it packs them.
HELD_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 17
#: Bits of sequence_id and step_group that count within a task.
TASK_BITS = 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Packer:
    """Packs one task's documents; sequences come out as lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, -document, start), sorted
        self.held = 0

    def add(self, doc: int, n: int):
        """Route a document of n tokens; yields the longest windows that it fills by itself."""
        longest, at = self.tiers[-1], 0
        while n - at >= longest:
            yield longest, [(doc, at, longest)]
            at += longest
        if n - at:
            self._route(doc, at, n - at)

    def _route(self, doc: int, start: int, length: int) -> None:
        k = next(i for i, t in enumerate(self.tiers) if length <= t)
        insort(self.pools[k], (length, -doc, start))
        self.held += length

    def _take(self, k: int, i: int) -> tuple[int, int, int]:
        item = self.pools[k].pop(i)
        self.held -= item[0]
        return item

    def _fitting(self, k: int, gap: int) -> tuple[int, int] | None:
        """Where the largest remainder of tier k or a shorter one is that fits the gap."""
        for j in range(k, -1, -1):
            i = bisect_right(self.pools[j], (gap, 1))
            if i:
                return j, i - 1
        return None

    def pack(self):
        """Close all windows that can be filled; yields (tier, pieces)."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            while self.pools[k] and sum_at_least(self.pools, k, size):
                length, doc, start = self._take(k, -1)
                window, gap = [(-doc, start, length)], size - length
                while gap:
                    if (found := self._fitting(k, gap)) is not None:
                        length, doc, start = self._take(*found)
                    else:  # all that is left is longer than the gap: cut the shortest
                        j = next(j for j in range(k + 1) if self.pools[j])
                        length, doc, start = self._take(j, 0)
                        self._route(-doc, start + gap, length - gap)
                        length = gap
                    window.append((-doc, start, length))
                    gap -= length
                yield size, window

    def rest(self):
        """The last remainders, less than the window they'd open: as full windows of shorter tiers, then one that is padded."""
        items = [x for pool in reversed(self.pools) for x in reversed(pool)]
        self.pools, self.held = [[] for _ in self.tiers], 0
        total = sum(x[0] for x in items)
        sizes = []
        for t in reversed(self.tiers):
            while total >= t:
                sizes.append(t)
                total -= t
        if total:
            sizes.append(total)
        items = [(-doc, start, length) for length, doc, start in items]
        for size in sizes:
            window, gap = [], size
            while gap:
                doc, start, length = items.pop(0)
                if length > gap:
                    items.insert(0, (doc, start + gap, length - gap))
                    length = gap
                window.append((doc, start, length))
                gap -= length
            yield next((t for t in self.tiers if t >= size), self.tiers[-1]), window


def sum_at_least(pools: list[list[tuple[int, int, int]]], k: int, size: int) -> bool:
    """Whether the tiers up to k hold enough tokens to fill a window."""
    total = 0
    for j in range(k, -1, -1):
        for item in reversed(pools[j]):
            total += item[0]
            if total >= size:
                return True
    return False


class Steps:
    """Step groups of equal tokens: of one tier each, and at the end of what is left of all tiers, so that one at most is short."""

    def __init__(self, tokens: int = STEP_TOKENS):
        self.tokens, self.open, self.next = tokens, {}, 0

    def add(self, tier: int, window: list) -> list[tuple[int, list]]:
        """Hold a window; (group, window) for those of a group that it fills."""
        held = self.open.setdefault(tier, [])
        held.append(window)
        return self._close(tier) if (len(held) + 1) * tier > self.tokens else []

    def _close(self, tier: int) -> list[tuple[int, list]]:
        self.next += 1
        return [(self.next - 1, window) for window in self.open.pop(tier)]

    def rest(self) -> list[tuple[int, list]]:
        """The windows that are held, longest first, in groups that tiers share."""
        out, total = [], 0
        for tier, window in sorted(((t, w) for t, ws in self.open.items() for w in ws), key=lambda x: -x[0]):
            if total + tier > self.tokens and total:
                self.next, total = self.next + 1, 0
            out.append((self.next, window))
            total += tier
        self.open = {}
        self.next += 1
        return out


def _pack(path: str | None, end_id: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        own, packer, steps = encoder(path), Packer(tiers), Steps(step_tokens)
        base = TaskContext.get().partitionId() << TASK_BITS
        end = np.array([end_id], dtype="<u4").tobytes()
        docs: dict[int, tuple[int | None, bytes]] = {}  # those that still have tokens outside a sequence
        left: dict[int, int] = {}
        n = sequence = 0
        out: list[tuple] = []

        def emit(closed):
            for group, rows in closed:
                out.extend((*row, base + group, part) if with_ids else (*row, base + group) for row, part in rows)

        def place(found):
            nonlocal sequence
            for tier, window in found:
                offset, rows = 0, []
                for doc, start, length in window:
                    doc_id, ids = docs[doc]
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), len(ids) // 4, base + sequence, offset, tier)
                    rows.append((row, part if with_ids else None))
                    offset += length
                    left[doc] -= length
                    if not left[doc]:
                        del left[doc], docs[doc]
                sequence += 1
                emit(steps.add(tier, rows))

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * (9 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:9]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in columns[9]], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.encode(text) + end
                docs[n], left[n] = (doc_id, ids), len(ids) // 4
                place(packer.add(n, len(ids) // 4))
                n += 1
            if packer.held >= HELD_TOKENS:
                place(packer.pack())
            if len(out) >= 2000:
                yield flush()
        place(packer.pack())
        place(packer.rest())
        emit(steps.rest())
        yield flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False
) -> DataFrame:
    """One row for each piece of each document in its sequence; with ``with_ids`` also the piece's ids.

    Null text: an empty one, so a piece of the end id alone.  Null or repeated
    doc_ids: each row is a document.  Empty table: no rows.  Other columns
    aren't read.  A document longer than the longest window is cut into full
    windows first.  It is one pass without a shuffle; a task holds about
    HELD_TOKENS tokens of remainders and a step group of each tier.  Copies of a
    text are packed apart.  All step groups but one a task have the same tokens.
    """
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _pack(tokenizer, end_id, tiers, step_tokens, with_ids), SCHEMA + ", ids array<int>" * with_ids)
