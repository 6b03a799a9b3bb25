"""Distinct sampled segmentations by Gumbel top-k, and decoding.

A text's lattice has a node at every character and an edge for every piece of
the unigram model.  Backward sums turn edges into the model's conditional
probabilities, so a path from the left is a segmentation with its probability.
Sampling without replacement is a best-first search over prefixes of paths: the
priority of a set of paths is the largest perturbed log-probability in it,
drawn top-down (Kool et al., "Stochastic Beams and Where to Find Them"; Maddison
et al., "A* Sampling").  When a path is taken, the sets of paths that leave it at
some step get their largest values, Gumbels cut off at that of the path, and as
many of them as can still matter go to the frontier.  The next path is the frontier's first set: its first
step is one of the edges that no earlier path took there, the rest is sampled.
The largest value left in the frontier is the threshold of the inclusion
probabilities.  Uniform numbers are hashes of the row's key, the sample, the
pre-token and the step, so a row's samples don't depend on its neighbours.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import map_batches, slices
from tidewater.llm.unigram import Vocabulary, pre_tokens, vocabulary

SAMPLES, SEED = 3, 17
#: Characters of the texts whose lattices are in memory together; a longer text is alone.
CHARS_AT_ONCE = 500_000
#: Nodes of lattices that a process keeps between slices of texts.
NODES_KEPT = 300_000
#: Log-probability below which what leaves a path can't be seen in 52-bit draws, and below which it isn't weighed at first.
UNSEEN, FAR = 40.0, 60.0
#: Log-probability of an edge above which those beside it are added up, as 1 less it is not exact.
NEAR_ONE = -1e-6
#: Sums of a lattice below which they and those before them are scaled.
TINY = 1e-200

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from integer keys."""
    return ((mix(keys * _A + np.uint64(1)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


class PieceTable:
    """The pieces and all their beginnings by a rolling hash of their characters, for look-ups of whole arrays."""

    #: What a beginning is that is no piece, and what is no beginning of any.
    BEGINNING, NOTHING = -1, -2

    def __init__(self, words: Vocabulary):
        self.words = words
        found = {piece[:n]: self.BEGINNING for piece in words.id_of for n in range(1, len(piece))} | words.id_of
        keys = np.array([self.key(p) for p in found], dtype=np.uint64)
        ids = np.fromiter(found.values(), dtype=np.int32)
        assert len(np.unique(keys)) == len(keys)
        self.bits = int(2 * len(keys)).bit_length()
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        self.slot_id = np.full(1 << self.bits, self.NOTHING, np.int32)
        self.chance = np.zeros(len(words.text_of))
        for piece, i in words.id_of.items():
            self.chance[i] = math.exp(words.score[piece])
        self.probes = 1
        for key, i in zip(keys.tolist(), ids.tolist(), strict=True):  # open addressing
            own = at = key >> (64 - self.bits)
            while self.slot_id[at] != self.NOTHING:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slot_key[at], self.slot_id[at] = key, i
            self.probes = max(self.probes, 1 + ((at - own) & ((1 << self.bits) - 1)))

    @staticmethod
    def key(piece: str) -> int:
        x = 0
        for c in piece:
            x = ((x + ord(c) + 1) * int(_A)) & (2**64 - 1)
            x ^= x >> 29
        return x

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of keys; BEGINNING or NOTHING where there is no such piece."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.slot_key[at]
        found = np.where(held == keys, self.slot_id[at], self.NOTHING)
        rest = np.flatnonzero((held != keys) & (held != 0))
        for k in range(1, self.probes):
            if not len(rest):
                break
            slot = (at[rest] + k) & ((1 << self.bits) - 1)
            held = self.slot_key[slot]
            hit = held == keys[rest]
            found[rest[hit]] = self.slot_id[slot[hit]]
            rest = rest[~hit & (held != 0)]
        return found


def passed(upto: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many numbers of each row are at most that of ``u``; rows are of a multiple of eight numbers."""
    eights = np.bitwise_count((upto <= u[:, None]).view(np.uint64))
    out = eights[:, 0].astype(np.int64)
    for k in range(1, eights.shape[1]):
        out += eights[:, k]
    return out


class Places(defaultdict):
    """Pre-token to its number, in the order in which they are met."""

    def __init__(self, names=()):
        super().__init__(None, zip(names, count(), strict=False))
        self.default_factory = count(len(self)).__next__

    def since(self, size: int) -> list[str]:
        """Those that were met after the first ``size``."""
        return list(islice(reversed(self), len(self) - size))[::-1]


class Lattices:
    """The lattices of distinct pre-tokens, kept from one call to the next; nodes of all of them end to end.

    Few pieces begin at a node, so its edges are numbered by their lengths:
    p[node, k]: probability of edge k, 0 where there is none; id[node, k]: its
    piece, or -2 minus the character for one that is bytes; size[node, k]: its
    characters (both anything where there is no edge); upto[node, k]:
    probability of the edges up to it, 2 from the last on.  Rows get wider when
    a node has more edges.  Beyond NODES_KEPT nodes only frequent pre-tokens
    are kept.
    """

    def __init__(self, table: PieceTable):
        self.table, self.longest = table, table.words.longest
        self.clear()

    def clear(self) -> None:
        self.index = Places()
        self.first, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.hits = np.zeros(0, np.int64)
        self.width = 8  # eight comparisons are counted as one number
        self.rows = self._room(2 * NODES_KEPT)

    @property
    def rows(self) -> tuple[np.ndarray, ...]:
        return self.id, self.p, self.upto, self.size

    @rows.setter
    def rows(self, rows: tuple[np.ndarray, ...]) -> None:
        self.id, self.p, self.upto, self.size = rows

    def _room(self, nodes: int) -> tuple[np.ndarray, ...]:
        return tuple(np.empty((nodes, self.width), kind) for kind in (np.int32, np.float64, np.float32, np.int16))

    def _reserve(self, nodes: int, edges: int) -> None:
        """Rows for so many nodes in all, of so many edges at most."""
        if nodes <= len(self.id) and edges <= self.width:
            return
        old, was = self.rows, self.width
        self.width = max(was, -(-edges // 8) * 8)
        self.rows = self._room(max(nodes, len(self.id)))
        for x, y, none in zip(old, self.rows, (-1, 0, 2, 0), strict=True):
            y[: self.used, :was], y[: self.used, was:] = x[: self.used], none

    def _forget(self) -> None:
        """Leave the most frequent pre-tokens that were met more than once, to half of the bound."""
        sizes = self.sizes
        often = np.argsort(-self.hits, kind="stable")
        often = often[(self.hits[often] > 1) & (np.cumsum(sizes[often]) <= NODES_KEPT // 2)]
        names, at = list(self.index), np.repeat(self.first[often] - np.cumsum(sizes[often]) + sizes[often], sizes[often])
        at += np.arange(len(at))
        old = self.rows
        if len(self.id) > 2 * NODES_KEPT:  # for one very long text
            self.rows = self._room(2 * NODES_KEPT)
        for x, y in zip(old, self.rows, strict=True):
            y[: len(at)] = np.take(x, at, axis=0)
        self.index = Places(names[i] for i in often.tolist())
        self.sizes = sizes[often]
        self.first, self.used = np.cumsum(self.sizes) - self.sizes, int(self.sizes.sum())
        self.hits = np.zeros(len(often), np.int64)

    def places(self, tokens: list[str]) -> np.ndarray:
        """The numbers of pre-tokens; those that are new are built."""
        if self.used > NODES_KEPT:
            self._forget()
        out = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if new := self.index.since(len(self.sizes)):
            self._build(new)
        self.hits += np.bincount(out, minlength=len(self.hits))
        return out

    def _build(self, texts: list[str]) -> None:
        """Add the lattices of texts, in order of their lengths.

        While they are weighed, nodes are in levels, by their characters to the
        end, the longest text first: a level's texts are the first of those of
        the level before it.  Edges are in order of nodes and lengths.
        """
        table, words, longest = self.table, self.table.words, self.longest
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(lengths, kind="stable")
        sizes, texts = lengths[order], list(map(texts.__getitem__, order.tolist()))
        ends = np.cumsum(sizes)
        n, m, most = int(ends[-1]), len(texts), int(sizes[-1])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        counts = np.cumsum(np.bincount(sizes)[::-1])[::-1]  # of each level; level 0 are the ends
        heads = np.cumsum(counts) - counts
        level = np.repeat(np.arange(most + 1), counts)[m:]
        line = np.arange(m, m + n) - heads[level]
        at = ends[::-1][line] - level  # the nodes' places in the texts
        inside, keys, to = np.arange(n), np.zeros(n, np.uint64), at
        degree, pieces, found_at = np.ones(n, np.int64), [], []  # each character is an edge
        for k in range(longest):
            keys = (keys + chars[to + k] + np.uint64(1)) * _A
            keys ^= keys >> np.uint64(29)
            found = table.find(keys)
            if k == 0:
                single = found
            else:
                hit = np.flatnonzero(found >= 0)
                own = inside[hit]
                pieces.append(found[hit])
                found_at.append((own, degree[own]))
                degree[own] += 1
            if k + 1 >= most:
                break
            ended = int(np.searchsorted(inside, heads[k + 2] - m))  # nodes of k + 1 characters come first
            more = ended + np.flatnonzero(found[ended:] != table.NOTHING)
            inside, keys, to = inside[more], keys[more], to[more]
            if not len(inside):
                break
        start = np.cumsum(degree) - degree
        edges = int(degree.sum())
        ids, length, rank = np.empty(edges, np.int32), np.ones(edges, np.int16), np.zeros(edges, np.int16)
        ids[start] = single
        for k, (found, (own, r)) in enumerate(zip(pieces, found_at, strict=True), 2):
            e = start[own] + r
            ids[e], length[e], rank[e] = found, k, r
        p = np.take(table.chance, ids, mode="clip")
        unknown = np.flatnonzero(single < 0)
        if len(unknown):
            c, e = chars[at[unknown]], start[unknown]
            ids[e] = -2 - c.astype(np.int64)
            p[e] = np.exp((1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)) * words.byte_score)
        to = heads[np.repeat(level, degree) - length] + np.repeat(line, degree)
        # backward sums by levels;
        # exponent: what the sums were scaled by, in steps that keep them far from the smallest numbers
        after, exponent, totals, scaled = np.ones(m + n), np.zeros(m + n, np.int64), np.empty(n), False
        cuts = np.append(start, edges)[heads[1:] - m].tolist() + [edges]
        begins, widths = heads.tolist(), counts.tolist()
        for d in range(1, most + 1):
            begin, size, a, b = begins[d], widths[d], cuts[d - 1], cuts[d]
            nxt = after[to[a:b]]
            scale = exponent[begins[d - 1] : begins[d - 1] + size]
            if scaled:  # later nodes were scaled less or as much
                nxt = np.ldexp(nxt, (scale[np.repeat(line[begin - m : begin - m + size], degree[begin - m : begin - m + size])] - exponent[to[a:b]]).clip(-2000, 2000).astype(np.int32))
            p[a:b] *= nxt
            total = totals[begin - m : begin - m + size] = np.add.reduceat(p[a:b], start[begin - m : begin - m + size] - a)
            if scaled or total.min() < TINY:
                scaled = True
                shift = np.frexp(total)[1]
                exponent[begin : begin + size] = scale - shift
                total = np.ldexp(total, -shift)
            after[begin : begin + size] = total
        p /= np.repeat(totals, degree)
        upto = p.copy()
        widest = int(degree.max())
        for r in range(1, widest):
            e = np.flatnonzero(rank == r)
            upto[e] += upto[e - 1]
        upto[start + degree - 1] = 2  # rounding mustn't lead beyond the last edge
        base = self.used
        self._reserve(base + n, widest)
        self.p[base : base + n], self.upto[base : base + n] = 0, 2
        flat = np.repeat((base + at) * self.width, degree) + rank
        for x, y in zip(self.rows, (ids, p, upto, length), strict=True):
            x.ravel()[flat] = y
        first = np.empty(len(texts), np.int64)
        first[order] = base + ends - sizes
        self.first, self.sizes, self.used = np.concatenate([self.first, first]), np.concatenate([self.sizes, lengths]), base + n
        self.hits = np.concatenate([self.hits, np.zeros(len(texts), np.int64)])

    def walk(self, pre: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample paths from a position of each pre-token to its end: the lines' numbers of steps, and the steps' edges in order of line and step.

        A line is a pre-token of the input, whose random numbers come from its
        key and the positions.  An edge is its node times the width, and its number there.
        """
        edges, lines = [], []
        began = self.first[pre]
        end = began + self.sizes[pre]
        live = np.flatnonzero(began + pos < end)
        own, stop, key = (began + pos)[live], end[live], (keys - began.astype(np.uint64))[live]
        steps = np.zeros(len(pre), np.int64)
        sizes = self.size.ravel()
        while len(live):
            u = uniform(key + own.astype(np.uint64)).astype(np.float32)
            edge = own * self.width + passed(np.take(self.upto, own, axis=0), u)
            lines.append(live)
            edges.append(edge)
            steps[live] += 1
            own = own + np.take(sizes, edge)
            more = np.flatnonzero(own < stop)
            live, own, stop, key = live[more], own[more], stop[more], key[more]
        start = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for r, (line, edge) in enumerate(zip(lines, edges, strict=True)):
            out[start[line] + r] = edge
        return steps, out


def cut_gumbel(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with these locations, given that they're at most ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        shift = location - top
        # -log(exp(-top) - log(u) exp(-location)), without overflow
        return top - np.logaddexp(0.0, np.log(-np.log(u)) - shift)


class Path:
    """A segmentation: its steps' lines, edges, log-probabilities and ids, and its perturbed value."""

    __slots__ = ("value", "lines", "edges", "logs", "ids", "begin", "before", "excluded", "key")

    def __init__(self, value, steps, begin, excluded, key):
        self.value, self.begin, self.excluded, self.key = value, begin, excluded, key
        self.lines, self.edges, self.logs, self.ids = steps
        self.before = float(self.logs[:begin].sum()) if begin else 0.0

    def until(self, far: float) -> int:
        """Steps from ``begin`` on until what is beyond has a probability of e ** -far at most, or all of them."""
        n = len(self.logs) - self.begin
        for size in (256, 4096):
            if n > size:
                at = int(np.searchsorted(-np.cumsum(self.logs[self.begin : self.begin + size]), far))
                if at < size:
                    return at + 1
        return n


def open_sets(paths: list[Path], lattices: Lattices, keep: int, far: float = FAR) -> list[list[tuple[float, int]]]:
    """For each path the ``keep`` largest of the sets of paths that leave it from its step ``begin`` on, as (perturbed value, step).

    The largest value among independent sets is that of their union, and it is
    the set's in proportion to their probabilities; the next largest is cut off
    there, among the sets that are left.  So one draw finds a set, and what
    leaves a path late is only weighed where it can matter: all sets from a step
    on have the probability of the steps before it at most.  Paths where that
    isn't below the resolution of the draws are weighed farther on.
    """
    out: list[list[tuple[float, int]]] = [[] for _ in paths]
    total = np.array([len(p.logs) - p.begin for p in paths], np.int64)
    sizes = np.array([p.until(far) for p in paths], np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    cut = [(p.begin, p.begin + n) for p, n in zip(paths, sizes.tolist(), strict=True)]
    edges, logs = (np.concatenate([getattr(p, name)[a:b] for p, (a, b) in zip(paths, cut, strict=True)]) for name in ("edges", "logs"))
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[filled]
    own = np.repeat(np.arange(len(filled)), sizes[filled])
    # the edges that no path took there
    rest = -np.expm1(logs)
    heads = [(at, paths[i].excluded) for at, i in zip(starts.tolist(), filled.tolist(), strict=True) if paths[i].excluded]
    near = logs > NEAR_ONE
    near[[at for at, _ in heads]] = True
    near = np.flatnonzero(near)
    nodes, own_edge = np.divmod(edges[near], lattices.width)
    several = np.flatnonzero(np.take(lattices.upto.ravel(), nodes * lattices.width) < 2)  # of one edge, nothing is beside it
    near, nodes, own_edge = near[several], nodes[several], own_edge[several]
    rows = np.take(lattices.p, nodes, axis=0)
    rows[np.arange(len(rows)), own_edge] = 0
    for row, (_, excluded) in zip(np.searchsorted(near, [at for at, _ in heads]).tolist(), heads, strict=True):
        rows[row, excluded] = 0
    rest[near] = rows.sum(1)
    with np.errstate(divide="ignore"):
        rest = np.log(rest)
    before = np.cumsum(logs) - logs
    shift = np.array([paths[i].before for i in filled.tolist()])
    upto = before - before[starts][own] + shift[own]
    lasts = ends[filled] - 1
    beyond = np.where(total[filled] > sizes[filled], upto[lasts] + logs[lasts], -np.inf)
    location = upto + rest
    top = np.array([paths[i].value for i in filled.tolist()])
    keys = np.array([paths[i].key for i in filled.tolist()], np.uint64)
    found: list[list[tuple[float, int]]] = [[] for _ in filled]
    live = np.ones(len(filled), bool)
    whole = np.zeros(len(filled), bool)
    for r in range(keep):
        most = np.maximum.reduceat(location, starts)
        # the sets beyond the window can't be told from rounding, or the path is weighed anew
        whole |= live & (beyond > np.where(most > -np.inf, most - UNSEEN, -np.inf))
        live &= (most > -np.inf) & ~whole
        if not live.any():
            break
        if r == 0 or (unit[live] - most[live] > UNSEEN).any():  # else the weights of the round before do, less the sets taken
            unit = np.where(live, most, np.inf)
            weight = np.exp(location - unit[own])
        sums = np.cumsum(weight)
        mass = np.add.reduceat(weight, starts)
        with np.errstate(divide="ignore"):
            value = cut_gumbel(np.where(live, unit, 0.0) + np.log(np.where(live, mass, 1.0)), top, uniform(keys + np.uint64(2 * r)))
        target = sums[starts] - weight[starts] + uniform(keys + np.uint64(2 * r + 1)) * mass
        at = np.clip(np.searchsorted(sums, target, side="right"), starts, lasts)
        # a set of no weight is taken by rounding only: the heaviest stands for it
        for j in np.flatnonzero(live & (weight[at] == 0)).tolist():
            at[j] = starts[j] + int(weight[starts[j] : ends[filled[j]]].argmax())
        for j in np.flatnonzero(live).tolist():
            found[j].append((float(value[j]), int(at[j] - starts[j]) + paths[filled[j]].begin))
        location[at[live]], weight[at[live]] = -np.inf, 0
        top = np.where(live, value, top)
    for j, i in enumerate(filled.tolist()):
        out[i] = found[j]
    again = filled[whole].tolist()
    if again:
        for i, sets in zip(again, open_sets([paths[i] for i in again], lattices, keep, 4 * far), strict=True):
            out[i] = sets
    return out


class Search:
    """The frontier of one text, and the paths taken."""

    def __init__(self):
        self.paths, self.frontier = [], []

    def take(self, path: Path, sets: list[tuple[float, int]], width: int) -> None:
        """Add a path and the sets that leave it."""
        n = len(self.paths)
        self.paths.append(path)
        self.frontier += [(g, n, s, [*(path.excluded if s == path.begin else []), int(path.edges[s]) % width]) for g, s in sets]
        self.frontier.sort(key=lambda x: -x[0])


def sample_texts(texts: list[str], keys: list[int], lattices: Lattices, k: int = SAMPLES, seed: int = SEED) -> list[list[dict]]:
    """For each text its sampled segmentations, best perturbed value first.

    Each has ids, log_prob, perturbed and inclusion.  Fewer than k where the
    text has no more; an empty text has one, of no pieces.
    """
    words = lattices.table.words
    parts = [pre_tokens(t) for t in texts]
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    offset = np.concatenate([[0], np.cumsum(counts)])
    flat = lattices.places(list(chain.from_iterable(parts)))
    row_keys = mix(np.array([x & (2**64 - 1) for x in keys], dtype=np.uint64) + np.array([seed], np.uint64) * _A)
    token_keys = mix(np.repeat(row_keys, counts) + (np.arange(len(flat)) - np.repeat(offset[:-1], counts)).astype(np.uint64) * _C)
    searches = [Search() for _ in texts]

    def path_keys(sample: int) -> np.ndarray:
        return mix(row_keys + np.array([1_000_003 + sample], np.uint64) * _B)

    def walked(lines: np.ndarray, pos: np.ndarray, sample: int):
        """Where each line's steps begin, and the end of the last's; and the steps."""
        steps, edges = lattices.walk(flat[lines], pos, mix(token_keys[lines] + np.array([sample + 1], np.uint64) * _B))
        return np.append(0, np.cumsum(steps)), (np.repeat(lines, steps), edges, np.log(np.take(lattices.p.ravel(), edges)), np.take(lattices.id.ravel(), edges))

    # first paths, all together
    at, steps = walked(np.arange(len(flat)), np.zeros(len(flat), np.int64), 0)
    ends = at[offset].tolist()
    roots = (-np.log(-np.log(uniform(row_keys + np.array([1_000_001], np.uint64))))).tolist()
    made = [Path(roots[i], [x[a:b] for x in steps], 0, [], key) for i, (a, b, key) in enumerate(zip(ends, ends[1:], path_keys(0), strict=False))]
    for search, path, sets in zip(searches, made, open_sets(made, lattices, k), strict=True):
        search.take(path, sets, lattices.width)
    for sample in range(1, k):
        going = [i for i, s in enumerate(searches) if s.frontier and len(s.paths) == sample]
        if not going:
            break
        starts, own_keys = [], path_keys(sample)
        tops = [searches[i].frontier.pop(0) for i in going]
        us = uniform(mix(row_keys[going] + np.array([2_000_003 + sample], np.uint64) * _B) + np.array([step for _, _, step, _ in tops], np.uint64)).tolist()
        for i, u, (value, parent, step, excluded) in zip(going, us, tops, strict=True):
            path = searches[i].paths[parent]
            node = int(path.edges[step]) // lattices.width
            weights = lattices.p[node].copy()
            weights[excluded] = 0
            upto = np.cumsum(weights)
            edge = int(min(np.searchsorted(upto, u * upto[-1], side="right"), np.flatnonzero(weights)[-1]))
            starts.append((i, value, path, step, excluded, node, edge, int(path.lines[step])))
        lasts = np.array([line for *_, line in starts])
        sizes = offset[np.array(going) + 1] - lasts
        heads = np.cumsum(sizes) - sizes
        where = np.arange(int(sizes.sum())) + np.repeat(lasts - heads, sizes)
        begin = np.zeros(len(where), np.int64)
        begin[heads] = [node + int(lattices.size[node, edge]) for *_, node, edge, _ in starts] - lattices.first[flat[lasts]]
        at, steps = walked(where, begin, sample)
        ends = at[np.append(heads, len(where))].tolist()
        made = []
        for (i, value, path, step, excluded, node, edge, line), a, b in zip(starts, ends, ends[1:], strict=False):
            first = (line, node * lattices.width + edge, math.log(lattices.p[node, edge]), lattices.id[node, edge])
            old = (path.lines, path.edges, path.logs, path.ids)
            own = [np.concatenate([x[:step], np.array([f], x.dtype), y[a:b]]) for x, f, y in zip(old, first, steps, strict=True)]
            made.append(Path(value, own, step, excluded, own_keys[i]))
        for i, path, sets in zip(going, made, open_sets(made, lattices, k - sample), strict=True):
            searches[i].take(path, sets, lattices.width)
    out = []
    for search in searches:
        threshold = search.frontier[0][0] if search.frontier else -np.inf
        rows = []
        for path in search.paths:
            ids, log = path.ids, float(path.logs.sum())
            if len(unknown := np.flatnonzero(ids < 0)):
                spelt = [words.fallback(chr(-2 - i)) for i in ids[unknown].tolist()]
                sizes = np.ones(len(ids), np.int64)
                sizes[unknown] = list(map(len, spelt))
                ids = np.repeat(ids, sizes)
                ids[ids < 0] = list(chain.from_iterable(spelt))
            inclusion = -math.expm1(-math.exp(min(log - threshold, 700.0))) if math.isfinite(threshold) else 1.0
            rows.append({"ids": ids, "log_prob": log, "perturbed": path.value, "inclusion": inclusion})
        out.append(rows)
    return out


_LATTICES: dict[str | None, Lattices] = {}


def piece_lattices(path: str | None = None) -> Lattices:
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(PieceTable(vocabulary(path)))
    return _LATTICES[path]


SCHEMA = "doc_id long, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, vocabulary_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Up to k distinct segmentations of each row's text, a row each; with ``with_ids`` also their ids.

    inclusion: the probability that the segmentation is among those with a
    perturbed value above the threshold, for importance weights.  round_trip:
    whether decoding the ids gives the text.  The key of a row is its doc_id, or
    for a null one its text.  Null and empty texts have one segmentation, of no
    pieces.  Repeated rows have the same samples.  Empty table: no rows.  Other
    columns aren't read.  Texts that have fewer than k segmentations give all.  A
    very long text is sampled whole and alone, with memory for its k paths and
    the lattice of its distinct pre-tokens.
    """

    def run(batches):
        lattices = piece_lattices(vocabulary_path)
        decode = lattices.table.words.decode
        for batch in slices(batches, 512):
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
                    chars += len(texts[end])
                    end += 1
                part = texts[at:end]
                keys = [zlib.crc32(t.encode("utf-8", "surrogatepass")) if d is None else d for d, t in zip(doc_ids[at:end], part, strict=True)]
                rows, ids = [], []
                for d, t, found in zip(doc_ids[at:end], part, sample_texts(part, keys, lattices, k, seed), strict=True):
                    for rank, x in enumerate(found, 1):
                        crc = zlib.crc32(np.ascontiguousarray(x["ids"], dtype="<u4").tobytes())
                        rows.append((d, rank, len(x["ids"]), crc, x["log_prob"], x["perturbed"], x["inclusion"], decode(x["ids"]) == t))
                        if with_ids:
                            ids.append(x["ids"])
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids)
                at = end

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, SCHEMA + ", ids array<int>" * with_ids)


def decode_pieces(ids: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """The rows of ``ids`` with a column text, decoded from their column ids; null ids give a null text."""

    def run(batches):
        words = vocabulary(vocabulary_path)
        for batch in slices(batches):
            texts = [None if x is None else words.decode(x) for x in batch.column(batch.schema.names.index("ids")).to_pylist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], [*(batch.schema.names[i] for i in keep), "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(f for f in ids.schema.fields if f.name != "text"), StructField("text", StringType())])
    return map_batches(ids, run, schema)
