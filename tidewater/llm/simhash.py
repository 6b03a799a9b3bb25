"""SimHash near-duplicates by generalised pigeonhole search.

A fingerprint has 64 bits; two link at ``RADIUS`` or fewer differing bits.  The
bits are grouped into partitions so that correlated bits lie together.  Every
fingerprint gets its own threshold for each partition, -1 upwards, which add up
to RADIUS - partitions + 1; by the generalised pigeonhole principle any other
fingerprint within RADIUS is within one of these thresholds in its partition.
Thresholds are chosen by dynamic programming on estimated candidate counts, so
that a partition in which many agree gets a low one.  Fingerprints then probe
an index of exact partition values, and the join itself verifies the distance.

Equal fingerprints are one row from the start.  Dense groups are contracted
along a few verified links before the search, which then only looks for links
between different parts: of a bucket, the rows of the part that has most of it
aren't compared with each other, and a large bucket is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shared import Scratch, map_batches, slices

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Numbers of partitions to choose from; and microseconds for a probe row and for a verified candidate, which weigh probes against candidates.
PARTITIONS, PROBE_COST, CANDIDATE_COST = (2, 3, 4, 5), 1.5, 0.03
#: Bits whose joint values are counted for the estimates; the counts are 8 * 256 numbers whatever the input.
BLOCK = 8
#: Fingerprints of a bucket that are sorted together when dense groups are contracted, at most 2 ** 16 parts a bucket,
#: and that a probe is compared with in one task; above PLAIN of them a bucket's main part is kept apart.
TOGETHER, PLAIN = 2048, 32

_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, 0 where it has no words or is null.

    Words are split at ASCII white space after A-Z are lower-cased; a text of
    fewer words than a shingle is one shingle.  A bit is 1 if it is set in over
    half of the shingles' hashes, repeats included.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    n = len(hashes)
    ones = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
        ones += np.bincount(part.ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (ones @ _TABLE) > n
    return int(np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").reshape(8).view("<u8")[0])


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _fingerprints(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _signed([fingerprint(t) for t in batch.column(1).to_pylist()])], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the 64 bits) for every row of ``docs``."""
    return map_batches(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


# -- the plan: partitions of bits, and what a threshold costs ------------------------------------------------


def _moments(batches):
    """Of a task's fingerprints: their number, and how often two bits are both set."""
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = as_bits(batch.column(0).to_numpy())
        both += bits.T.astype(np.float32) @ bits.astype(np.float32)
        n += len(bits)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()])], ["n", "both"])


def as_bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(both: np.ndarray, n: float, blocks: int = BITS // BLOCK) -> list[list[int]]:
    """Eight bits a block, correlated ones together: each block takes the free bit that correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for _ in range(blocks):
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < BITS // blocks:
            b = max(free, key=lambda x: (corr[x, own].sum(), -x))
            own.append(b)
            free.remove(b)
        out.append(own)
    return out


class Plan:
    """Blocks of bits with the counts of their values, and the partitions made of whole and split blocks."""

    def __init__(self, blocks: list[list[int]], counts: np.ndarray, n: int):
        self.order = [b for block in blocks for b in block]
        self.n = max(n, 1)
        share = counts / self.n
        values = np.arange(256)
        distance = np.array([bin(x).count("1") for x in range(256)])[values[:, None] ^ values]
        #: near[b, v, d]: share of fingerprints whose block b is at distance d from value v.
        self.near = np.stack([np.stack([(share[b] * (distance == d)).sum(1) for d in range(9)], 1) for b in range(len(blocks))])
        self.width = self.best_width()

    def bounds(self, m: int) -> list[tuple[int, int]]:
        """Partitions as ranges of the ordered bits, as even as can be."""
        edges = [round(BITS * k / m) for k in range(m + 1)]
        return list(zip(edges, edges[1:], strict=False))

    def best_width(self) -> int:
        """The number of partitions with the least cost for a typical fingerprint, all its candidates counted."""

        def cost(m: int) -> float:
            w, spare = BITS / m, RADIUS - m + 1
            each = [max(0, spare // m + (k < spare % m)) for k in range(m)]
            probes = sum(ball(round(w), t) for t in each)
            return probes * PROBE_COST + self.n * probes / 2**w * CANDIDATE_COST

        return min(PARTITIONS, key=cost)

    def estimates(self, blocks: np.ndarray, m: int) -> np.ndarray:
        """[query, partition, t]: fingerprints expected within t = 0..RADIUS in the partition, the blocks' counts taken as independent."""
        out = np.zeros((len(blocks), m, RADIUS + 1))
        for k, (a, b) in enumerate(self.bounds(m)):
            have = np.zeros((len(blocks), RADIUS + 1))
            have[:, 0] = 1
            for block in range(a // BLOCK, -(-b // BLOCK)):
                inside = (min(b, (block + 1) * BLOCK) - max(a, block * BLOCK)) / BLOCK
                near = self.near[block][blocks[:, block]]
                if inside < 1:  # part of a block: its distances shrink in proportion
                    exact = near[:, 0] ** inside
                    near = np.stack([exact, *(near[:, d] * (1 - exact) / np.maximum(1 - near[:, 0], 1e-12) for d in range(1, 9))], 1)
                new = np.zeros_like(have)
                for d in range(RADIUS + 1):
                    new[:, d:] += near[:, d : d + 1] * have[:, : RADIUS + 1 - d]
                have = new
            out[:, k] = have.cumsum(1) * self.n
        return out

    def thresholds(self, blocks: np.ndarray, m: int) -> np.ndarray:
        """[query, partition]: thresholds from -1 that add up to RADIUS - m + 1 with the least estimated cost."""
        near = self.estimates(blocks, m)
        cost = np.zeros((len(blocks), m, RADIUS + 2))  # index 0 is the threshold -1: no probe
        for k, (a, b) in enumerate(self.bounds(m)):
            for t in range(RADIUS + 1):
                cost[:, k, t + 1] = ball(b - a, t) * PROBE_COST + near[:, k, t] * CANDIDATE_COST
        most = RADIUS + 1  # the sum of thresholds, each counted from -1
        best = np.full((len(blocks), most + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for k in range(m):
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int64)
            for t in range(most + 1):
                with_t = np.full_like(best, np.inf)
                with_t[:, t:] = best[:, : most + 1 - t] + cost[:, k, t : t + 1]
                better = with_t < new
                new[better], pick[better] = with_t[better], t
            best = new
            chosen.append(pick)
        out, rest = np.zeros((len(blocks), m), dtype=np.int64), np.full(len(blocks), most)
        for k in reversed(range(m)):
            out[:, k] = chosen[k][np.arange(len(blocks)), rest]
            rest = rest - out[:, k]
        return out - 1


def ball(width: int, t: int) -> int:
    """Values within t bits of one of ``width`` bits."""
    total, term = 0, 1
    for k in range(t + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def masks(width: int, t: int) -> np.ndarray:
    """All bit masks of at most t of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(max(t, -1) + 1) for c in combinations(range(width), k)], dtype=np.int64)


def ordered_bits(fps: np.ndarray, order: list[int]) -> np.ndarray:
    return as_bits(fps)[:, order]


def _values(bits: np.ndarray, a: int, b: int) -> np.ndarray:
    return bits[:, a:b].astype(np.int64) @ (np.int64(1) << np.arange(b - a, dtype=np.int64))


def _block_counts(order):
    def run(batches):
        counts = np.zeros((BITS // BLOCK, 256), dtype=np.int64)
        for batch in batches:
            bits = ordered_bits(batch.column(0).to_numpy(), order)
            for k in range(BITS // BLOCK):
                counts[k] += np.bincount(_values(bits, k * BLOCK, (k + 1) * BLOCK), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array([counts.ravel().tolist()])], ["counts"])

    return run


def _sum_arrays(df: DataFrame, column: str) -> DataFrame:
    """Element sums of the tasks' arrays, a tree of them so that no task adds up many."""
    return df.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))


def make_plan(fps: DataFrame) -> Plan:
    """The plan for distinct fingerprints; 4096 sums and 2048 counts come to the driver, whatever the input."""
    said = map_batches(fps.select("fp"), _moments, "n long, both array<double>").persist()
    n = said.agg(F.sum("n")).first()[0] or 0
    both = np.zeros(BITS * BITS)
    for at, x in _sum_arrays(said, "both").collect():
        both[at] = x
    said.unpersist()
    blocks = group_bits(both.reshape(BITS, BITS), n)
    counts = np.zeros(8 * 256)
    for at, x in _sum_arrays(map_batches(fps.select("fp"), _block_counts([b for block in blocks for b in block]), "counts array<long>"), "counts").collect():
        counts[at] = x
    return Plan(blocks, counts.reshape(8, 256), n)


def _index(plan: Plan):
    def run(batches):
        m = plan.width
        for batch in slices(batches, 4096):
            fps = batch.column(0).to_numpy()
            bits = ordered_bits(fps, plan.order)
            values = np.stack([_values(bits, a, b) for a, b in plan.bounds(m)], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(m, dtype=np.int32), len(fps))), pa.array(values.ravel()), pa.array(np.repeat(fps, m)), pa.array(np.repeat(batch.column(1).to_numpy(), m))],
                ["part", "value", "fp", "root"],
            )

    return run


def _probes(plan: Plan):
    def run(batches):
        m = plan.width
        for batch in slices(batches, 2048):
            fps, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = ordered_bits(fps, plan.order)
            blocks = np.stack([_values(bits, k * BLOCK, (k + 1) * BLOCK) for k in range(BITS // BLOCK)], 1)
            wanted = plan.thresholds(blocks, m)
            for k, (a, b) in enumerate(plan.bounds(m)):
                values = _values(bits, a, b)
                for t in np.unique(wanted[:, k]):
                    own, flips = np.flatnonzero(wanted[:, k] == t), masks(b - a, int(t))
                    step = max(1, 200_000 // max(1, len(flips)))
                    for at in range(0, len(own) if len(flips) else 0, step):
                        q = own[at : at + step]
                        got = (values[q][:, None] ^ flips).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(got), k, dtype=np.int32)), pa.array(got), pa.array(np.repeat(fps[q], len(flips))), pa.array(np.repeat(roots[q], len(flips)))],
                            ["part", "value", "q", "q_root"],
                        )

    return run


def _salt(fp: str, n: Column) -> Column:
    """The part of a bucket of n fingerprints that one of them is in."""
    return F.pmod(F.xxhash64(fp), F.least(F.ceil(n / TOGETHER), F.lit(1 << 16)))


def candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(q, q_root, fp, root) for probes and the fingerprints of their buckets that have another root.

    index: (part, value, fp, root), probes: (part, value, q, q_root).  A bucket of
    more than PLAIN has a main root, that of most of its rows; pairs within it
    aren't made.  A bucket of more than TOGETHER is dealt by fingerprint, and its
    probes go to all its parts.
    """
    key = ["part", "value"]
    roots = index.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = roots.groupBy(*key).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    buckets = buckets.select(*key, "n", F.col("main.n").alias("main_n"), F.col("main.root").alias("main"))
    own = F.col("root") == F.col("main")
    held = index.join(buckets.hint("merge"), key).select(*key, ((F.col("n") > PLAIN) & own).alias("apart"), _salt("fp", F.col("n")).alias("salt"), "fp", "root")
    # probes that meet another root at all
    met = probes.join(buckets.hint("merge"), key).where((F.col("n") > F.col("main_n")) | (F.col("q_root") != F.col("main")))
    others = F.when(F.col("n") <= PLAIN, F.array(F.lit(False))).when(F.col("q_root") == F.col("main"), F.array(F.lit(False)))
    others = others.when(F.col("n") > F.col("main_n"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    met = met.withColumn("apart", F.explode(others)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.col("n") / TOGETHER), F.lit(1 << 16)) - 1)))
    met = met.select(*key, "apart", F.col("salt").cast("long").alias("salt"), "q", "q_root")
    return met.join(held.hint("merge"), [*key, "apart", "salt"]).where("q_root <> root").select("q", "q_root", "fp", "root")


def fingerprint_components(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every fp of ``distinct`` that links to another; component is the smallest fp reachable."""
    return components(fingerprint_links(distinct, scratch), scratch)


def fingerprint_links(distinct: DataFrame, scratch: Scratch, verified: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all that links connect.

    distinct: one column fp without repeats, a table that can be read twice.
    verified: leaves those of candidate pairs (a, b) of fingerprints that are links; by default all are.
    """
    plan = make_plan(distinct)
    schema = "part int, value long, fp long, root long"
    # links between neighbours in sorted parts of the buckets contract dense groups
    index = map_batches(distinct.select("fp", F.col("fp").alias("root")), _index(plan), schema)
    sizes = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parted = index.select("part", "value", "fp").join(sizes.hint("merge"), ["part", "value"]).withColumn("salt", _salt("fp", F.col("n")))
    near = Window.partitionBy("part", "value", "salt").orderBy("fp")
    first = parted.select(F.lag("fp").over(near).alias("a"), F.col("fp").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    dense = scratch.save(components(verified(first.distinct()) if verified else first, scratch), "dense")
    rooted = scratch.save(distinct.join(dense.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")), "rooted")
    index = map_batches(rooted, _index(plan), schema)
    probes = map_batches(rooted, _probes(plan), "part int, value long, q long, q_root long")
    found = candidates(index, probes).where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= RADIUS)
    # without a further check a link of two fingerprints is one of their roots
    ends = ("q", "fp") if verified else ("q_root", "root")
    pairs = found.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    pairs = verified(pairs.distinct()) if verified else pairs
    return pairs.unionByName(dense.select(F.col("component").alias("a"), F.col("node").alias("b")))


def simhash_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_members for each row of ``docs``.

    Null and empty texts, and those of white space, have fingerprint zero and
    link like others.  component_id: the smallest doc_id that can be reached,
    null only if all doc_ids of a component are.  Repeated rows: a row each.
    Empty table: no rows.  Other columns aren't read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs), "fingerprints")
    copies = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = fingerprint_components(copies.select("fp"), scratch)
    placed = scratch.save(copies.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "first", "copies"), "placed")
    classes = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("n_members"))
    by_print = placed.select("fp", "root").join(classes, "root").drop("root")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_members")


def fingerprint_places(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, root) for each row of ``rows`` (doc_id, text_hash, text); root: a number of its group of linked fingerprints."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed([fingerprint(t) for t in batch.column(2).to_pylist()])], ["doc_id", "text_hash", "fp"])

    prints = scratch.save(map_batches(rows.select("doc_id", "text_hash", "text"), run, "doc_id long, text_hash long, fp long"), "fingerprints")
    distinct = scratch.save(prints.select("fp").distinct(), "distinct")
    roots = fingerprint_components(distinct, scratch).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").select("doc_id", "text_hash", F.coalesce("component", "fp").alias("root"))


def keep_one(docs: DataFrame, places: Callable[[DataFrame, Scratch], DataFrame] = fingerprint_places) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the smallest doc_id, and of equal ones any one.

    All columns stay.  Rows without a doc_id are a group's choice only if it has
    no other; they go by a hash of their text then.  A doc_id may stand on rows
    with different texts: a row is chosen by its doc_id and text together.
    places: what puts rows into groups; ``similar.similar_places`` is another.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    mark = "__tw_key"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    own, text = [mark, f"{mark}t"], F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + text.bitwiseAND(F.lit((1 << 61) - 1)))
    placed = places(docs.select(key.alias("doc_id"), text.alias("text_hash"), "text"), scratch)
    counted = placed.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = counted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("one"))
    chosen = scratch.save(chosen.select(F.col("one.doc_id").alias(own[0]), F.col("one.text_hash").alias(own[1]), F.col("one.n").alias("n")), "chosen")
    keyed = docs.withColumn(own[0], key).withColumn(own[1], text)
    # the chosen keys grow with the documents, so they're merged at any size and never broadcast
    once = keyed.join(chosen.where("n = 1").select(*own).hint("merge"), own, "left_semi").drop(*own)
    if not chosen.where("n > 1").take(1):
        return once
    again = keyed.join(chosen.where("n > 1").select(*own), own, "left_semi").dropDuplicates(own).drop(*own)
    return once.unionByName(again)
