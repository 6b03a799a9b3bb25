"""SimHash near-duplicates with an exact similarity of word shingles.

Two texts link if the Jaccard similarity of their sets of five-word shingles is
0.8 or more.  The SimHash search, on fingerprints of five-word shingles, gives
the first candidates, and each is verified on the whole sets.  But texts of 0.8
differ in about ten of 64 bits, which no search within four bits meets, so the
links that it can't see are found by a prefix filter: two such sets share one of
their first n - ceil(0.8 n) + 1 shingles in any order common to all texts, so an
index of these finds every link.  Shingles that are rare in all texts come first
in the order; their counts, in a table of fixed size, bear on the work only, not
on what is found.  Texts that are neighbours in buckets of the index are linked
next; then the buckets are searched for links between different groups, and the
texts of the group that has most of a bucket aren't compared with each other.
The join itself drops pairs that can't be similar: at the first shingle that two
texts share, what comes from there on in their orders bounds what they share;
and the differing bits of the parities of their shingles, counted by hash, are
at most the shingles that only one of them has.  Pairs that are left are verified
on the whole sets too.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shared import Scratch, map_batches, slices, small_batches
from tidewater.llm.simhash import fingerprint_links, majority

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Bits of a shingle's hash that name its counter: the table has a fixed size whatever the input.
COUNTERS = 18
#: Words of 64 bits for a text's parities; and how far apart in a bucket texts are neighbours.  Both bear on the work only.
PARITIES, NEIGHBOURS = 8, (1, 2)


def split(text: str | None) -> list[bytes]:
    """Words at ASCII white space, A-Z lower-cased, as in a fingerprint."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order; fewer words than a shingle are one, no words none."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(words) - shingle + 1)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(words, shingle).view(np.int64))


def counter(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.uint64) >> np.uint64(64 - COUNTERS)


def prefix(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set that two similar sets must share, those with small counters first."""
    n = len(sets)
    first = n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0
    return sets[np.lexsort((sets, counts[counter(sets)]))[:first]]


def parities(sets: np.ndarray) -> np.ndarray:
    """Bits that say whether a set has an odd number of the shingles with a hash; two sets' differ in no more than the sets do."""
    bits = 64 * PARITIES
    odd = np.bincount(sets & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def least_shared(size: Column, other: Column) -> Column:
    """How many shingles similar texts of so many share at least."""
    return F.floor(((size + other) * LEAST[0] + sum(LEAST) - 1) / sum(LEAST))


def first_can_be(size: Column, at: Column, other: Column, other_at: Column) -> Column:
    """Whether a shingle at these places of similar texts' orders, from 0, can be the first that they share."""
    least = least_shared(size, other)
    return (at + least <= size) & (other_at + least <= other)


def few_differ(size: Column, bits: Column, other: Column, other_bits: Column) -> Column:
    """Whether texts with these parities can be similar."""
    differ = sum((F.bit_count(bits[k].bitwiseXOR(other_bits[k])) for k in range(PARITIES)), F.lit(0))
    return differ + 2 * least_shared(size, other) <= size + other


def _counted(rows: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur in all texts; 2 ** COUNTERS numbers come to the driver, whatever the input."""

    def run(batches):
        counts = np.zeros(1 << COUNTERS, np.int64)
        for batch in slices(batches):
            found = [counter(hashes(split(text))) for text in batch.column(0).to_pylist()]
            counts += np.bincount(np.concatenate(found).view(np.int64), minlength=1 << COUNTERS)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["at", "n"])

    with small_batches(rows.sparkSession):
        found = map_batches(rows.select("text"), run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNTERS, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def similar_places(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, root) for each row of ``rows`` (doc_id, text_hash, text); root: a number of its group of linked texts.

    Texts of the same words are one text; those without words, null ones too,
    are a group.  Empty table: no rows.
    """
    counts = rows.sparkSession.sparkContext.broadcast(_counted(rows))

    def prefixes(batches):
        for batch in slices(batches):
            digests, sizes, firsts, prints, odd = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = split(text)
                grams = hashes(words)
                prints.append(majority(grams) if len(grams) else 0)
                grams = np.unique(grams.view(np.int64))
                digests.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sizes.append(len(grams))
                firsts.append(prefix(grams, counts.value))
                odd.append(parities(grams))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts]).astype(np.int32)))
            fp, bits = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (digests, prints))
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1) * PARITIES, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *odd])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, bits, pa.array(sizes, pa.int64()), lists, sums], ["doc_id", "text_hash", "fp", "bits", "size", "first", "odd"])

    def whole(batches):
        for batch in slices(batches):
            sets = [shingles(split(t)) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["fp", "grams"])

    said = scratch.save(map_batches(rows.select("doc_id", "text_hash", "text"), prefixes, "doc_id long, text_hash long, fp long, bits long, size long, first array<int>, odd array<long>"), "prefixes")
    prints = said.select("doc_id", "text_hash", "fp")
    # the index: buckets of texts that share a shingle of their prefixes; 32 bits of its hash, which can only add candidates
    index = said.select("fp", "size", "first").dropDuplicates(["fp"]).select("fp", "size", F.posexplode("first").alias("at", "gram"))
    # neighbours are others in each bucket, so that a few links in each contract a dense group
    beside = Window.partitionBy("gram").orderBy("size", F.xxhash64("fp", "gram"))
    index = index.withColumns({f"n{k}": F.lag(F.struct("fp", "size", "at"), k).over(beside) for k in NEIGHBOURS} | {"next": F.lead("fp").over(beside)})
    met = [F.when(first_can_be(F.col("size"), F.col("at"), F.col(f"n{k}.size"), F.col(f"n{k}.at")), F.col(f"n{k}.fp")) for k in NEIGHBOURS]
    index = index.where("n1 IS NOT NULL OR next IS NOT NULL").select("gram", "fp", "size", "at", F.array_compact(F.array(*met)).alias("near"))
    index = scratch.save(index, "buckets")
    odds = said.join(index.select("fp").distinct().hint("merge"), "fp", "left_semi").select("fp", "size", "odd").dropDuplicates(["fp"])
    odds = scratch.save(odds, "parities")
    one = scratch.save(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("fp", "one.*"), "texts")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) of texts that are similar, by their whole sets."""
        pairs = scratch.save(pairs, "candidates")
        held = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        texts = rows.join(one.join(held.hint("merge"), "fp", "left_semi").hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["fp"]).select("fp", "text")
        sets = scratch.save(map_batches(texts, whole, "fp long, grams array<long>"), "sets")
        left = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x"))
        right = sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
        near = F.size(F.array_intersect("x", "y")) * sum(LEAST) >= (F.size("x") + F.size("y")) * LEAST[0]
        return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(near).select("a", "b")

    # the SimHash search: a text for each fingerprint, and the texts that share it
    marked = said.select("fp", "bits").distinct()
    named = scratch.save(marked.groupBy("bits").agg(F.min("fp").alias("text")), "fingerprints")

    def of_texts(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(named.select(F.col("bits").alias("a"), F.col("text").alias("x")), "a").join(named.select(F.col("bits").alias("b"), F.col("text").alias("y")), "b")
        good = alike(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        back = good.join(named.select(F.col("text").alias("a"), F.col("bits").alias("p")), "a").join(named.select(F.col("text").alias("b"), F.col("bits").alias("q")), "b")
        return back.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    found = fingerprint_links(scratch.save(named.select(F.col("bits").alias("fp")), "distinct"), scratch, of_texts)
    names = named.select(F.col("bits").alias("a"), F.col("text").alias("x")), named.select(F.col("bits").alias("b"), F.col("text").alias("y"))
    by_bits = found.join(names[0], "a").join(names[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = marked.join(named.hint("merge"), "bits").where("fp <> text").select(F.least("text", "fp").alias("a"), F.greatest("text", "fp").alias("b"))

    # then the prefix filter's neighbours, and what is left between different groups
    near = index.select("fp", F.explode("near").alias("o")).select(F.least("fp", "o").alias("a"), F.greatest("fp", "o").alias("b")).distinct()
    ends = [odds.select(F.col("fp").alias(x), F.col("size").alias(f"{x}_size"), F.col("odd").alias(f"{x}_odd")).hint("merge") for x in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").where(few_differ(*map(F.col, ("a_size", "a_odd", "b_size", "b_odd")))).select("a", "b")
    dense = scratch.save(components(by_bits.unionByName(alike(same.unionByName(near).distinct())), scratch), "dense")
    rooted = index.drop("near").join(dense.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")
    rooted = scratch.save(rooted, "rooted")
    # of buckets with different groups, the texts of the group that has most are met by the others only
    mains = rooted.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mains = mains.where("roots > 1").select("gram", F.col("main.root").alias("main"))
    mixed = rooted.join(mains.hint("merge"), "gram").withColumn("own", F.col("root") == F.col("main")).drop("main")
    mixed = scratch.save(mixed.join(odds.drop("size").hint("merge"), "fp"), "mixed")
    other = mixed.select("gram", *(F.col(x).alias(f"o_{x}") for x in ("fp", "size", "at", "root", "own", "odd")))
    once = F.col("o_own") | (F.col("fp") < F.col("o_fp"))
    can = first_can_be(*map(F.col, ("size", "at", "o_size", "o_at"))) & few_differ(*map(F.col, ("size", "odd", "o_size", "o_odd")))
    apart = mixed.where("NOT own").join(other.hint("merge"), "gram").where((F.col("root") != F.col("o_root")) & once & can)
    links = alike(apart.select(F.least("fp", "o_fp").alias("a"), F.greatest("fp", "o_fp").alias("b")).distinct())
    roots = components(links.unionByName(dense.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "text_hash", F.coalesce("component", "fp").alias("root"))
