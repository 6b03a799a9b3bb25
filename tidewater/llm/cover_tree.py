"""Embedding near-duplicates by dual traversal of cover trees.

Links are pairs of vectors with a cosine of at least THRESHOLD, so unit vectors
at most a certain distance apart.  A cover tree has nested levels of centres
whose radii halve; a node's covering radius is the largest distance to anything
below it.  Two nodes whose centres are farther apart than the link distance and
both covering radii hold no link and are dropped with all below them.

The top of the tree is fitted on a bounded sample; its lowest centres are cells,
to which all vectors are dealt, and whose covering radii come from all of them.
Cells are cut into blocks of about BLOCK vectors.  Every pair of blocks of two
cells that the bound leaves is a task's unit of work: each block gets its own
cover tree there and the trees are traversed against each other.  A unit returns
numbers of links and a spanning forest of its links, never the pairs, so dense
groups cost no more rows than others.  Equal vectors are one row with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components, forest
from tidewater.llm.shared import Scratch, map_batches

THRESHOLD = 0.9
#: Vectors of a block; and of the sample for the top of the tree, SAMPLE a cell and MOST_SAMPLED in all, which bounds the cells.
BLOCK, SAMPLE, MOST_SAMPLED = 4096, 8, 32768
#: Rows of a block whose distances to another block are in memory together.
ROWS_AT_ONCE = 512
#: Slack of the bounds for rounding; and how near the threshold a cosine is summed again exactly.
SLACK, NEAR = 1e-7, 1e-12
#: A level with more nodes than this share of the vectors prunes nothing.
USEFUL = 0.7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Levels of a cover tree over unit vectors; each level's centres are among the next one's.

    levels: (centres as indices of vectors, covering radius of each, the centre above of each).  The last level, of the
    vectors themselves with radius zero, isn't stored; ``parent`` has their centre in the lowest level.
    """

    def __init__(self, x: np.ndarray, most_levels: int = 6):
        n = len(x)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.parent = np.zeros(n, np.int64)
        if not n:
            return
        near = distances(x, x[:1])[:, 0]
        radius = float(near.max())
        self.levels.append((np.zeros(1, np.int64), np.array([radius]), np.zeros(1, np.int64)))
        centres, owner = np.zeros(1, np.int64), np.zeros(n, np.int64)
        for _ in range(most_levels):
            radius /= 2
            if radius < 1e-6 or self._alone(x, radius) > USEFUL:
                break
            new_owner, reach = np.full(n, -1), np.full(n, np.inf)
            new = []
            # nested: the centres above come first, then the first vector that none covers
            for c in centres.tolist():
                self._claim(x, c, len(new), new_owner, reach)
                new.append(c)
            at = 0
            while True:
                far = np.flatnonzero(reach[at:] > radius)
                if not len(far) or len(new) > USEFUL * n:
                    break
                at += int(far[0])
                self._claim(x, at, len(new), new_owner, reach)
                new.append(at)
            if len(far):  # the level would hold nearly all vectors
                break
            new = np.array(new)
            above = owner[new]
            cover = np.zeros(len(new))
            np.maximum.at(cover, new_owner, reach)
            centres, owner = new, new_owner
            self.levels.append((centres, cover, above))
            # a node covers what is below it at any later level too
            for k in range(len(self.levels) - 1, 0, -1):
                mine, r, up = self.levels[k]
                bound = np.zeros(len(self.levels[k - 1][0]))
                np.maximum.at(bound, up, r + np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[mine], x[self.levels[k - 1][0][up]]), 0)))
                self.levels[k - 1] = (self.levels[k - 1][0], np.maximum(self.levels[k - 1][1], bound), self.levels[k - 1][2])
        self.parent = owner

    def order(self, rows: np.ndarray) -> np.ndarray:
        """The rows with those below a node together, at every level."""
        keys, at = [], self.parent[rows]
        for _, _, above in reversed(self.levels):
            keys.append(at)
            at = above[at]
        return rows[np.lexsort(keys)]

    @staticmethod
    def _alone(x: np.ndarray, radius: float, probes: int = 128) -> float:
        """Share of some vectors that have no other within the radius, and would be centres by themselves."""
        own = np.unique(np.linspace(0, len(x) - 1, probes).astype(np.int64))
        return float(((distances(x[own], x) <= radius).sum(1) <= 1).mean())

    @staticmethod
    def _claim(x: np.ndarray, c: int, name: int, owner: np.ndarray, reach: np.ndarray) -> None:
        d = np.sqrt(np.maximum(2 - 2 * (x @ x[c]), 0))
        d[c] = 0
        closer = d < reach
        owner[closer], reach[closer] = name, d[closer]


def candidate_pairs(x: np.ndarray, tx: CoverTree, y: np.ndarray, ty: CoverTree, most: float):
    """(rows of x, rows of y, mask) blocks of the pairs that the bounds leave, by levels from the roots."""
    alive = np.ones((1, 1), bool)
    depth = max(len(tx.levels), len(ty.levels))
    kx = ky = 0
    for level in range(1, depth):
        new_kx, new_ky = min(level, len(tx.levels) - 1), min(level, len(ty.levels) - 1)
        (cx, rx, ux), (cy, ry, uy) = tx.levels[new_kx], ty.levels[new_ky]
        if new_kx == kx:
            ux = np.arange(len(cx))
        if new_ky == ky:
            uy = np.arange(len(cy))
        alive = alive[ux][:, uy]
        kx, ky = new_kx, new_ky
        a, b = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(a):
            return
        for at in range(0, len(a), ROWS_AT_ONCE):
            own = a[at : at + ROWS_AT_ONCE]
            d = distances(x[cx[own]], y[cy[b]])
            alive[np.ix_(own, b)] &= d <= most + rx[own][:, None] + ry[b] + SLACK
    px, py = tx.parent, ty.parent
    rows = np.flatnonzero(alive.any(1)[px])
    rows = tx.order(rows)  # few columns are left for neighbours
    for at in range(0, len(rows), ROWS_AT_ONCE):
        own = rows[at : at + ROWS_AT_ONCE]
        cols = np.flatnonzero(alive[np.unique(px[own])].any(0)[py])
        if len(cols):
            yield own, cols, None if alive.all() else alive[np.ix_(px[own], py[cols])]


def links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float = THRESHOLD, trees: tuple[CoverTree, CoverTree] | None = None):
    """Blocks of links: (rows of x, rows of y, mask) with mask[i, j] where the cosine is at least the threshold.

    x and y are vectors of any length but zero, in double precision.  ``same``: they're one set, and a vector is no link of itself.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    ux, uy = x / nx[:, None], y / ny[:, None]
    tx, ty = trees or (CoverTree(ux), None)
    ty = ty or (tx if same else CoverTree(uy))
    most = math.sqrt(max(2 - 2 * threshold, 0))
    for rows, cols, mask in candidate_pairs(ux, tx, uy, ty, most):
        cosine = ux[rows] @ uy[cols].T
        found = cosine >= threshold - NEAR
        if same:
            found &= rows[:, None] != cols
        if not found.any():
            continue
        if mask is not None:
            found &= mask
        for i, j in zip(*np.nonzero(found & (cosine < threshold + NEAR)), strict=True):
            a, b = x[rows[i]], y[cols[j]]
            found[i, j] = math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b))) >= threshold
        yield rows, cols, found


def unit_of_work(ids_x, x, weight_x, ids_y, y, weight_y, same: bool, threshold: float):
    """(id, links) of vectors with links, and (u, v) of a spanning forest, for one pair of blocks."""
    total_x, total_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    us, vs = [], []
    for rows, cols, found in links(x, y, same, threshold):
        total_x[rows] += found @ weight_y[cols]
        if not same:
            total_y[cols] += weight_x[rows] @ found
        i, j = np.nonzero(found)
        u, v = forest(np.minimum(ids_x[rows[i]], ids_y[cols[j]]), np.maximum(ids_x[rows[i]], ids_y[cols[j]]))
        us.append(u)
        vs.append(v)
    if us:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
    else:
        u = v = np.zeros(0, np.int64)
    have_x, have_y = total_x > 0, total_y > 0
    return np.concatenate([ids_x[have_x], ids_y[have_y]]), np.concatenate([total_x[have_x], total_y[have_y]]), u, v


def _raw(batches):
    """Vectors as bytes, null where they link with nothing; dim."""
    for batch in batches:
        column = batch.column(1)
        kind = np.dtype("<f4") if pa.types.is_float32(column.type.value_type) else np.dtype("<f8")
        out, dims = [], []
        for v in column.to_pylist():
            a = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float64)
            good = a is not None and len(a) and np.isfinite(a).all() and a.any()
            if good:  # a power of two brings the largest component near one, so that no square is too large or small
                a = np.ldexp(a, -np.frexp(np.abs(a).max())[1])
            # a negative zero is the same component as a zero
            out.append((a + 0.0).astype(kind).tobytes() if good else None)
            dims.append(len(v) if good else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "raw", "dim"])


def _vectors(raw, kind: str) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)


def fit_cells(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit centres of about ``wanted`` cells: the lowest level of a cover tree of the sample that has no more, filled up with the next."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    centres = [0]
    reach = distances(unit, unit[:1])[:, 0]
    radius = float(reach.max())
    while len(centres) < min(wanted, len(unit)) and radius > 1e-6:
        radius /= 2
        while len(centres) < wanted and (far := int(reach.argmax())) >= 0 and reach[far] > radius:
            centres.append(far)
            reach = np.minimum(reach, distances(unit, unit[far : far + 1])[:, 0])
    return unit[centres]


def _assign(cells, kind: str):
    def run(batches):
        centres = cells.value
        for batch in batches:
            dims, raw = batch.column(2).to_numpy(), batch.column(1).to_pylist()
            cell, far = np.zeros(len(raw), np.int32), np.zeros(len(raw))
            for dim, own in centres.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    x = _vectors([raw[i] for i in at], kind)
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    cos = x @ own["centres"].T
                    best = cos.argmax(1)
                    cell[at] = own["first"] + best
                    far[at] = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(at)), best], 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(cell), pa.array(far)], ["cid", "raw", "dim", "copies", "cell", "far"])

    return run


def _units(threshold: float, kind: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["x_block"].iloc[0] == rows["y_block"].iloc[0]
        left = rows[rows["side"] == 0]
        right = left if same else rows[rows["side"] == 1]
        none = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="float64"), "links": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return none
        parts = [(p["cid"].to_numpy(), _vectors(p["raw"], kind), p["copies"].to_numpy()) for p in (left, right)]
        ids, total, u, v = unit_of_work(*parts[0], *parts[1], same, threshold)
        return pd.DataFrame({"u": np.concatenate([ids, u]), "v": pd.array([*[None] * len(ids), *v.tolist()], dtype="Int64"), "links": pd.array([*total.tolist(), *[None] * len(u)], dtype="Int64")})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, ...).

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; nor do vectors of different lengths with each other.
    Components of any size count: a vector is scaled by a power of two first.
    component_id: the smallest vec_id that can be reached; for a vector without
    links its own.  Null vec_id: kept is false where it has no other name.
    Repeated rows: a row each, linked with each other.  Empty table: no rows.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cover-tree")
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    base = scratch.save(map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), _raw, "vec_id long, raw binary, dim int"), "raw")
    classes = base.where("raw is not null").groupBy("raw", "dim").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # cells from a bounded sample of each length of vectors, of which there are few
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells, n_cells = {}, 0
    for dim, n in sorted(sizes.items()):
        wanted = -(-n // block)
        sample = _vectors([r["raw"] for r in classes.where(F.col("dim") == dim).orderBy(F.xxhash64("raw")).select("raw").limit(min(SAMPLE * max(wanted, 256), MOST_SAMPLED)).collect()], kind)
        own = fit_cells(sample, min(MOST_SAMPLED // SAMPLE, wanted))
        cells[dim] = {"first": n_cells, "centres": own}
        n_cells += len(own)
    shared = spark.sparkContext.broadcast(cells)
    dealt = scratch.save(map_batches(classes.select("cid", "raw", "dim", "copies"), _assign(shared, kind), "cid long, raw binary, dim int, copies long, cell int, far double"), "dealt")
    stats = {r["cell"]: (r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    most = math.sqrt(max(2 - 2 * threshold, 0))
    blocks = {c: -(-n // block) for c, (n, _) in stats.items()}
    first_block = dict(zip(sorted(blocks), np.concatenate([[0], np.cumsum([blocks[c] for c in sorted(blocks)])]).tolist(), strict=False))
    partners = []
    for dim, own in cells.items():
        names = [c for c in range(own["first"], own["first"] + len(own["centres"])) if c in stats]
        far = np.array([stats[c][1] for c in names])
        at = own["centres"][np.array(names, np.int64) - own["first"]]
        for i, c in enumerate(names):
            apart = distances(at[i : i + 1], at)[0]
            apart[i] = 0
            near = np.flatnonzero(apart <= most + far[i] + far + SLACK).tolist()
            partners.append((c, first_block[c], blocks[c], [(first_block[names[j]], first_block[names[j]] + blocks[names[j]]) for j in near]))
    if not partners:
        links_of = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return links_of.withColumn("kept", F.col("vec_id").isNotNull())
    plan = spark.createDataFrame(partners, "cell int, first_block int, n_blocks int, ranges array<struct<a:int,b:int>>")
    placed = dealt.join(F.broadcast(plan), "cell").withColumn("own", (F.col("first_block") + F.pmod(F.xxhash64("cid"), F.col("n_blocks"))).cast("int"))
    others = F.flatten(F.transform("ranges", lambda r: F.sequence(r["a"], r["b"] - 1)))
    sent = placed.select("cid", "raw", "copies", "own", F.explode(others).alias("other"))
    sent = sent.select(F.least("own", "other").alias("x_block"), F.greatest("own", "other").alias("y_block"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "raw", "copies")
    found = scratch.save(sent.groupBy("x_block", "y_block").applyInPandas(_units(threshold, kind), "u long, v long, links long"), "links")
    totals = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"), scratch)
    ids = classes.select("cid", "raw", "first", "copies")
    named = ids.join(totals.withColumnRenamed("u", "cid"), "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    named = scratch.save(named.select("raw", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    out = base.join(named.join(least, "root").select("raw", "n_links", "component_id"), "raw", "left")
    component = F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
