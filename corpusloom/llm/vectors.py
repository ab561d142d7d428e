"""Embedding near-dedup by collision-counting projections.

Every vector is projected on ``projections`` random directions.  A pair collides on a direction
if the two values lie within a window around the query's value.  For unit vectors at cosine c,
the difference of two values is a mean of Gaussians with a known deviation, so the
window and the least collision count come from the wanted recall (``calibrate``); random pairs rarely reach
that count.  Pairs that do are verified by their cosine in double precision.

Values of the first ``sorted_by`` directions are sorted into cells as wide as the window with
their neighbours: a pair within the window on a direction shares or neighbours a cell, so the
join on (label, cells) finds what can collide on all of them, block against block: a cell's vectors are
packed into blocks of bounded size, and blocks of neighbouring cells meet as block pairs, so
hot labels and hot cells spread over tasks, and no pair is a row: links are counted inside a pair of blocks.
Equal vectors of a label are one row with a count.

Defined results: a null or zero vector, one with a null or non-finite component, and one with a
null label link with nothing; null vec_ids take part, come back as null and are the last choice for a
component's id; vectors of different length never link; rows that repeat a vec_id are linked by their vectors only; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize


def calibrate(cosine: float, projections: int, sorted_by: int, miss: float) -> tuple[float, int]:
    """(window, least count): a pair at ``cosine`` is missed with probability ``miss`` at most.

    Half of it is left to the sorted directions (all must collide), half to the count over the rest.
    """
    spread = sqrt(2 - 2 * cosine)
    p_in = lambda w: erf(w / spread / sqrt(2))
    low, high = 0.0, 20 * spread
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p_in(mid) ** sorted_by < 1 - miss / 2 else (low, mid)
    p, n = p_in(high), projections - sorted_by
    total, count = 0.0, 0
    while count < n and total + comb(n, count) * p**count * (1 - p) ** (n - count) <= miss / 2:
        total += comb(n, count) * p**count * (1 - p) ** (n - count)
        count += 1
    return high, count


def directions(n: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((n, size))


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


CELLED = "node long, label string, size int, cells array<int>, vec binary, copies long"


def _cells(batches, sorted_by: int, window: float, seed: int):
    for batch in batches:
        node, label = batch.column("node").to_pylist(), batch.column("label").to_pylist()
        vec = [np.frombuffer(v, dtype=np.float64) for v in batch.column("vec").to_pylist()]
        cells = [None] * len(vec)
        for size in sorted({len(v) for v in vec}):
            at = [i for i, v in enumerate(vec) if len(v) == size]
            c = np.floor(_unit([vec[i] for i in at]) @ directions(sorted_by, size, seed).T / window).astype(np.int64)
            for i, x in zip(at, c.tolist(), strict=True):
                cells[i] = x
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(label, pa.string()), pa.array([len(v) for v in vec], pa.int32()), pa.array(cells, pa.list_(pa.int32())), batch.column("vec"), batch.column("copies")], names=["node", "label", "size", "cells", "vec", "copies"])


def _verified(row: dict, cosine: float, projections: int, sorted_by: int, window: float, count: int, seed: int):
    """(places in the first block, places in the second) of the links of a pair of blocks."""
    va, vb = (_unit([np.frombuffer(v, dtype=np.float64) for v in row["vecs" + s]]) for s in ("1", "2"))
    d = directions(projections, row["size"], seed)
    on_a, on_b = va @ d.T, vb @ d.T
    left = np.ones((len(va), len(vb)), dtype=bool)
    if row["block1"] == row["block2"]:
        left = np.triu(left, 1)
    for k in range(sorted_by):
        left &= np.abs(on_a[:, k, None] - on_b[None, :, k]) <= window
    i, j = np.nonzero(left)
    kept = [np.zeros((2, 0), dtype=np.int64)]
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        hits = (np.abs(on_a[p, sorted_by:] - on_b[q, sorted_by:]) <= window).sum(axis=1)
        p, q = p[hits >= count], q[hits >= count]
        ok = (va[p] * vb[q]).sum(axis=1) >= cosine
        kept.append(np.stack([p[ok], q[ok]]))
    return np.concatenate(kept, axis=1)


def _roots(size: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least place that each place reaches over the links p - q."""
    root = np.arange(size)
    while True:
        new = root.copy()
        np.minimum.at(new, p, root[q])
        np.minimum.at(new, q, root[p])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _summed(batches, **how):
    """Of each linked vector of a pair of blocks: a vector it reaches in them, and how many vectors it links to."""
    for batch in batches:
        out = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
        for row in batch.to_pylist():
            p, q = _verified(row, **how)
            sides = ("1",) if row["block1"] == row["block2"] else ("1", "2")
            ids, copies = (np.concatenate([np.array(row[name + s], dtype=np.int64) for s in sides]) for name in ("nodes", "copies"))
            q = q + (len(row["nodes1"]) if len(sides) == 2 else 0)
            near = np.zeros(len(ids), dtype=np.int64)
            np.add.at(near, p, copies[q])
            np.add.at(near, q, copies[p])
            at = np.flatnonzero(near)
            for o, x in zip(out, (ids[at], ids[_roots(len(ids), p, q)[at]], near[at]), strict=True):
                o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["a", "b", "near"])


def vector_links(nodes: DataFrame, *, cosine: float, projections: int = 48, sorted_by: int = 3, miss: float = 0.001, block: int = 256, seed: int = 9) -> DataFrame:
    """(a, b, near) of rows (node, label, vec, copies): links with cosine at least ``cosine`` between rows of equal labels.

    A row is a vector ``a`` in a pair of blocks: ``b`` is one that it reaches over links there, and ``near`` sums the copies of
    all it links to there.  Each link is in one pair of blocks, so the sums over ``a`` count all links and the rows (a, b) connect
    what the links connect; there are at most 2 x ``block`` rows a pair of blocks, however many links.
    """
    window, count = calibrate(cosine, projections, sorted_by, miss)
    celled = nodes.select("node", F.col("label").cast("string").alias("label"), "vec", "copies").mapInArrow(partial(_cells, sorted_by=sorted_by, window=window, seed=seed), CELLED)
    celled = materialize(celled)
    key = ["label", "size", "cells"]
    # blocks of bounded size: a salt by the cell's count, then one row per (cell, salt)
    sizes = materialize(celled.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts")))
    salted = celled.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    blocks = materialize(salted.groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct("node", "vec", "copies"))).alias("rows")))
    held = {"nodes": F.col("rows.node"), "vecs": F.col("rows.vec"), "copies": F.col("rows.copies")}
    blocks = blocks.select(*key, "block", *[c.alias(n) for n, c in held.items()])
    names = [f"_d{i}" for i in range(sorted_by)]
    # each cell meets itself and half of its neighbours, so that every pair of blocks meets once
    steps = [F.struct(*[F.lit(s[i]).alias(n) for i, n in enumerate(names)]) for s in _half_steps(sorted_by)]
    first = blocks.select("*", F.explode(F.array(*steps)).alias("step"))
    far = F.array(*[(F.get("cells", F.lit(i)) + F.col(f"step.{n}")) for i, n in enumerate(names)])
    side = lambda s, cells: [F.col("label").alias("label" + s), F.col("size").alias("size" + s), cells.alias("cells" + s), F.col("block").alias("block" + s), *[F.col(n).alias(n + s) for n in held]]
    still = F.forall(F.array(*[F.col(f"step.{n}") for n in names]), lambda x: x == 0)
    # the partner's block is part of the key, so that a hot cell is as many keys as it has blocks
    partner = sizes.select(F.col("label").alias("label1"), F.col("size").alias("size1"), F.col("cells").alias("cells1"), F.sequence(F.lit(0), F.col("salts") - 1).alias("partners"))
    one = first.select(*side("1", far), still.alias("same")).join(partner, ["label1", "size1", "cells1"])
    one = one.select("*", F.explode("partners").alias("partner")).drop("partners").where(~F.col("same") | (F.col("block1") <= F.col("partner")))
    two = blocks.select(*side("2", F.col("cells")))
    met = one.join(two, (F.col("label1") == F.col("label2")) & (F.col("size1") == F.col("size2")) & (F.col("cells1") == F.col("cells2")) & (F.col("partner") == F.col("block2")))
    met = met.select(F.col("size1").alias("size"), F.when(F.col("same"), F.col("block1")).otherwise(-1).alias("block1"), "block2", *[n + s for s in ("1", "2") for n in held])
    return met.mapInArrow(partial(_summed, cosine=cosine, projections=projections, sorted_by=sorted_by, window=window, count=count, seed=seed), "a long, b long, near long")


def _half_steps(n: int) -> list[tuple[int, ...]]:
    from itertools import product

    return [s for s in product((-1, 0, 1), repeat=n) if s >= (0,) * n]


def near_vectors(vectors: DataFrame, *, cosine: float = 0.98, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    key = F.col("vec_id").cast("long")
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # doubles as bytes, each in the order numpy reads
    rows = vectors.select(key.alias("vec_id"), F.col("label"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    # ids may be null or repeated: distinct vectors of a label are the vertices, numbered in storage
    kinds = materialize(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    packed = kinds.select("node", "label", "v", "copies").mapInArrow(_as_bytes, "node long, label string, vec binary, copies long")
    links = materialize(vector_links(packed, cosine=cosine, **options))
    others = links.groupBy("a").agg(F.sum("near").alias("near"))
    known = components(kinds.select("node"), links)
    named = kinds.join(others.select(F.col("a").alias("node"), "near"), "node", "left").join(known, "node", "left")
    named = materialize(named.select(F.col("label").alias("l2"), F.col("v").alias("v2"), "vec_id", F.coalesce("component", "node").alias("g"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = materialize(named.groupBy("g").agg(F.min("vec_id").alias("component")))
    named = materialize(named.join(least, "g").select("l2", "v2", "component", "n_links"))
    out = rows.join(named, (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2")), "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def _as_bytes(batches):
    for batch in batches:
        lists = batch.column("v")
        body = [np.array(x, dtype=np.float64).tobytes() for x in lists.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label").cast(pa.string()), pa.array(body, pa.binary()), batch.column("copies")], names=["node", "label", "vec", "copies"])
