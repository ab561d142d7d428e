"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 two-bit segments.  Flipping a bit moves one count
by one, so the Manhattan distance of two count vectors is at most the Hamming distance: a lower
bound that filters before the exact check.  The join is a grid join: counts are cut into
blocks of segments, and vectors within distance d agree in all but d blocks, so every choice of
blocks that leaves d out is a grid, and near vectors share a cell of at least one grid.

Cells with more than ``cell_cap`` fingerprints are not expanded into pairs.  Their fingerprints
go through balls instead: each emits itself and its 64 one-bit changes, and those that
share a code are within two bits of each other, so linking each to the least holder of a code
is exact and linear.  (Larger distances than 2 keep to grids and pairs.)

Only distinct fingerprints are joined, so exact copies cost one row.  Links of fingerprints go to
connected components, labelled by the smallest doc_id at the end.

Defined results: a text without words (or null) has fingerprint 0 and is linked like any other; null
doc_ids take part, come back as null and are the last choice for a component's id; rows
that repeat a doc_id are separate rows, linked by their fingerprints only; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, is_in, materialize, mix64, release_memory, rolling, stream64, word_hashes, word_spans

ODD = 0x5555555555555555
PRINTS = "doc_id long, fp long"


def fingerprint(text: bytes, width: int, digest, seed: int) -> int:
    """The SimHash of the word shingles of a text, repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return digest(line, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    h = np.fromiter([digest(line[a:b], seed) for a, b in zip(begin[: len(words) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def _fingerprints(batches, width: int, seed: int):
    from xxhash import xxh64_intdigest

    for batch in batches:
        fps = [fingerprint(t, width, xxh64_intdigest, seed) for t in batch.column("text").to_pylist()]
        fps = np.array(fps, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])


def simhashes(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every whole text; A-Z lower-cased."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, width=width, seed=seed), PRINTS)


def segment_counts(fp: Column) -> Column:
    """The counts of the 32 two-bit segments in unary code (0: 00, 1: 01, 2: 11), so that the bit count
    of the difference of two codes is the Manhattan distance of the count vectors."""
    a, b = fp.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(blocks: int, distance: int) -> list[int]:
    """The bits of every choice of ``blocks - distance`` blocks of segments."""
    cuts = [32 * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(block, blocks - distance)]


def fingerprint_links(prints: DataFrame, *, distance: int = 2, blocks: int = 5, cell_cap: int = 32) -> DataFrame:
    """Links (a, b) that connect all of ``prints`` (rep, fp; distinct fp) within ``distance`` bits."""
    if not 0 < distance < blocks:
        raise ValueError("blocks must exceed distance")
    code = segment_counts(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), code.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grid_masks(blocks, distance))])
    rows = prints.select("rep", "fp", F.explode(cells).alias("c")).select("rep", "fp", "c.grid", "c.cell")
    sizes = materialize(rows.groupBy("grid", "cell").count().where("count > 1"))
    held = materialize(rows.join(sizes, ["grid", "cell"]))
    small = held if distance > 2 else held.where(F.col("count") <= cell_cap)
    side = lambda s: small.select("grid", "cell", *[F.col(c).alias(c + s) for c in ("rep", "fp")])
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    pairs = side("1").join(side("2"), ["grid", "cell"]).where("rep1 < rep2")
    pairs = pairs.where(apart(segment_counts(F.col("fp1")), segment_counts(F.col("fp2"))) <= distance)
    links = pairs.where(apart(F.col("fp1"), F.col("fp2")) <= distance).select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))
    if distance > 2:
        return links
    dense = held.where(F.col("count") > cell_cap).select("rep", "fp").distinct()
    masks = F.array(*[F.lit(_signed(m)) for m in [0, *(1 << i for i in range(64))]])
    balls = materialize(dense.select("rep", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("ball")))
    least = materialize(balls.groupBy("ball").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("ball", "b"))
    return links.unionByName(balls.join(least, "ball").where("rep <> b").select(F.col("rep").alias("a"), "b"))


def simhash_components(docs: DataFrame, *, width: int = 3, seed: int = 42, distance: int = 2, blocks: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialize(simhashes(docs, width=width, seed=seed))
    ids = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    reps = ids.select(F.col("fp").alias("rep"), "fp")  # ids may be null or repeated: fingerprints are the vertices
    known = components(reps.select(F.col("rep").alias("node")), fingerprint_links(reps, distance=distance, blocks=blocks))
    known = known.select(F.col("node").alias("fp"), F.col("component").alias("g"))
    named = materialize(ids.join(known, "fp", "left").select("fp", "doc_id", F.coalesce("g", "fp").alias("g")))
    least = materialize(named.groupBy("g").agg(F.min("doc_id").alias("component")))
    out = prints.join(materialize(named.join(least, "g").select("fp", "component")), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# ------------------------------------------------- near copies by shingle similarity

#: Bits of the SimHash of a shingle set, in words of 64.
SKETCH = 256
KS = [f"k{i}" for i in range(SKETCH // 64)]
SHINGLED = "content long, size int, " + ", ".join(f"{k} long" for k in KS) + ", cells array<long>"
#: Keys that are broadcast at most: some tens of MB.
MOST_KEYS = 1_000_000
SHINGLE_SEED, SHINGLE_BASE = 5, 0x9E3779B97F4A7C15
#: Minwise grids, and least hashes that a cell of one joins: a pair at a similarity of 0.8 shares no cell with a chance of 0.0007.
GRIDS, JOINED = 24, 6
#: Grids of segment counts of the SimHash.
COUNT_GRIDS = 16


def shingle_sets(texts: list[bytes], width: int):
    """The sorted distinct 64-bit hashes of each text's word shingles, A-Z lower-cased (shorter texts: of all words)."""
    for first, last in chunks(texts, 1 << 18):
        part = texts[first:last]
        data = np.frombuffer(b" ".join(part).lower(), dtype=np.uint8)
        starts, ends = word_spans(data)
        words = word_hashes(data, starts, ends, SHINGLE_SEED)
        cuts = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in part]])).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield np.unique(rolling(words[a:b], min(width, b - a), SHINGLE_BASE)) if b > a else words[:0]


def minwise_cells(sets: list[np.ndarray], grids: int, joined: int) -> np.ndarray:
    """(sets, grids): of each grid a hash of the set's ``joined`` least hashes under as many permutations."""
    filled = [s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets]  # texts without words meet each other
    flat = np.concatenate(filled)
    starts = np.cumsum([0, *[len(s) for s in filled[:-1]]])
    factors = stream64(grids * joined, SHINGLE_SEED).reshape(grids, joined)
    out = np.empty((len(sets), grids), dtype=np.uint64)
    for g in range(grids):
        key = np.full(len(sets), g + 1, dtype=np.uint64)
        for f in factors[g]:
            key = mix64(key + np.minimum.reduceat(flat * f, starts))
        out[:, g] = key
    return out


def wide_simhash(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SKETCH / 64) words: a bit is 1 if it is set in over half of the set's hashes (hashed anew for each word)."""
    filled = [s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets]
    flat = np.concatenate(filled)
    size = np.array([len(s) for s in filled])
    starts = np.cumsum(size) - size
    out = np.empty((len(sets), len(KS)), dtype=np.uint64)
    for k, f in enumerate(stream64(len(KS), SHINGLE_SEED + 1)):
        counts = np.zeros((len(sets), 64), dtype=np.int64)
        for a in range(0, len(flat), 1 << 16):
            h = mix64(flat[a : a + (1 << 16)] * f)
            i, j = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, a + len(h))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            counts[i:j] += np.add.reduceat(bits, np.maximum(starts[i:j] - a, 0), axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * counts > size[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def count_cells(prints: np.ndarray, grids: int, chosen: int) -> np.ndarray:
    """(prints, grids): of each grid a hash of the counts (in ``segment_counts``' code) of ``chosen`` two-bit segments."""
    a, b = prints & np.uint64(ODD), prints >> np.uint64(1) & np.uint64(ODD)
    code = a | b | (a & b) << np.uint64(1)
    out = np.empty((len(prints), grids), dtype=np.uint64)
    for g in range(grids):
        masks = [0] * len(KS)
        for s in np.argsort(stream64(SKETCH // 2, SHINGLE_SEED + 2 + g))[:chosen].tolist():
            masks[s // 32] |= 3 << 2 * (s % 32)
        key = np.full(len(prints), GRIDS + g + 1, dtype=np.uint64)
        for k, m in enumerate(masks):
            key = mix64(key * np.uint64(SHINGLE_BASE) + (code[:, k] & np.uint64(m)))
        out[:, g] = key
    return out


def _shingled(batches, width: int, grids: int, joined: int, chosen: int):
    for batch in batches:
        content, texts = np.asarray(batch.column("content")), batch.column("text").to_pylist()
        for first, last in chunks(texts, 1 << 20):
            sets = list(shingle_sets(texts[first:last], width))
            prints = wide_simhash(sets)
            cells = np.concatenate([count_cells(prints, COUNT_GRIDS, chosen), minwise_cells(sets, grids, joined)], axis=1).view(np.int64)
            bits = prints.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * cells.shape[1], pa.int32()), pa.array(cells.reshape(-1)))
            size = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(content[first:last]), size, *[pa.array(bits[:, k].copy()) for k in range(len(KS))], lists], names=["content", "size", *KS, "cells"])
        release_memory()


def _packed_sets(batches, width: int):
    for batch in batches:
        out = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), width)]
        yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(out, pa.binary())], names=["content", "shingles"])
        release_memory()


def _similar(batches, similarity: float):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = int(is_in(x, y).sum())
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def within_reach(similarity: float) -> Column:
    """Whether marks 1 and 2 (size and words of the SimHash) may belong to sets of ``similarity``.

    The Manhattan distance of the counts of two-bit segments is at most the Hamming distance of the SimHashes.  Of two sets
    the bits differ by chance, each with that of the angle between them, or up to 1.3 times that in small sets with
    ties; the bound is seven standard deviations above, so a similar pair fails with a chance under 10^-9.
    """
    total = lambda f: sum((F.bit_count(f(F.col(k + "1")).bitwiseXOR(f(F.col(k + "2")))) for k in KS), F.lit(0))
    p = min(1.3 * math.acos(2 * similarity / (1 + similarity)) / math.pi, 0.5)
    most = SKETCH * p + 7 * math.sqrt(SKETCH * p * (1 - p))
    return (F.least("size1", "size2") >= similarity * F.greatest("size1", "size2") - 1e-9) & (total(segment_counts) <= most) & (total(lambda x: x) <= most)


def _marked(df: DataFrame, marks: DataFrame, key: str, side: str) -> DataFrame:
    return df.join(marks.select(F.col("content").alias(key), *[F.col(c).alias(c + side) for c in ("size", *KS)]), key)


def near_groups(marks: DataFrame, cells: DataFrame, verified, similarity: float) -> DataFrame:
    """(content, g): components of what shares a cell and is similar (marks: content, size, segments; cells: content, cell).

    Each member of a cell is verified against the cell's head, the member that meets most others over all its
    cells.  Then members that the head's component lacks are compared with all of the cell outside their own.
    Cells with the same members count as one.
    """
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("content")).alias("members")).where("n > 1")
    sizes = sizes.groupBy("n", "members").agg(F.min("cell").alias("cell"), F.count(F.lit(1)).alias("alike"))
    held = materialize(cells.join(sizes.select("cell", (F.col("n") * F.col("alike")).alias("weight")), "cell"))
    meets = held.groupBy("content").agg(F.sum("weight").alias("meets"))
    heads = held.join(meets, "content").groupBy("cell").agg(F.max(F.struct("meets", "content"))["content"].alias("head"))
    held = materialize(held.join(heads, "cell").select("cell", "content", "head"))
    pairs = held.where("head <> content").select(F.col("head").alias("a"), F.col("content").alias("b")).distinct()
    links = verified(_marked(_marked(pairs, marks, "a", "1"), marks, "b", "2").where(within_reach(similarity)).select("a", "b"))
    group = components(held.select(F.col("content").alias("node")).distinct(), links)
    held_groups = mates = materialize(held.join(group.select(F.col("node").alias("content"), F.col("component").alias("g")), "content", "left").select("cell", "content", F.coalesce("g", "content").alias("g"), (F.col("head") == F.col("content")).alias("first")))
    mixed = mates.groupBy("cell").agg(F.max(F.when(F.col("first"), F.col("g"))).alias("top"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("cell", "top")
    mates = mates.where("not first").join(mixed, "cell")
    mates = _marked(mates.select("cell", F.col("content").alias("a"), "g", "top"), marks, "a", "1")
    rest = mates.where("g <> top")
    other = mates.select("cell", F.col("a").alias("b"), F.col("g").alias("h"), *[F.col(c + "1").alias(c + "2") for c in ("size", *KS)])
    once = (F.col("h") == F.col("top")) | (F.col("a") < F.col("b"))
    more = verified(rest.join(other, "cell").where((F.col("g") != F.col("h")) & once & within_reach(similarity)).select("a", "b").distinct())
    known = held_groups.select("content", "g").distinct()
    if not more.limit(1).count():
        return known
    of = lambda c: known.select(F.col("content").alias(c), F.col("g").alias("g" + c))
    joined = materialize(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
    over = components(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct(), joined)
    return known.join(over.select(F.col("node").alias("g"), "component"), "g", "left").select("content", F.coalesce("component", "g").alias("g"))


def near_copies(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, content (XXH64 of the text, seed 42), component_id, kept: documents whose word shingles have a
    Jaccard similarity of ``similarity`` or more.

    Every shingle set has a SimHash of 256 bits, which is mapped to the counts of its two-bit segments; texts meet in cells of
    grids, each of which holds the counts of some segments.  Pairs are held against the Manhattan bound and the SimHashes'
    distance (``within_reach``), and what is left is verified on the shingle sets; links go to components.  The number of
    segments grows with the logarithm of the table, so that a cell holds few unrelated texts.  At a similarity of 0.8 some 15% of the bits
    differ, so that no affordable number of such grids brings all pairs together: minwise cells of the shingle sets add those that it leaves.

    Texts are told apart by their content; components take the smallest doc_id at the end, and ``kept``
    marks the first row of each by doc_id (nulls last) and content.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.cast("binary").alias("text"))
    texts = rows.select("content", "text")
    chosen = 2 + math.ceil(math.log(max(docs.count(), 1)) / math.log(8 / 3))  # unrelated segments agree in 3 of 8
    reps = materialize(texts.mapInArrow(partial(_shingled, width=width, grids=GRIDS, joined=JOINED, chosen=chosen), SHINGLED).dropDuplicates(["content"]))

    def verified(pairs: DataFrame) -> DataFrame:
        close = materialize(pairs)
        wanted = materialize(close.select(F.explode(F.array("a", "b")).alias("content")).distinct())
        n = wanted.count()
        if not n:
            return close
        if n <= MOST_KEYS:
            wanted = F.broadcast(wanted)  # else every text goes through an exchange to find a few
        sets = materialize(texts.join(wanted, "content", "left_semi").mapInArrow(partial(_packed_sets, width=width), "content long, shingles binary").dropDuplicates(["content"]))
        side = lambda c, s: sets.select(F.col("content").alias(c), F.col("shingles").alias(s))
        return materialize(close.join(side("b", "s2"), "b").join(side("a", "s1"), "a").mapInArrow(partial(_similar, similarity=similarity), "a long, b long"))

    grouped = near_groups(reps.drop("cells"), reps.select("content", F.explode("cells").alias("cell")), verified, similarity)
    ids = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    named = materialize(ids.join(grouped, "content", "left").select("content", "doc_id", F.coalesce("g", "content").alias("g")))
    placed = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    least = named.groupBy("g").agg(F.min(placed).alias("first"))
    named = materialize(named.join(least, "g").select("content", "first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content"))
    return rows.select("doc_id", "content").join(named, "content").select("doc_id", "content", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; columns as in ``docs``.

    A row without a doc_id gives way to near copies that have one; of a group without any, one row stays.  Of
    rows that repeat the kept doc_id and text one stays.
    """
    known = materialize(near_copies(docs, **options).groupBy(F.col("doc_id").alias("k1"), F.col("content").alias("k2")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    rows = docs.select(F.col("doc_id").alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), F.struct("*").alias("row"))
    of = lambda keys: keys.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    here = F.col("k1").eqNullSafe(F.col("c1")) & (F.col("k2") == F.col("c2"))
    kept = rows.join(of(known.where("not kept or n > 1")), here, "left_anti").select("row.*")
    twice = known.where("kept and n > 1")
    if not twice.limit(1).count():
        return kept
    return kept.unionByName(rows.join(of(twice), here, "left_semi").dropDuplicates(["k1", "k2"]).select("row.*"))
