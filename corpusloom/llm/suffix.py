"""Suffix-array dedup: maximal repeats of bytes from a common-prefix interval tree.

A sparse enhanced suffix array: suffixes start at content-defined places only.  A place is an
anchor if the hash of its ``gram`` bytes is the least of a window of ``length`` bytes, so every
repeated string of ``length`` bytes has anchors at the same offsets in all its occurrences.
Anchors whose hash occurs once in the corpus are dropped by a packed exchange; of the rest,
all suffixes of one anchor meet in one bucket.  There they are sorted, a stack scan over the
common prefixes of neighbours builds the interval tree (with nodes down to any number of
suffixes, not just neighbours), and each node's subtrees are merged with the order of
their left extensions: where left extensions differ, a node is a maximal repeat, and the longest
left match over subtrees tells each suffix how far its repeats reach to both sides.  Suffixes
with equal text on both sides stand as one with a count.

Buckets with more than ``bucket_cap`` anchors (known from the first exchange) are not
gathered: their windows are hashed whole, twice and independently, and counted by content, one entry per group
and hash, which gives the same removed bytes from any number of tasks.

Defined results: a null text is empty; rows that repeat a doc_id or a text are separate documents, so
exact copies remove each other; null doc_ids come back as null; empty tables give empty results; extra
columns are ignored.  Memory grows with the longest single text (about 60 bytes a byte).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, chunks, group_count, is_in, materialize, mix64, packed, range_of, rolling, runs_of, unpacked, window_least, winnow, with_groups

_U = np.uint64
CHUNK = 1 << 20


class Bytes:
    """Anchors of a chunk of texts."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.joined = b"".join(texts)
        self.data = np.frombuffer(self.joined, dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.values = self.data.astype(_U) + _U(1)
        self.grams = rolling(self.values, gram, 0x9E3779B97F4A7C15)
        self.least = window_least(self.grams, length - gram + 1)
        self.valid = np.zeros(len(self.least), dtype=bool)
        step = np.zeros(len(self.least) + 1, dtype=np.int64)
        for a, b in zip(self.first[:-1][size >= length].tolist(), self.first[1:][size >= length].tolist(), strict=True):
            step[a] += 1
            step[b - length + 1] -= 1
        self.valid = np.cumsum(step[:-1]) > 0
        self.at = winnow(self.grams, self.least, self.valid)
        self.doc = np.searchsorted(self.first, self.at, side="right") - 1
        self.prints = mix64(self.grams[self.at])  # mixed again: least hashes crowd into the low ranges

    def whole(self, length: int) -> list[np.ndarray]:
        """Two independent hashes of all windows of ``length`` bytes."""
        return [rolling(self.values, length, 0xD1342543DE82EF95), rolling(mix64(self.values), length, 0xDA942042E4DD58B5)]


def _pack(h: np.ndarray, g: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Distinct (hash, group) by range, with how often each occurs."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    h, g = h[at], g[at].astype(np.int32)
    r = range_of(h, ranges)
    cut = runs_of(r)
    return pa.RecordBatch.from_arrays([pa.array(r[cut], pa.int32()), *packed([h, g, n.astype(np.uint32)], np.append(cut, len(r)))], names=["r", "hashes", "groups", "counts"])


COUNTED = "r int, hashes binary, groups binary, counts binary"


def _anchors(batches, length: int, gram: int, ranges: int):
    for batch in batches:
        texts, group = batch.column("text").to_pylist(), np.asarray(batch.column("db"))
        h, g = [], []
        for a, b in chunks(texts, CHUNK):
            w = Bytes(texts[a:b], length, gram)
            h.append(w.prints)
            g.append(group[a:b][w.doc])
        if h:
            yield _pack(np.concatenate(h), np.concatenate(g), ranges)


def _repeated(key: tuple[pa.Scalar, ...], rows: pa.Table, cap: int) -> pa.Table:
    """Hashes of a range that occur twice or more, for each group that holds them; hot: more than ``cap`` times."""
    h, g, n = unpacked(rows["hashes"], _U), unpacked(rows["groups"], np.int32), unpacked(rows["counts"], np.uint32)
    order = np.argsort(h, kind="stable")
    h, g, n = h[order], g[order], n[order].astype(np.int64)
    first = runs_of(h)
    sizes = np.diff(np.append(first, len(h)))
    total = np.repeat(np.add.reduceat(n, first), sizes) if len(first) else n
    out = []
    for hot, keep in ((False, (total > 1) & (total <= cap)), (True, total > cap)):
        kh, kg = h[keep], g[keep]
        order = np.argsort(kg, kind="stable")
        kh, kg = kh[order], kg[order]
        cut = runs_of(kg)
        out.append(pa.table([pa.array(kg[cut], pa.int32()), pa.array([hot] * len(cut), pa.bool_()), *packed([kh], np.append(cut, len(kg)))], names=["db", "hot", "hashes"]))
    return pa.concat_tables(out)


MARKS = "db int, hot boolean, hashes binary"


def _in_order(docs: pa.Table) -> tuple[list[int], list[bytes]]:
    rows = sorted(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True))
    return [d for d, _ in rows], [t for _, t in rows]


def _marked(marks: pa.Table, hot: bool) -> np.ndarray:
    return np.unique(unpacked(marks.filter(pa.compute.equal(marks["hot"], hot))["hashes"], _U))


CONTEXTS = "r int, db int, hashes binary, doc binary, pos binary, ref binary, lens binary, body binary"


def _contexts(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table, length: int, gram: int, ranges: int) -> pa.Table:
    """Marked anchors with the text around them, by range; equal surroundings are sent once per group."""
    _, texts = _in_order(docs)
    plain, hot = _marked(marks, False), _marked(marks, True)
    hashes, doc, pos, around, whole = [], [], [], [], []
    for a, b in chunks(texts, CHUNK):
        w = Bytes(texts[a:b], length, gram)
        take = is_in(w.prints, plain)
        at, d = w.at[take], w.doc[take]
        low, high = w.first[d], w.first[d + 1]
        start, end = np.maximum(low, at - (length - gram)), np.minimum(high, at + length)
        around += [(at_ - s, w.joined[s:e]) for at_, s, e in zip(at.tolist(), start.tolist(), end.tolist(), strict=True)]
        hashes.append(w.prints[take])
        doc.append(d + a)
        pos.append(at - low)
        if len(hot):
            at = np.flatnonzero(w.valid & is_in(mix64(w.least), hot))
            whole += [h[at] for h in w.whole(length)]
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)
    doc = np.concatenate(doc) if len(h) else np.zeros(0, dtype=np.int64)
    pos = np.concatenate(pos) if len(h) else np.zeros(0, dtype=np.int64)
    order = np.argsort(h, kind="stable")
    r = range_of(h[order], ranges)
    cut = np.append(runs_of(r), len(r))
    zip_ = zstandard.ZstdCompressor(level=1)
    cols = {k: [] for k in ("r", "hashes", "doc", "pos", "ref", "lens", "body")}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        seen: dict = {}
        at = order[a:b]
        ref = [seen.setdefault(around[i], len(seen)) for i in at.tolist()]
        cols["r"].append(int(r[a]))
        cols["hashes"].append(h[at].tobytes())
        cols["doc"].append(doc[at].astype(np.uint32).tobytes())
        cols["pos"].append(pos[at].astype(np.int64).tobytes())
        cols["ref"].append(np.array(ref, dtype=np.uint32).tobytes())
        cols["lens"].append(np.array([(x, len(y)) for x, y in seen], dtype=np.uint16 if length < 30000 else np.uint32).tobytes())
        cols["body"].append(zip_.compress(b"".join(y for _, y in seen)))
    if whole:  # windows of hot anchors: only their hashes, counted in the same exchange
        p = _pack(np.concatenate(whole), np.full(sum(map(len, whole)), key[0].as_py()), ranges)
        cols["r"] += p["r"].to_pylist()
        cols["hashes"] += p["hashes"].to_pylist()
        cols["doc"] += [None] * len(p)
        cols["pos"] += [None] * len(p)
        cols["ref"] += p["counts"].to_pylist()
        cols["lens"] += p["groups"].to_pylist()
        cols["body"] += [None] * len(p)
    n = len(cols["r"])
    return pa.table([pa.array(cols["r"], pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()), *[pa.array(cols[k], pa.binary()) for k in ("hashes", "doc", "pos", "ref", "lens", "body")]], names=["r", "db", "hashes", "doc", "pos", "ref", "lens", "body"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def interval_tree(common: list[int]):
    """The intervals of an array of neighbours' common prefixes, children before parents:
    (depth, first, last, children) with children as node numbers or ~leaf."""
    stack: list[tuple[int, int, list[int]]] = []
    out = []
    n = len(common) + 1
    for leaf in range(n):
        depth = common[leaf] if leaf + 1 < n else -1
        child, first = ~leaf, leaf
        while stack and stack[-1][0] > depth:
            d, first, children = stack.pop()
            children.append(child)
            out.append((d, first, leaf, children))
            child = len(out) - 1
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(child)
        else:
            stack.append((depth, first, [child]))
    return out


def repeats_in_bucket(lefts: list[bytes], rights: list[bytes], length: int, groups: list | None = None) -> tuple[list[int], list[int]]:
    """For suffixes of one anchor with distinct surroundings: how far repeats of at least ``length`` bytes
    reach to the left and to the right of each (0, 0: none).

    ``groups``, if given, gets (left, right, members) of every maximal repeat: a node's common
    right side, the left side that its members share, and all members, where left extensions differ.
    """
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    common = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=lambda i: lefts[i][::-1])
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    turned = [x[::-1] for x in lefts]

    def left_match(i: int, j: int) -> int:
        return common_prefix(turned[i], turned[j])

    best_l, best_r = [0] * n, [0] * n

    def meet(i: int, j: int, depth: int) -> None:
        left = left_match(i, j)
        if left + depth >= length:
            for x in (i, j):
                if left > best_l[x]:
                    best_l[x] = left
                if depth > best_r[x]:
                    best_r[x] = depth

    members: list[list[int]] = []  # of each node: its suffixes' left ranks, in order
    for depth, _, _, children in interval_tree(common):
        parts = [[rank[order[~c]]] if c < 0 else members[c] for c in children]
        parts.sort(key=len, reverse=True)
        large = parts[0]
        for small in parts[1:]:
            for k in small:
                at = bisect_left(large, k)
                i = by_left[k]
                if at:
                    meet(i, by_left[large[at - 1]], depth)
                if at < len(large):
                    meet(i, by_left[large[at]], depth)
                insort(large, k)
        for c in children:
            if c >= 0:
                members[c] = []
        members.append(large)
        if groups is not None:
            _left_diverse(large, by_left, turned, depth, length, groups)
    return best_l, best_r


def _left_diverse(large: list[int], by_left: list[int], turned: list[bytes], depth: int, length: int, groups: list) -> None:
    """The node's left-extension intervals that are long enough: each is a maximal repeat."""
    if len(large) < 2:
        return
    near = [common_prefix(turned[by_left[a]], turned[by_left[b]]) for a, b in zip(large, large[1:], strict=False)]
    for left, first, last, _ in interval_tree(near):
        if left + depth >= length:
            groups.append((left, depth, [by_left[k] for k in large[first : last + 1]]))


SPANS = "db int, hot boolean, hashes binary, doc binary, low binary, high binary"


def _spans(key: tuple[pa.Scalar, ...], rows: pa.Table, length: int, gram: int) -> pa.Table:
    """Repeats of all buckets of a range: spans for each group's documents."""
    plain = rows.filter(pa.compute.is_valid(rows["body"]))
    unzip = zstandard.ZstdDecompressor()
    left_of, text_of, h, db, doc, pos, ref = [], [], [], [], [], [], []
    for row in plain.to_pylist():
        lens = np.frombuffer(row["lens"], dtype=np.uint16 if length < 30000 else np.uint32).reshape(-1, 2)
        body, at = unzip.decompress(row["body"]), 0
        base = len(text_of)
        for left, size in lens.tolist():
            text_of.append(body[at : at + size])
            left_of.append(left)
            at += size
        x = np.frombuffer(row["hashes"], dtype=_U)
        h.append(x)
        db.append(np.full(len(x), row["db"], dtype=np.int32))
        doc.append(np.frombuffer(row["doc"], dtype=np.uint32))
        pos.append(np.frombuffer(row["pos"], dtype=np.int64))
        ref.append(np.frombuffer(row["ref"], dtype=np.uint32).astype(np.int64) + base)
    hh = np.concatenate(h) if h else np.zeros(0, dtype=_U)
    order = np.argsort(hh, kind="stable")
    refs = np.concatenate(ref)[order].tolist() if h else []
    cut = np.append(runs_of(hh[order]), len(hh)).tolist()
    low, high = np.zeros(len(hh), dtype=np.int64), np.zeros(len(hh), dtype=np.int64)
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a < 2:
            continue
        alike: dict = {}
        for k in range(a, b):
            c = refs[k]
            alike.setdefault((left_of[c], text_of[c]), []).append(k)
        sides = [(t[:n], t[n:]) for n, t in alike]
        best_l, best_r = repeats_in_bucket([x for x, _ in sides], [y for _, y in sides], length) if len(sides) > 1 else ([0], [0])
        for (x, y), l_, r_, ks in zip(sides, best_l, best_r, alike.values(), strict=True):
            if len(ks) > 1 and len(x) + len(y) >= length:
                l_, r_ = len(x), len(y)
            if r_:
                low[ks], high[ks] = l_, r_
    back = order[high > 0]
    low, high = low[high > 0], high[high > 0]
    if len(back):
        dbs, docs, at = np.concatenate(db)[back], np.concatenate(doc)[back], np.concatenate(pos)[back]
    else:
        dbs, docs, at = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    by = np.argsort(dbs, kind="stable")
    cut = runs_of(dbs[by])
    blobs = packed([docs[by], (at - low)[by], (at + high)[by]], np.append(cut, len(by)))
    n = len(cut)
    out = pa.table([pa.array(dbs[by][cut], pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), *blobs], names=["db", "hot", "hashes", "doc", "low", "high"])
    hot = rows.filter(pa.compute.is_null(rows["body"]))
    if not len(hot):
        return out
    again = _repeated(key, pa.table([hot["hashes"], hot["lens"], hot["ref"]], names=["hashes", "groups", "counts"]), 1 << 62)
    m = len(again)
    more = pa.table([again["db"], pa.array([True] * m, pa.bool_()), again["hashes"], *[pa.nulls(m, pa.binary())] * 3], names=out.column_names)
    return pa.concat_tables([out, more])


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _clean(key: tuple[pa.Scalar, ...], docs: pa.Table, rows: pa.Table, length: int, gram: int, digest: bool) -> pa.Table:
    ids, texts = _in_order(docs)
    hot_hashes = _marked(rows.filter(pa.compute.is_null(rows["low"])), True)
    spans = rows.filter(pa.compute.is_valid(rows["low"]))
    doc, low, high = unpacked(spans["doc"], np.uint32).astype(np.int64), unpacked(spans["low"], np.int64), unpacked(spans["high"], np.int64)
    order = np.argsort(doc, kind="stable")
    doc, low, high = doc[order], low[order], high[order]
    out = []
    for a, b in chunks(texts, CHUNK):
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])])
        k, m = np.searchsorted(doc, [a, b])
        base = first[doc[k:m] - a]
        starts, ends = base + low[k:m], base + high[k:m]
        if len(hot_hashes):
            w = Bytes(texts[a:b], length, gram)
            at = np.flatnonzero(w.valid)
            for h in w.whole(length):  # both hashes occur again: 128 bits
                at = at[is_in(h[at], hot_hashes)]
            starts, ends = np.concatenate([starts, at]), np.concatenate([ends, at + length])
        step = np.zeros(int(first[-1]) + 1, dtype=np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, ends, -1)
        gone = np.cumsum(step[:-1]) > 0
        data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
        for i in range(b - a):
            g = gone[first[i] : first[i + 1]]
            n = int(g.sum())
            kept = texts[a + i] if not n else data[first[i] : first[i + 1]][~g].tobytes()
            runs = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            out.append((ids[a + i], len(g), n, runs, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.table([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _groups(key: tuple[pa.Scalar, ...], rows: pa.Table, length: int) -> pa.Table:
    """Maximal repeat groups of a range, in the surroundings of their anchors."""
    unzip = zstandard.ZstdDecompressor()
    bucket: dict = {}
    for row in rows.filter(pa.compute.is_valid(rows["body"])).to_pylist():
        lens = np.frombuffer(row["lens"], dtype=np.uint16 if length < 30000 else np.uint32).reshape(-1, 2).tolist()
        body, at, texts = unzip.decompress(row["body"]), 0, []
        for left, size in lens:
            texts.append((body[at : at + left], body[at + left : at + size]))
            at += size
        for x, d, p, r in zip(*[np.frombuffer(row[k], dtype=t).tolist() for k, t in (("hashes", _U), ("doc", np.uint32), ("pos", np.int64), ("ref", np.uint32))], strict=True):
            bucket.setdefault(x, {}).setdefault(texts[r], []).append((row["db"], d, p))
    out = []
    for x, alike in bucket.items():
        sides, where = list(alike), list(alike.values())
        found: list = []
        if len(sides) > 1:
            repeats_in_bucket([a for a, _ in sides], [b for _, b in sides], length, found)
        found += [(len(a), len(b), [i]) for i, (a, b) in enumerate(sides) if len(where[i]) > 1 and len(a) + len(b) >= length]
        for left, right, members in found:
            out.append((x - (1 << 64) if x >> 63 else x, left + right, [{"db": db, "doc": d, "start": p - left} for i in members for db, d, p in where[i]]))
    cols = list(zip(*out, strict=True)) if out else [()] * 3
    place = pa.struct([("db", pa.int32()), ("doc", pa.int64()), ("start", pa.int64())])
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(place))], names=["anchor", "length", "occurrences"])


def _marks_and_contexts(docs: DataFrame, length: int, gram: int, bucket_cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 bytes and shorter than length")
    parts = group_count(docs)
    grouped = with_groups(docs, parts)
    counted = grouped.mapInArrow(partial(_anchors, length=length, gram=gram, ranges=parts), COUNTED)

    def repeated(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _repeated(key, rows, bucket_cap)

    marks = materialize(counted.groupBy("r").applyInArrow(repeated, MARKS))
    return grouped, marks, grouped.groupBy("db").cogroup(marks.groupBy("db")).applyInArrow(partial(_contexts, length=length, gram=gram, ranges=parts), CONTEXTS)


def maximal_repeats(docs: DataFrame, *, length: int = 200, gram: int = 30) -> DataFrame:
    """(anchor, length, occurrences) of the maximal repeat groups around every anchor, all occurrences listed.

    Lengths are cut where the surroundings of an anchor end (``length`` bytes to either side); an
    occurrence is (db, doc, start): document number ``doc`` of group ``db`` in (doc_id, text) order.
    """
    def groups(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _groups(key, rows, length)

    contexts = _marks_and_contexts(docs, length, gram, 1 << 62)[2]  # every bucket is gathered
    return contexts.groupBy("r").applyInArrow(groups, "anchor long, length long, occurrences array<struct<db:int,doc:long,start:long>>")


def remove_repeated_bytes(docs: DataFrame, *, length: int = 200, gram: int = 30, bucket_cap: int = 200_000, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes, or their SHA-256 as text bytes with ``digest``)."""
    grouped, marks, contexts = _marks_and_contexts(docs, length, gram, bucket_cap)

    def spans(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _spans(key, rows, length, gram)

    found = contexts.groupBy("r").applyInArrow(spans, SPANS)
    out = grouped.groupBy("db").cogroup(found.groupBy("db")).applyInArrow(partial(_clean, length=length, gram=gram, digest=digest), CLEANED)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
