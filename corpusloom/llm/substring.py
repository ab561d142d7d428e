"""Substring dedup of word windows with a log-structured fingerprint index.

A window of ``window`` words is fingerprinted by the least hash of its k-grams of ``gram``
words; neighbouring windows share fingerprints, so an index entry stands for several windows.
The index is a list of immutable runs; a run holds, per hash range, the sorted fingerprints with
the document group of their single occurrence, or a mark that they have several.  A new batch is
cut into the same ranges, sorted and merge-joined with all runs; fingerprints seen twice or more
become marks for every document group that holds them, and what is new becomes the next run;
``compact`` merges runs.

Marked windows are then verified: their documents are read again, each window's 96-bit hash
(two independent hashes of all its words) goes to the hash's range with the group's first
(doc_id, start), and the range returns each hash to the one group that holds the first of all.
A window is removed unless it is that first one.  Everything exchanged is one packed value per
range and group, at most one entry per distinct hash and group, so a passage that a third of
all documents share stays small in every task; whole texts move once.

Defined results: null and wordless texts have 0 words; null doc_ids sort before all others; rows
that repeat a doc_id and text get the same result and do not remove each other's words (rows
that only repeat the doc_id are told apart by start and text order); empty tables give empty results;
extra columns are ignored.  Memory grows with the longest single text (about 60 bytes a byte).
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, chunks, group_count, is_in, materialize, mix64, named, packed, range_of, release_memory, rolling, runs_of, unpacked, window_least, winnow, with_groups, word_hashes, word_spans

_U = np.uint64
CHUNK = 1 << 20
PART = pa.schema([("r", pa.int32()), ("db", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])


class Windows:
    """Word windows of a chunk of texts."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        joined = b" ".join(texts)
        self.data = np.frombuffer(joined, dtype=np.uint8)
        self.starts, self.ends = word_spans(self.data)
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.first_byte = np.concatenate([[0], np.cumsum(size)])
        self.first_word = np.searchsorted(self.starts, self.first_byte)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first_word))
        self.words = word_hashes(self.data, self.starts, self.ends, 11)
        self.grams = rolling(self.words, gram, 0x9E3779B97F4A7C15)
        self.least = window_least(self.grams, window - gram + 1)
        n = len(self.least)
        self.valid = self.doc[:n] == self.doc[window - 1 : window - 1 + n] if n else np.zeros(0, dtype=bool)
        self.window = window

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every window."""
        again = mix64(self.words ^ _U(0x5851F42D4C957F2D))
        return rolling(self.words, self.window, 0xD1342543DE82EF95), (rolling(again, self.window, 0xDA942042E4DD58B5) >> _U(32)).astype(np.uint32)


def _fingerprints(batches, window: int, gram: int, ranges: int):
    """Per input batch: one row per range and group with its sorted distinct fingerprints."""
    for batch in batches:
        texts, group = batch.column("text").to_pylist(), np.asarray(batch.column("db"))
        h, g = [], []
        for a, b in chunks(texts, CHUNK):
            w = Windows(texts[a:b], window, gram)
            at = winnow(w.grams, w.least, w.valid)
            h.append(mix64(w.grams[at]))  # mixed again: least hashes crowd into the low ranges
            g.append(group[a:b][w.doc[at]])
        if h:
            yield from pack_fingerprints(np.concatenate(h), np.concatenate(g), ranges)
        release_memory()


def pack_fingerprints(h: np.ndarray, g: np.ndarray, ranges: int):
    """(r, db, hashes, several): distinct hashes by range with their group; db is -1, groups are packed."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    several = np.diff(np.append(at, len(h))) > 1
    h, g = h[at], g[at].astype(np.int32)
    r = range_of(h, ranges)
    first = runs_of(r)
    cuts = np.append(first, len(r))
    hashes, groups, many = packed([h, g, several], cuts)
    yield pa.RecordBatch.from_arrays([pa.array(r[first], pa.int32()), hashes, groups, many], names=["r", "hashes", "groups", "several"])


FINGERPRINTS = "r int, hashes binary, groups binary, several binary"
MERGED = "kind string, r int, hashes binary, groups binary, several binary"


def _merged(key: tuple[pa.Scalar, ...], new: pa.Table, runs: pa.Table) -> pa.Table:
    """Merge-join one range of a batch with the runs: marks for groups, and the next run.

    In runs, groups is the holder of the single occurrence; several: more are known (and marked)."""
    r = key[0].as_py()
    oh, og, os = unpacked(runs["hashes"], _U), unpacked(runs["groups"], np.int32), unpacked(runs["several"], bool)
    h, g, s = unpacked(new["hashes"], _U), unpacked(new["groups"], np.int32), unpacked(new["several"], bool)
    order = np.lexsort((g, h))
    h, g, s = h[order], g[order], s[order]
    order = np.lexsort((~os, oh))  # a later mark of several goes first
    oh, og, os = oh[order], og[order], os[order]
    at = runs_of(oh)
    oh, og, os = oh[at], og[at], os[at]
    first = runs_of(h)
    sizes = np.diff(np.append(first, len(h)))
    distinct = h[first]
    known = is_in(distinct, oh)
    place = np.searchsorted(oh, distinct)
    place[~known] = 0
    many = known | (sizes > 1) | (np.maximum.reduceat(s, first) if len(first) else np.zeros(0, dtype=bool))
    alone = known & ~(os[place] if len(os) else np.zeros(len(place), dtype=bool))
    to_new = np.repeat(many, sizes)
    mark_h = np.concatenate([h[to_new], oh[place[alone]]])
    mark_g = np.concatenate([g[to_new], og[place[alone]]])
    order = np.lexsort((mark_h, mark_g))
    mark_h, mark_g = mark_h[order], mark_g[order]
    cut = runs_of(mark_g)
    blobs = packed([mark_h], np.append(cut, len(mark_h)))[0]
    keep = ~known | alone  # new fingerprints, and those that now have several
    run = packed([distinct[keep], g[first][keep], many[keep]], np.array([0, int(keep.sum())]))
    none = pa.nulls(len(cut), pa.binary())
    return pa.table({
        "kind": ["mark"] * len(cut) + ["run"],
        "r": pa.array([*mark_g[cut].tolist(), r], pa.int32()),
        "hashes": pa.chunked_array([blobs, run[0]], pa.binary()),
        "groups": pa.chunked_array([none, run[1]], pa.binary()),
        "several": pa.chunked_array([none, run[2]], pa.binary()),
    })


def _compacted(key: tuple[pa.Scalar, ...], runs: pa.Table) -> pa.Table:
    h, g, s = unpacked(runs["hashes"], _U), unpacked(runs["groups"], np.int32), unpacked(runs["several"], bool)
    order = np.lexsort((~s, h))
    h, g, s = h[order], g[order], s[order]
    at = runs_of(h)
    cut = np.array([0, len(at)])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *packed([h[at], g[at], s[at]], cut)], names=["r", "hashes", "groups", "several"])


def _merge(key: tuple[pa.Scalar, ...], new: pa.Table, runs: pa.Table) -> pa.Table:
    out = _merged(key, new, runs)
    release_memory()
    return out


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints; ``add`` returns marks (db, hashes).

    ``ranges`` and ``groups`` stay fixed for the life of an index; ``write`` and ``read`` keep its
    runs as a Parquet table.
    """

    def __init__(self, spark: SparkSession, *, window: int = 20, gram: int = 5, ranges: int, groups: int, max_runs: int = 2):
        if not 0 < gram < window:
            raise ValueError("gram must be shorter than window")
        self.spark, self.window, self.gram, self.ranges, self.groups, self.max_runs = spark, window, gram, ranges, groups, max_runs
        self.runs: list[DataFrame] = []

    def _all_runs(self) -> DataFrame:
        out = self.spark.createDataFrame([], FINGERPRINTS)
        for x in self.runs:
            out = out.unionByName(x)
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """Merge a batch (doc_id, text) into the index; marks: which groups hold repeated fingerprints."""
        new = with_groups(docs, self.groups).mapInArrow(partial(_fingerprints, window=self.window, gram=self.gram, ranges=self.ranges), FINGERPRINTS)
        both = materialize(new.groupBy("r").cogroup(self._all_runs().groupBy("r")).applyInArrow(_merge, MERGED))
        self.runs.append(both.where("kind = 'run'").drop("kind"))
        if len(self.runs) > self.max_runs:
            self.compact()
        return both.where("kind = 'mark'").select(F.col("r").alias("db"), "hashes")

    def compact(self) -> None:
        self.runs = [materialize(self._all_runs().groupBy("r").applyInArrow(_compacted, FINGERPRINTS))]

    def write(self, path: str) -> None:
        self._all_runs().groupBy("r").applyInArrow(_compacted, FINGERPRINTS).write.mode("overwrite").parquet(path)

    def read(self, path: str) -> None:
        self.runs = [self.spark.read.parquet(path)]


def _in_order(docs: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """Ids, texts and places of the rows of a group, ordered by id and text."""
    rows = sorted(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), range(len(docs)), strict=True))
    return [d for d, *_ in rows], [t for _, t, _ in rows], [i for *_, i in rows]


def _candidates(docs: pa.Table, marks: pa.Table, window: int, gram: int):
    """Marked windows of a group, chunk by chunk: (chunk, texts, doc_ids, Windows, starts, h1, h2)."""
    ids, texts, _ = _in_order(docs)
    marked = np.unique(unpacked(marks["hashes"], _U))
    for a, b in chunks(texts, CHUNK):
        w = Windows(texts[a:b], window, gram)
        at = np.flatnonzero(w.valid & is_in(mix64(w.least), marked))
        h1, h2 = w.full()
        doc = np.array(ids[a:b], dtype=np.int64)[w.doc[at]] if len(at) else np.zeros(0, dtype=np.int64)
        yield texts[a:b], ids[a:b], w, at, h1[at], h2[at], doc, at - w.first_word[w.doc[at]]


def _group_firsts(h1, h2, doc, pos):
    """Order by hash then (doc, pos); where each distinct hash begins."""
    order = np.lexsort((pos, doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


WINDOWS = "r int, db int, h1 binary, h2 binary, doc binary, pos binary"


def _verified_rows(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table, window: int, gram: int, ranges: int) -> pa.Table:
    parts = [c[4:] for c in _candidates(docs, marks, window, gram)]
    h1, h2, doc, pos = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=t) for i, t in enumerate((_U, np.uint32, np.int64, np.int64)))
    order, new = _group_firsts(h1, h2, doc, pos)
    at = order[new]
    at = at[np.lexsort((pos[at], doc[at], range_of(h1[at], ranges)))]
    h1, h2, doc, pos = h1[at], h2[at], doc[at], pos[at]
    r = range_of(h1, ranges)
    cut = runs_of(r)
    step = np.diff(doc, prepend=0)
    step[cut] = doc[cut]
    zip_ = zstandard.ZstdCompressor(level=1)
    hashes, ends = packed([h1, h2], np.append(cut, len(r))), np.append(cut, len(r)).tolist()
    places = [pa.array([zip_.compress(x[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (step, pos.astype(np.uint32))]
    blobs = [*hashes, *places]
    db = pa.array(np.full(len(cut), key[0].as_py()), pa.int32())
    return pa.table([pa.array(r[cut], pa.int32()), db, *blobs], names=["r", "db", "h1", "h2", "doc", "pos"])


def _firsts(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Return each hash to the group that holds its first (doc_id, start)."""
    size = [len(x) // 8 for x in rows["h1"].to_pylist()]
    db = np.repeat(np.asarray(rows["db"]), size)
    unzip = zstandard.ZstdDecompressor().decompress
    h1, h2 = unpacked(rows["h1"], _U), unpacked(rows["h2"], np.uint32)
    doc = np.concatenate([np.zeros(0, dtype=np.int64), *[np.cumsum(np.frombuffer(unzip(x), dtype=np.int64)) for x in rows["doc"].to_pylist()]])
    pos = np.concatenate([np.zeros(0, dtype=np.uint32), *[np.frombuffer(unzip(x), dtype=np.uint32) for x in rows["pos"].to_pylist()]])
    order, new = _group_firsts(h1, h2, doc, pos)
    first = order[new]
    back = first[np.argsort(db[first], kind="stable")]
    cut = runs_of(db[back])
    return pa.table([pa.array(db[back][cut], pa.int32()), *packed([h1[back], h2[back]], np.append(cut, len(back)))], names=["db", "h1", "h2"])


def _verify_rows(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table, **options) -> pa.Table:
    out = _verified_rows(key, docs, marks, **options)
    release_memory()
    return out


def _first_of_all(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    out = _firsts(key, rows)
    release_memory()
    return out


#: doc_id is null where it is NO_ID.
CLEANED = "doc_id long, n_words long, n_removed long, kept binary"


def _clean(key: tuple[pa.Scalar, ...], docs: pa.Table, rows: pa.Table, window: int, gram: int, digest: bool) -> pa.Table:
    marks, firsts = rows.filter(pa.compute.is_null(rows["h2"])), rows.filter(pa.compute.is_valid(rows["h2"]))
    marks = marks.rename_columns(["hashes" if c == "h1" else c for c in marks.column_names])
    f1, f2 = unpacked(firsts["h1"], _U), unpacked(firsts["h2"], np.uint32)
    order = np.lexsort((f2, f1))
    f1, f2 = f1[order], f2[order]
    parts = list(_candidates(docs, marks, window, gram))
    h1, h2, doc, pos = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in range(4, 8))
    # the group's own first of each hash
    order, new = _group_firsts(h1, h2, doc, pos)
    which = np.cumsum(new) - 1
    own = order[new]
    is_own = np.zeros(len(h1), dtype=bool)
    is_own[order] = (doc[order] == doc[own][which]) & (pos[order] == pos[own][which]) if len(order) else False
    # a first of all: its pair of hashes came back (equal h1 with other h2 is looked through)
    place = np.searchsorted(f1, h1)
    won = np.zeros(len(h1), dtype=bool)
    for step in range(1 + int(np.diff(np.append(runs_of(f1), len(f1))).max(initial=0))):
        at = np.minimum(place + step, max(len(f1) - 1, 0))
        if len(f1):
            won |= (f1[at] == h1) & (f2[at] == h2)
    gone = ~(is_own & won)
    release_memory()
    out, done = [], 0
    for texts, ids, w, at, *_ in parts:
        starts = at[gone[done : done + len(at)]]
        done += len(at)
        step = np.zeros(len(w.words) + 1, dtype=np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        removed = np.cumsum(step[:-1]) > 0
        lost = np.concatenate([[0], np.cumsum(removed)])
        for i, t in enumerate(texts):
            a, b = w.first_word[i], w.first_word[i + 1]
            n, k = int(b - a), int(lost[b] - lost[a])
            if k == n:
                kept = b""
            elif digest or k:
                kept = b" ".join(x for x, gone_too in zip(t.split(), removed[a:b].tolist(), strict=True) if not gone_too) if k else b" ".join(t.split())
            else:
                kept = t
            out.append((ids[i], n, k, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    carried = [c for c in docs.column_names if c not in ("db", "doc_id", "text")]
    release_memory()
    more = docs.select(carried).take(pa.array(_in_order(docs)[2], pa.int64()))
    return pa.table([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary()), *more.columns], names=["doc_id", "n_words", "n_removed", "kept", *carried])


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` by ranges of doc_id, in order; null ids stand in the first."""
    if batches < 2:
        return [docs]
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    if not cuts:
        return [docs]
    cuts = sorted(set(cuts))
    low = [None, *cuts]
    out = []
    for a, b in zip(low, [*cuts, None], strict=True):
        x = docs
        if b is not None:
            x = x.where(F.col("doc_id").isNull() | (F.col("doc_id") <= b)) if a is None else x.where(F.col("doc_id") <= b)
        out.append(x if a is None else x.where(F.col("doc_id") > a))
    return out


def remove_repeated_windows(docs: DataFrame, *, window: int = 20, gram: int = 5, batches: int = 3, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every document (kept: the text, or its SHA-256 with ``digest``), and ``carry``.

    Where nothing is removed ``kept`` is the text itself, else the kept words joined by a space.
    The table is fed to the index in ``batches`` ranges of doc_id, each merged with what is there.
    """
    spark = docs.sparkSession
    parts = group_count(docs)
    index = FingerprintIndex(spark, window=window, gram=gram, ranges=parts, groups=parts)
    marks = [index.add(b) for b in in_batches(docs.select("doc_id", "text"), batches)]
    all_marks = marks[0]
    for m in marks[1:]:
        all_marks = all_marks.unionByName(m)
    grouped = with_groups(docs, parts, carry)
    seen = grouped.groupBy("db").cogroup(all_marks.groupBy("db")).applyInArrow(partial(_verify_rows, window=window, gram=gram, ranges=parts), WINDOWS)
    firsts = seen.groupBy("r").applyInArrow(_first_of_all, "db int, h1 binary, h2 binary")
    back = firsts.unionByName(all_marks.select("db", F.col("hashes").alias("h1"), F.lit(None).cast("binary").alias("h2")))
    out = grouped.groupBy("db").cogroup(back.groupBy("db")).applyInArrow(partial(_clean, window=window, gram=gram, digest=digest), StructType([*StructType.fromDDL(CLEANED), *[grouped.schema[f"_{c}"] for c in carry]]))
    real = F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")).alias("doc_id")
    return out.select(real, "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), *[named(f"_{c}").alias(c) for c in carry])
