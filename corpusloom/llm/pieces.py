"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A batch of texts is cut into units that no piece can span; its distinct units are concatenated
and their suffixes sorted.  Every piece is binary-searched for its range of suffixes; the
occurrences are the edges of the batch, and are laid out by position.  Relaxing them follows
the model: in each unit, the best-scored edge that covers exactly two neighbouring
symbols joins them (leftmost first), until none is left.  For a BPE model this, and not the path
with the best sum of scores, is what the library computes.  Characters that stay alone
and are no piece become their bytes.

Suffixes are sorted by their first 8 characters (4, where a batch has over 254 different ones);
longer pieces compare the rest of each occurrence.  Units longer than ``LONG`` take a heap
instead of whole-batch rounds; edges and result are the same.

Defined results: a null or empty text has no ids; the model's own white-space mark
in a text decodes to a space, as in the library; repeated rows get equal results; empty tables
give empty results; extra columns are ignored.  Memory grows with the longest text
(about 80 bytes a character).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, mix64, named, release_memory, stream64

MARK = "▁"
LONG = 96
CHUNK = 1 << 18
NONE = np.int32(2**31 - 1)
_U = np.uint64


@dataclass
class PieceModel:
    """A vocabulary: pieces (None: control or byte), scores, and the ids of bytes."""

    pieces: list[str | None]
    scores: list[float]
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a SentencePiece model file on the driver."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        return cls([sp.id_to_piece(i) if ok else None for i, ok in enumerate(plain)], [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Encoder:
    """The model's tables, built once in each worker."""

    def __init__(self, model: PieceModel):
        known = [(p, i) for i, p in enumerate(model.pieces) if p]
        levels = {s: k for k, s in enumerate(sorted({model.scores[i] for _, i in known}, reverse=True))}
        self.chars = np.array(sorted({ord(c) for p, _ in known for c in p}), dtype=np.uint32)
        self.single = {ord(p): i for p, i in known if len(p) == 1}
        self.longest = max(len(p) for p, _ in known)
        long = [(p, i) for p, i in known if len(p) > 1]
        self.text = np.zeros((len(long), self.longest), dtype=np.int64)  # places in chars, plus 1
        for k, (p, _) in enumerate(long):
            self.text[k, : len(p)] = np.searchsorted(self.chars, [ord(c) for c in p]) + 1
        self.size = np.array([len(p) for p, _ in long])
        self.id = np.array([i for _, i in long], dtype=np.int32)
        self.level = np.array([levels[model.scores[i]] for _, i in long], dtype=np.int32)
        n = len(self.chars) + 1
        self.joins = np.zeros(n * n, dtype=bool) if n < 20000 else None
        if self.joins is not None:
            pairs = self.text[:, :-1] * n + self.text[:, 1:]
            self.joins[pairs[(self.text[:, 1:] > 0)]] = True
        self.byte_ids = np.array(model.byte_ids, dtype=np.int32)
        body = [b"" if p is None else p.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            body[i] = bytes([b])
        self.body = np.frombuffer(b"".join(body), dtype=np.uint8)
        self.body_size = np.array([len(b) for b in body])
        self.body_at = np.cumsum(self.body_size) - self.body_size

    # -- encoding

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more at the end)."""
        lines = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        if not len(code):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        place = np.searchsorted(self.chars, code)
        place[place == len(self.chars)] = 0
        sym = np.where(self.chars[place] == code, place + 1, 0)
        cut = np.ones(len(code), dtype=bool)
        if self.joins is not None:
            cut[1:] = ~self.joins[sym[:-1] * (len(self.chars) + 1) + sym[1:]]
        else:
            cut[1:] = False
        cut[begin[:-1][np.diff(begin) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(code)))
        # distinct units: a hash of content and length; two independent hashes must agree
        keys = stream64(int(size.max()) + 1, 5)
        unit = np.cumsum(cut) - 1
        at = np.arange(len(code)) - start[unit]
        value = code.astype(_U) + _U(1)
        h1 = mix64(np.add.reduceat(value * keys[at], start) + size.astype(_U) * keys[-1])
        h2 = np.add.reduceat(mix64(value) * mix64(keys)[at], start)
        _, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        if not (np.array_equal(h2[first][inverse], h2) and np.array_equal(size[first][inverse], size)):
            first, inverse = np.arange(len(start)), np.arange(len(start))
        ids, n = self._units(code, sym, start[first], size[first])
        offset = np.cumsum(n) - n
        count = n[inverse]
        total = np.cumsum(count)
        out = ids[np.arange(int(total[-1])) - np.repeat(total - count - offset[inverse], count)]
        ends = np.concatenate([[0], total])
        return out, ends[np.searchsorted(start, begin)]

    def _units(self, code, sym, start, size) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units in a row, and how many each has."""
        stretch = size + 1  # a separator after each unit
        base = np.cumsum(stretch) - stretch
        total = int(stretch.sum())
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        c = np.zeros(total, dtype=np.int64)
        where = base[owner] + inside
        c[where] = sym[start[owner] + inside]
        raw = np.zeros(total, dtype=np.uint32)
        raw[where] = code[start[owner] + inside]
        level, piece = self._edges(c)
        s, e, u = where, where + 1, owner
        done_s, done_e, done_u = [], [], []
        long = size > LONG
        if long.any():
            for k in np.flatnonzero(long).tolist():
                a, b = self._heap(level, int(base[k]), int(size[k]))
                done_s.append(a)
                done_e.append(b)
                done_u.append(np.full(len(a), k))
            keep = ~long[u]
            s, e, u = s[keep], e[keep], u[keep]
        while len(s):
            gap = e[1:] - s[:-1]
            pair = np.full(len(s), NONE, dtype=np.int32)
            ok = (u[1:] == u[:-1]) & (gap <= self.longest)
            pair[:-1][ok] = level[s[:-1][ok], gap[ok]]
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            best = np.minimum.reduceat(pair, first)
            of = np.cumsum(np.concatenate([[0], (u[1:] != u[:-1]).astype(np.int64)]))
            open_ = best[of] != NONE
            hit = np.flatnonzero(open_ & (pair == best[of]))
            if len(hit):  # leftmost of each unit
                hit = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])]
                e = e.copy()
                e[hit] = e[hit + 1]
            rest = ~open_
            done_s.append(s[rest])
            done_e.append(e[rest])
            done_u.append(u[rest])
            open_[hit + 1] = False
            s, e, u = s[open_], e[open_], u[open_]
        s, e = np.concatenate(done_s), np.concatenate(done_e)
        order = np.argsort(s, kind="stable")
        s, e, u = s[order], e[order], np.concatenate(done_u)[order]
        return self._ids(raw, piece, s, e, u, len(size))

    def _edges(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of all pieces in the symbols c (0: none): level and id by (start, length)."""
        own = np.unique(c)
        own = own[own > 0]
        bits = 8 if len(own) < 255 else 16
        depth = 64 // bits
        small = np.zeros(len(self.chars) + 2, dtype=np.int64)
        small[own] = np.arange(1, len(own) + 1)
        x = small[c].astype(_U)
        key = np.zeros(len(c), dtype=_U)
        for k in range(depth):
            key[: len(c) - k] |= x[k:] << _U(64 - bits * (k + 1))
        suffix = np.argsort(key, kind="stable")
        ordered = key[suffix]
        local = small[self.text]
        there = np.flatnonzero(((local > 0) | (self.text == 0)).all(axis=1))
        low = np.zeros(len(there), dtype=_U)
        for k in range(min(depth, self.longest)):
            low |= local[there, k].astype(_U) << _U(64 - bits * (k + 1))
        free = 64 - bits * np.minimum(self.size[there], depth)
        high = low | np.where(free > 0, (_U(1) << free.astype(_U)) - _U(1), _U(0))
        a, b = np.searchsorted(ordered, low, side="left"), np.searchsorted(ordered, high, side="right")
        n = b - a
        which = np.repeat(np.arange(len(there)), n)
        at = suffix[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - a, n)]
        piece = there[which]
        far = self.size[piece] > depth
        if far.any():
            keep = ~far
            i, j = at[far], piece[far]
            padded = np.concatenate([c, np.zeros(self.longest, dtype=c.dtype)])
            same = np.ones(len(i), dtype=bool)
            for k in range(depth, self.longest):
                more = self.size[j] > k
                same &= ~more | (padded[i + k] == self.text[j, k])
            keep[np.flatnonzero(far)[same]] = True
            at, piece = at[keep], piece[keep]
        level = np.full((len(c), self.longest + 1), NONE, dtype=np.int32)
        ids = np.full((len(c), self.longest + 1), -1, dtype=np.int32)
        level[at, self.size[piece]] = self.level[piece]
        ids[at, self.size[piece]] = self.id[piece]
        return level, ids

    def _heap(self, level: np.ndarray, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Relax one long unit."""
        end = list(range(1, n + 1))
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and end[j] - i <= self.longest:
                v = level[base + i, end[j] - i]
                if v != NONE:
                    heapq.heappush(heap, (int(v), i, end[i], end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, m, e = heapq.heappop(heap)
            if not alive[i] or end[i] != m or after[i] < 0 or end[after[i]] != e:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = e, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        s = np.array([i for i in range(n) if alive[i]])
        return s + base, np.array(end)[s] + base

    def _ids(self, raw, piece, s, e, u, units) -> tuple[np.ndarray, np.ndarray]:
        ids = piece[s, e - s]
        one = np.flatnonzero(e - s == 1)
        kinds, back = np.unique(raw[s[one]], return_inverse=True)
        ids[one] = np.array([self.single.get(int(k), -1) for k in kinds], dtype=np.int32)[back] if len(kinds) else ids[one]
        bare = np.flatnonzero(ids < 0)
        n = np.ones(len(ids), dtype=np.int64)
        if len(bare):
            kinds, back = np.unique(raw[s[bare]], return_inverse=True)
            spelled = [self.byte_ids[list(chr(int(k)).encode("utf-8", "surrogatepass"))] for k in kinds]
            n[bare] = np.array([len(x) for x in spelled])[back]
            out = np.repeat(ids, n)
            at = (np.cumsum(n) - n)[bare]
            for k, x in enumerate(spelled):
                for t in range(len(x)):
                    out[at[back == k] + t] = x[t]
            ids = out
        return ids, np.bincount(np.repeat(u, n), minlength=units)

    # -- decoding

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts' bytes; the first white-space mark of each text is dropped."""
        n = self.body_size[ids]
        total = np.cumsum(n)
        data = self.body[np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n - self.body_at[ids], n)].tobytes()
        at = np.concatenate([[0], total])[ends].tolist()
        out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        return [x[1:] if x[:1] == b" " else x for x in out]


def _encode(batches, model: PieceModel):
    enc = Encoder(model)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rest = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        names = [*[batch.schema.names[i] for i in rest], "n_ids", "ids", "round_trip"]
        for a, b in chunks(texts, CHUNK):
            x, ends = enc.encode(texts[a:b])
            whole = [d == t.encode("utf-8", "surrogatepass") for d, t in zip(enc.decode(x, ends), texts[a:b], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in rest], pa.array(np.diff(ends), pa.int64()), lists, pa.array(whole, pa.bool_())], names=names)
            release_memory()


def encode_documents(docs: DataFrame, model: PieceModel, carry: list[str]) -> DataFrame:
    """``carry`` with n_ids, ids (array of int) and round_trip: do the ids decode to the text."""
    rows = docs.select(*map(named, carry), "text")
    return rows.mapInArrow(partial(_encode, model=model), StructType([*rows.schema.fields[:-1], *StructType.fromDDL("n_ids long, ids array<int>, round_trip boolean")]))


def _decode(batches, model: PieceModel):
    enc = Encoder(model)
    for batch in batches:
        ids = [x or [] for x in batch.column("ids").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        texts = enc.decode(np.array([y for x in ids for y in x], dtype=np.int64), ends)
        rest = [i for i, c in enumerate(batch.schema.names) if c != "ids"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*[batch.schema.names[i] for i in rest], "decoded"])


def decode_documents(rows: DataFrame, model: PieceModel, carry: list[str]) -> DataFrame:
    """``carry`` with the text of ``ids``."""
    rows = rows.select(*map(named, carry), F.col("ids"))
    return rows.mapInArrow(partial(_decode, model=model), StructType([*rows.schema.fields[:-1], *StructType.fromDDL("decoded string")]))
