"""Language ID with a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled: texts are cut into windows of ``WINDOW`` bytes, a forward
and a backward network of gated recurrent units read each window, and both states give
the language probabilities of each position.  A document's probabilities are the mean over all its
positions.  Training is numpy on the driver, by backpropagation through time with Adam,
on windows of a bounded, seeded sample of labelled rows; everything else of the text goes
through the network in Arrow batches, many windows at a time.

Only text is read for a prediction.  Defined results: ``und`` with score 0 where the text
is null or has no letter, or where no labelled row could be learned from; a null doc_id counts as
not held out and is not learned from; repeated rows get equal results; empty tables give empty results; extra
columns are ignored.  Memory grows with the longest single text (about 30 bytes a byte).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, named, release_memory

WINDOW = 64
CHUNK = 1 << 18
_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * (np.tanh(_F(0.5) * x) + _F(1))


@dataclass
class Network:
    """Weights: inputs and recurrences of the two directions, and the output layer."""

    langs: list[str]
    w: dict[str, np.ndarray]

    def states(self, x: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States (steps, rows, units) after each byte; x is (rows, steps), read in its order."""
        table, u_zr, u_n = self.w[f"in_{side}"], self.w[f"zr_{side}"], self.w[f"n_{side}"]
        rows, steps = x.shape
        units = u_n.shape[0]
        h = np.zeros((rows, units), dtype=_F)
        out = np.empty((steps, rows, units), dtype=_F)
        x = np.ascontiguousarray(x.T)
        for t in range(steps):
            a = table.take(x[t], axis=0)
            zr = _sigmoid(a[:, : 2 * units] + h @ u_zr)
            z, r = zr[:, :units], zr[:, units:]
            rh = r * h
            n = np.tanh(a[:, 2 * units :] + rh @ u_n)
            new = n + z * (h - n)
            if trace is not None:
                trace.append((h, z, r, rh, n))
            out[t] = h = new
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, rows, languages) for windows of bytes (rows, steps)."""
        f = self.states(x, "f")
        b = self.states(x[:, ::-1], "b")[::-1]
        units = f.shape[2]
        y = f @ self.w["out"][:units] + b @ self.w["out"][units:] + self.w["bias"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y


def _backward(net: Network, side: str, x: np.ndarray, trace: list, d_out: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction; d_out: (steps, rows, units)."""
    u_zr, u_n = net.w[f"zr_{side}"], net.w[f"n_{side}"]
    units = u_n.shape[0]
    d_table, d_zr, d_n = (np.zeros_like(net.w[f"{k}_{side}"]) for k in ("in", "zr", "n"))
    dh = np.zeros(d_out.shape[1:], dtype=_F)
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, rh, n = trace[t]
        dh = dh + d_out[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        d_rh = dn @ u_n.T
        dr = d_rh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], axis=1)
        np.add.at(d_table, x[:, t], np.concatenate([gates, dn], axis=1))
        d_zr += h.T @ gates
        d_n += rh.T @ dn
        dh = dh * z + d_rh * r + gates @ u_zr.T
    grad[f"in_{side}"], grad[f"zr_{side}"], grad[f"n_{side}"] = d_table, d_zr, d_n


def train(texts: list[bytes], langs: list[str], *, units: int = 8, steps: int = 300, rows: int = 192, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit on windows drawn evenly over languages; the same input gives the same network."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    by = {k: [np.frombuffer(t, dtype=np.uint8) for t, x in zip(texts, langs, strict=True) if x == k and t] for k in names}
    scale = lambda *s: (rng.standard_normal(s) * 0.3).astype(_F)
    w = {}
    for side in "fb":
        w |= {f"in_{side}": scale(256, 3 * units), f"zr_{side}": scale(units, 2 * units), f"n_{side}": scale(units, units)}
    w |= {"out": scale(2 * units, len(names)), "bias": np.zeros(len(names), dtype=_F)}
    net = Network(names, w)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    usable = [k for k in range(len(names)) if by[names[k]]]
    for step in range(1, steps + 1):
        y = rng.choice(usable, rows)
        x = np.zeros((rows, WINDOW), dtype=np.uint8)
        real = np.zeros((WINDOW, rows), dtype=bool)
        for i, k in enumerate(y):
            t = by[names[k]][rng.integers(len(by[names[k]]))]
            at = rng.integers(max(1, len(t) - WINDOW + 1))
            piece = t[at : at + WINDOW]
            x[i, : len(piece)] = piece
            real[: len(piece), i] = True
        tf, tb = [], []
        f, b = net.states(x, "f", tf), net.states(x[:, ::-1], "b", tb)[::-1]
        p = f @ w["out"][:units] + b @ w["out"][units:] + w["bias"]
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        d = p
        d[:, np.arange(rows), y] -= 1
        d = d * (real[:, :, None] / _F(real.sum()))
        both = np.concatenate([f, b], axis=2).reshape(-1, 2 * units)
        grad = {"out": both.T @ d.reshape(-1, len(names)), "bias": d.sum(axis=(0, 1))}
        back = d @ w["out"].T
        _backward(net, "f", x, tf, back[:, :, :units], grad)
        _backward(net, "b", x[:, ::-1], tb, back[::-1, :, units:], grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            g = g * _F(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] = _F(0.9) * m[k] + _F(0.1) * g
            v[k] = _F(0.99) * v[k] + _F(0.01) * g * g
            w[k] -= _F(lr) * (m[k] / _F(1 - 0.9**step)) / (np.sqrt(v[k] / _F(1 - 0.99**step)) + _F(1e-8))
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean over all byte positions; zeros for empty texts."""
    out = np.zeros((len(texts), len(net.langs)))
    for a, b in chunks(texts, CHUNK):
        size = np.array([len(t) for t in texts[a:b]])
        count = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(count)])
        if not first[-1]:
            continue
        x = np.frombuffer(b"".join(t + bytes(n * WINDOW - len(t)) for t, n in zip(texts[a:b], count.tolist(), strict=True)), dtype=np.uint8).reshape(-1, WINDOW)
        total = np.zeros((len(x), len(net.langs)))
        for k in range(0, len(x), 4096):  # a very long text is read in blocks of windows too
            y = x[k : k + 4096]
            place = np.arange(k, k + len(y))
            doc = np.searchsorted(first, place, side="right") - 1
            left = np.minimum(size[doc] - (place - first[doc]) * WINDOW, WINDOW)
            p = net.probabilities(y)
            for c in range(p.shape[2]):
                s = p[:, :, c]
                s[np.arange(WINDOW)[:, None] >= left] = 0
                total[k : k + len(y), c] = s.sum(axis=0, dtype=np.float64)
        full = count > 0
        out[a:b][full] = np.add.reduceat(total, first[:-1][full], axis=0) / size[full, None]
    return out


def _label(batches, net: Network):
    for batch in batches:
        texts, letters = batch.column("bytes").to_pylist(), np.asarray(batch.column("letters").to_pylist(), dtype=bool)
        p = document_probabilities(net, [t if ok else b"" for t, ok in zip(texts, letters, strict=True)])
        best = p.argmax(axis=1)
        names = ["und" if not ok else net.langs[k] for k, ok in zip(best.tolist(), letters, strict=True)]
        score = np.where(letters, p[np.arange(len(p)), best], 0.0) if len(p) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["carried", "predicted", "score"])
        release_memory()


def fit(docs: DataFrame, *, sample_rows: int = 2000, seed: int = 3, **options) -> Network | None:
    """Learn from ``text`` and ``lang`` of rows that are not held out (crc32 of doc_id mod 4 is not 2).

    ``sample_rows`` bounds the rows: those with the least seeded hashes of doc_id, whole texts.  The hashes are
    cut at a bound taken from the row count first, so that tasks return about as many rows in all as are
    wanted, however large the table is.
    """
    key = F.col("doc_id").cast("string")
    draw = F.xxhash64(key, F.lit(seed)).alias("draw")
    known = docs.where("lang is not null and doc_id is not null").where(F.crc32(key) % 4 != 2)
    total = known.count()
    lettered = known.where(F.col("text").rlike(r"\p{L}"))
    share, least = 4 * sample_rows / max(total, 1), None
    while least is None:
        cut = lettered.where(draw < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else lettered
        draws = sorted(r["draw"] for r in cut.select(draw).orderBy("draw").limit(sample_rows).collect())
        if len(draws) == sample_rows or share >= 1:
            least = draws
        share *= 8
    if not least:
        return None
    rows = lettered.where(draw <= F.lit(least[-1])).select("doc_id", "lang", "text", draw).orderBy("draw", "doc_id", "text", "lang").limit(sample_rows).collect()
    net = train([r["text"].encode() for r in rows], [r["lang"] for r in rows], seed=seed, **options)
    release_memory()
    return net


def identify_languages(docs: DataFrame, net: Network | None, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` (columns of ``docs``) as a struct ``carried``, with the predicted language and its score, called ``names``."""
    carried = F.struct(*map(named, carry)).alias("carried")
    if net is None:
        return docs.select(carried, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(carried, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"), letters.alias("letters"))
    schema = StructType([rows.schema["carried"], StructField("predicted", StringType()), StructField("score", DoubleType())])
    out = rows.mapInArrow(partial(_label, net=net), schema)
    return out.select("carried", F.col("predicted").alias(names[0]), F.col("score").alias(names[1]))
