"""Shared pieces of the corpus operators: lineage cuts, word and byte hashing, packed
exchanges and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these bytes (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
WORD_SPACE = r"[\x20\x09-\x0D]+"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage and cut its lineage there.

    The folder is the one named in ``spark.checkpoint.dir``; only a local session
    without that setting (tests on one machine) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: The exchanges of a run that wrote a table are deleted with its end: the table takes their place.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of one run."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Like ``materialize``, as a compressed table in the shared folder: for many rows or nested ones.

    ``more``: settings of the run that writes it.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with settings(df.sparkSession, FREED | (more or {})):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for f in t.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="corpusloom-")


def named(column: str) -> Column:
    """A column by its name as it stands, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(docs: DataFrame, group_bytes: int = 32 << 20, least: int = 2) -> int:
    """Groups to cut a table of texts into: ``least`` a shuffle partition, more if a group would pass ``group_bytes``.

    A task holds one group at a time, so its memory does not grow with the table.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # else Spark cannot tell
    return max(least * shuffle_partitions(docs.sparkSession), -(-size // group_bytes) if known else 0)


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers stay beside later stages' ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --------------------------------------------------------------------------- hashing

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    def powers(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=_U)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)

    return powers(base), powers(pow(base, -1, 1 << 64))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array (documents joined by a space)."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear hash of its bytes and length, mixed."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    size = ends - starts
    keys = stream64(int(size.max()) + 1, seed)
    word_of = np.zeros(len(data) + 1, dtype=np.int64)
    word_of[starts[1:]] = 1
    at = np.arange(len(data)) - starts[np.cumsum(word_of[:-1])]
    np.clip(at, 0, len(keys) - 1, out=at)
    value = (data.astype(_U) + _U(1)) * keys[at]
    value[SPACE[data]] = 0
    return mix64(np.add.reduceat(value, starts) + size.astype(_U) * keys[0])


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive values (uint64), mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = power_tables(len(values), base)
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up, out=total[1:])
    return mix64((total[width:] - total[:n]) * down[:n])


def _block_scan(x: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over every window of ``width`` values, by prefix and suffix scans of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    y = np.full(blocks * width, fill, dtype=x.dtype)
    y[: len(x)] = x
    y = y.reshape(blocks, width)
    head = op.accumulate(y, axis=1).reshape(-1)
    tail = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(tail[:n], head[width - 1 : width - 1 + n])


def window_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least hash of every window of ``width`` consecutive hashes."""
    if len(hashes) < width:
        return np.zeros(0, dtype=_U)
    return _block_scan(hashes, width, np.minimum, np.iinfo(_U).max)


def winnow(hashes: np.ndarray, least: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of some valid window (``least``: window_least).

    Which positions of a window are chosen depends on that window's hashes only, so equal
    windows have equal choices, and each valid window has at least one.
    """
    if not len(least):
        return np.zeros(0, dtype=np.int64)
    width = len(hashes) - len(least) + 1
    pad = np.zeros(width - 1, dtype=_U)
    most = _block_scan(np.concatenate([pad, np.where(valid, least, _U(0)), pad]), width, np.maximum, 0)
    return np.flatnonzero((most == hashes) & (most > 0))


def is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which x are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range (of ``ranges`` equal ones) of each hash; grows with the hash."""
    return ((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)


#: Stands for a null doc_id in packed columns.
NO_ID = -(1 << 63)


def group_of(key: Column, groups: int) -> Column:
    """The document group of a row, from its doc_id: for joins of whole texts with packed rows."""
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def with_groups(docs: DataFrame, groups: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(db, doc_id, text, carry): the group, the id (NO_ID if null), the text's UTF-8 bytes (null: empty), more columns."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(group_of(key, groups).alias("db"), key.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *[named(c).alias(f"_{c}") for c in carry])


def chunks(texts: list[bytes], size: int):
    """(first, last) ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def packed(columns: list[np.ndarray], cuts: np.ndarray) -> list[pa.Array]:
    """Each column cut at ``cuts`` (n + 1 places) into n binary values."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        out.append(pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()))
    return out


def unpacked(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def runs_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    if not len(ordered):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def span_sums(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean array of ``size``: which places some [start, end) covers."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


# --------------------------------------------------------------------------- components


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links (a, b).

    Hooking and shortcutting on label tables: each round, every node and the root of every node
    take the smallest label over a link, then labels jump to their label's label.  Rounds grow
    with the logarithm of the longest path in practice.  Each round's table is checkpointed;
    joins on hot labels or hot nodes read two plain exchanges, which AQE can split.
    """
    n, e = F.col("node"), links.select("a", "b").where("a <> b")
    edges = materialize(e.union(e.select("b", "a")).distinct())
    label = materialize(nodes.select(n, n.alias("label")).join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
    for _ in range(rounds):
        near = (
            edges.join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .where("lb < la")
        )
        offers = near.select(F.explode(F.array("a", "la")).alias("node"), F.col("lb").alias("label"))
        hooked = materialize(offers.unionByName(label).groupBy("node").agg(F.min("label").alias("label")))
        up = hooked.select(n.alias("label"), F.col("label").alias("top"))
        jumped = hooked.join(up, "label", "left").select("node", F.least("label", "top").alias("label"))
        new = materialize(jumped)
        changed = new.join(label.select("node", F.col("label").alias("was")), "node").where("label <> was").limit(1).count()
        label = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select("node", F.col("label").alias("component"))
