"""Cross-tokenizer alignment as Spark relations over distinct stretches of text.

Both tokenizers read a document as space and text.  Where a space follows anything but white space, neither joins
across: a byte-level pattern starts a new word there, and a piece vocabulary without a piece that
has a space after another character cannot reach over it (``cut_safe`` looks; other
vocabularies leave texts uncut).  So a document is a sequence of *stretches*, and each
distinct stretch is tokenized and aligned once for the whole corpus, weighted by how often it occurs.

The alignment is relational: tokens are exploded by position, a window gives each its end by cumulative length, tokens of
both sides meet on stretch and end (an equi-join, written as one grouping of both sides' rows, so that every step
shares one exchange), which finds the cuts, a running count of cuts names the groups, and a group's last
tokens are its link.  Links by overlap (``links="overlap"``) come from a range condition inside the groups.  An id pair's count is
the number of linked occurrences in the corpus; a B id's best count is the highest of its pairs.

Documents return by blocks: a block's distinct stretches, with their figures, meet the block's documents in one
task, which adds the figures up and joins the groups in order.  Blocks are dealt
to three runs, one after another, so that their exchanges need not be on disk together.  Texts are exchanged twice and
tokens never; a task holds one block of at most about 32 MB.

Defined results: null and empty texts have no tokens; a text of which a stretch does not come back byte for byte from both
tokenizers has none either, and counts for nothing; null doc_ids are kept; rows that repeat a document are aligned and
counted each; ids that tie for a B id's highest count are all best; an empty table gives no rows; extra columns are ignored.
A text without a space is one stretch, and a task holds its tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from binascii import hexlify
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, forget, group_count, release_memory, stored

#: Characters that some tokenizer may take as white space, as ranges of code points.
BLANK = "0-20 7F 85 A0 1680 180E 2000-200F 2028-202F 205F-2064 3000 FEFF"
_IN_CLASS = "".join("-".join(rf"\x{{{c}}}" for c in r.split("-")) for r in BLANK.split())
_IN_CLASS_PY = "".join("-".join(rf"\u{int(c, 16):04x}" for c in r.split("-")) for r in BLANK.split())
#: Before a space that follows a visible character and has one after its white space.
CUT = re.compile(rf"(?<=[^{_IN_CLASS_PY}])(?=\x20[{_IN_CLASS_PY}]*+[^{_IN_CLASS_PY}])")
#: A space at an end of the text or beside other white space: most texts have none, and need no look around each place.
UNEVEN = rf"^\x20|\x20[{_IN_CLASS}]|[{_IN_CLASS}]\x20|\x20\z"
#: A token is its size, side and id in one number: size << 33 | side << 32 | id.
TOKENS = "array<long>"
#: Documents return in so many runs, each over its share of the blocks: the exchanges of one are deleted before the next.
WAVES = 3
#: Counts of id pairs up to so many rows are broadcast.
BROADCAST = 1_000_000
#: Grouping of rows that are in order already goes without hashing.
SORTED = {"spark.sql.execution.replaceHashWithSortAgg": "true"}
#: Bytes of stretches that are tokenized in one call.
CHUNK = 1 << 14
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@dataclass(frozen=True)
class Tokenizers:
    """The files of a byte-level tokenizer (A) and of a piece model (B) that adds a space."""

    bytes_file: str
    pieces_file: str

    def open(self) -> tuple:
        import sentencepiece
        import tokenizers

        a = tokenizers.Tokenizer.from_file(self.bytes_file)
        a.encode_special_tokens = True
        return a, sentencepiece.SentencePieceProcessor(model_file=self.pieces_file)

    def cut_safe(self) -> bool:
        """Whether neither tokenizer joins a visible character with a space after it."""
        with open(self.bytes_file, encoding="utf-8") as f:
            before = json.load(f).get("pre_tokenizer") or {}
        b = self.open()[1]
        inside = any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(b.get_piece_size()))
        return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not inside


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(a, b) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id."""
    letters = byte_letters()
    names = [""] * a.get_vocab_size(with_added_tokens=True)
    for token, i in a.get_vocab(with_added_tokens=True).items():
        names[i] = token
    of_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
    spell = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, [spell(i) for i in range(b.get_piece_size())]


class Side:
    """One tokenizer over lists of stretches."""

    def __init__(self, encode, of: list[bytes]):
        self.encode, self.of, self.sizes = encode, of, np.array([len(x) for x in of], dtype=np.int32)

    def together(self, parts: list[bytes]) -> list[np.ndarray] | None:
        """The ids of each stretch from one call for all; None if that does not come back byte for byte, cut at the stretches' ends."""
        text = b"".join(parts)
        ids = np.array(self.encode(text.decode()[1:]), dtype=np.int32)
        if b"".join([self.of[i] for i in ids.tolist()]) != text:
            return None
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(p) for p in parts])
        cuts = np.searchsorted(ends, wanted) + 1
        return np.split(ids, cuts[:-1]) if np.array_equal(ends[cuts - 1], wanted) else None

    def alone(self, part: bytes) -> np.ndarray | None:
        found = self.together([part])
        return None if found is None else found[0]


def _tokens(batches, files: Tokenizers, cut: bool):
    a, b = files.open()
    of_a, of_b = vocabulary(a, b)
    sides = [Side(lambda t: a.encode(" " + t, add_special_tokens=False).ids, of_a), Side(b.encode, of_b)]
    none = np.zeros(0, dtype=np.int32)
    for batch in batches:
        parts = [(" " + t).encode() for t in batch.column("stretch").to_pylist()]
        found: list[list[np.ndarray]] = []
        for first, last in chunks(parts, CHUNK if cut else 1):
            both = [s.together(parts[first:last]) for s in sides]
            if None in both:  # some stretch does not come back, or ends in white space
                pairs = [[s.alone(p) for s in sides] for p in parts[first:last]]
                found += [[none, none] if x is None or y is None else [x, y] for x, y in pairs]
            else:
                found += [list(x) for x in zip(*both, strict=True)]
        flat = np.concatenate([x for pair in found for x in pair] or [none])
        n = np.array([[len(x), len(y)] for x, y in found], dtype=np.int64).reshape(-1, 2)
        side = np.repeat(np.tile(np.array([0, 1], dtype=np.int64), len(found)), n.reshape(-1))
        sizes = np.where(side == 0, sides[0].sizes[np.minimum(flat, len(of_a) - 1)], sides[1].sizes[np.minimum(flat, len(of_b) - 1)])
        tokens = pa.array(sizes.astype(np.int64) << 33 | side << 32 | flat)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n.sum(axis=1))]), pa.int32()), tokens)
        yield pa.RecordBatch.from_arrays([batch.column("stretch"), batch.column("n"), lists], names=["stretch", "n", "tokens"])


def _lists(texts: pa.Array | pa.ChunkedArray, cut: bool) -> pa.ListArray:
    """The stretches of space and text of every text, each without its first space; none of a null or empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    kind = pa.list_(pa.string())
    texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts)
    uneven = pc.match_substring_regex(texts, UNEVEN) if cut else pc.is_valid(texts)
    even = pc.split_pattern(pc.if_else(uneven, pa.scalar(None, pa.string()), texts), " ").cast(kind)
    if pc.any(uneven).as_py():
        parts = lambda t: [x[1:] for x in CUT.split(" " + t)] if cut else [t]
        found = pa.array([parts(t) if u else None for t, u in zip(texts.to_pylist(), uneven.to_pylist(), strict=True)], kind)
        even = pc.coalesce(even, found)
    return pc.coalesce(even, pa.scalar([], kind))


def packed(spelled: DataFrame) -> DataFrame:
    """Figures and groups in fewer bytes, for the exchange: two signs of the groups a byte, and differences that are mostly zero."""
    signs = F.translate("groups", ",|;", "abc")
    even = F.when(F.length(signs) % 2 == 1, F.concat(F.lit("f"), signs)).otherwise(signs)
    return spelled.select("stretch", "n_a", "n_b", "n_groups", (F.col("n_links") - F.col("n_groups")).alias("n_links"), (F.col("n_links") - F.col("n_best")).alias("n_best"), "count_sum", F.unhex(even).alias("groups"))


def _unpacked(known: pa.Table) -> tuple[list[np.ndarray], list[bytes]]:
    """Figures and groups of ``packed`` rows."""
    values = {name: known.column(name).to_numpy() for name in FIGURES}
    values["n_links"] = values["n_links"] + values["n_groups"]
    values["n_best"] = values["n_links"] - values["n_best"]
    signs = bytes.maketrans(b"abc", b",|;")
    return [values[name] for name in FIGURES], [hexlify(x).translate(signs, b"f") for x in known.column("groups").to_pylist()]


def _occurring(batches, cut: bool):
    """Each block's stretches of a batch and how often they occur."""
    for batch in batches:
        lists = _lists(batch.column("text"), cut)
        table = pa.table({"block": pc.take(batch.column("block"), pc.list_parent_indices(lists)), "stretch": pc.list_flatten(lists)})
        counted = table.group_by(["block", "stretch"]).aggregate([([], "count_all")])
        yield from counted.select(["block", "stretch", "count_all"]).rename_columns(["block", "stretch", "n"]).to_batches(max_chunksize=1 << 16)


def aligned_groups(encoded: DataFrame, starts: bool = False) -> DataFrame:
    """key, n, g, a, b (ids that end at the group's end), told (``a1,a2|b1``), n_a, n_b of every group of every stretch (key, n,
    tokens); with ``starts`` also the groups' tokens (end, start, id) in order.

    All steps are by stretch: after one exchange of the stretches' rows none needs another, and rows stay in order of stretch.
    """
    lists = encoded.select("key", "n", "tokens").repartition("key").sortWithinPartitions("key")
    rows = lists.select("key", "n", F.posexplode("tokens").alias("pos", "t")).select(
        "key", "n", "pos", F.shiftright("t", 32).bitwiseAND(1).cast("int").alias("side"), F.shiftright("t", 33).cast("int").alias("size"), F.col("t").bitwiseAND(0xFFFFFFFF).cast("int").alias("id"))
    end = F.sum("size").over(Window.partitionBy("key", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.select("key", "n", "side", "id", "size", end.alias("end")).sortWithinPartitions("key", "n", "end")
    of = lambda c, s: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True).alias(f"{c}_{s}")
    met = rows.groupBy("key", "n", "end").agg(*[of(c, s) for c in (["id", "size"] if starts else ["id"]) for s in (0, 1)])
    cut = F.col("id_0").isNotNull() & F.col("id_1").isNotNull()
    passed = F.sum(cut.cast("int")).over(Window.partitionBy("key", "n").orderBy("end").rowsBetween(Window.unboundedPreceding, 0))
    met = met.select("*", (passed - cut.cast("int")).cast("int").alias("g")).sortWithinPartitions("key", "n", "g")
    held = lambda s, *more: F.sort_array(F.collect_list(F.when(F.col(f"id_{s}").isNotNull(), F.struct("end", *more, F.col(f"id_{s}").alias("id")))))
    told = F.concat_ws("|", *[F.array_join(held(s)["id"].cast("array<string>"), ",") for s in (0, 1)]).alias("told")
    more = [held(s, (F.col("end") - F.col(f"size_{s}")).alias("start")).alias(f"tokens_{s}") for s in (0, 1)] if starts else []
    return met.groupBy("key", "n", "g").agg(
        F.max(F.when(cut, F.col("id_0"))).alias("a"), F.max(F.when(cut, F.col("id_1"))).alias("b"), told, F.count("id_0").alias("n_a"), F.count("id_1").alias("n_b"), *more).sortWithinPartitions("key", "n")


def align_stretches(encoded: DataFrame, links: str = "ends") -> tuple[DataFrame, DataFrame]:
    """Figures and groups of each stretch (key, n, tokens), and the counts of linked id pairs (a, b, count, best).

    ``links``: "ends" links tokens that end at the same byte, "overlap" those that share one.  The counts, which the vocabularies
    bound, are broadcast up to ``BROADCAST`` rows and exchanged beyond.
    """
    if links not in ("ends", "overlap"):
        raise ValueError(f"links: ends or overlap, not {links}")
    by_range = links == "overlap"
    groups = aligned_groups(encoded, by_range)
    item = F.struct("g", "told", "a", "b", *(["tokens_0", "tokens_1"] if by_range else []))
    grouped = groups.groupBy("key", "n").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sort_array(F.collect_list(item)).alias("x"))
    drawn = F.transform("x", lambda x: F.struct(x["tokens_0"].alias("p"), x["tokens_1"].alias("q"))) if by_range else F.transform("x", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    grouped = stored(grouped.select("key", "n", "n_a", "n_b", F.size("x").cast("long").alias("n_groups"), F.array_join(F.col("x")["told"], ";").alias("groups"), drawn.alias("links")), SORTED)
    linked = grouped.select("key", "n", F.explode("links").alias("x")).select("key", "n", "x.*")
    if by_range:
        pairs = linked.select("key", "n", "q", F.explode("p").alias("p")).select("key", "n", "p", F.explode("q").alias("q"))
        linked = pairs.where("p.start < q.end and q.start < p.end").select("key", "n", F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    counts = stored(linked.groupBy("a", "b").agg(F.sum("n").alias("count")))
    counts = stored(counts.join(counts.groupBy("b").agg(F.max("count").alias("best")), "b"))
    looked = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    figures = linked.join(looked, ["a", "b"]).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_links"), F.count(F.when(F.col("count") == F.col("best"), 1)).alias("n_best"), F.sum("count").alias("count_sum"))
    out = stored(encoded.select("key", "stretch").join(grouped.drop("n", "links"), "key").join(figures, "key").select("stretch", *FIGURES, "groups"))
    forget(grouped)
    return out, counts


def _in_order(batches, cut: bool):
    """Rows' stretches, one by one."""
    for batch in batches:
        lists = _lists(batch.column("text"), cut)
        table = pa.table({"row": pc.take(batch.column("row"), pc.list_parent_indices(lists)), "stretch": pc.list_flatten(lists)})
        yield from table.to_batches(max_chunksize=1 << 16)


def _assembled(docs: pa.Table, known: pa.Table, digest: bool, cut: bool) -> pa.Table:
    """A block's documents with the sums of their stretches' figures and their groups in order."""
    lists = _lists(docs.column("text"), cut)
    coded = pc.dictionary_encode(lists.flatten())
    place = pc.index_in(coded.dictionary, value_set=known.column("stretch").combine_chunks())
    of = pc.fill_null(place, len(known)).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    lost = np.concatenate([[0], np.cumsum(of == len(known))])[ends]
    whole = (np.diff(lost) == 0) & (np.diff(ends) > 0)  # all stretches came back from both tokenizers
    out = [docs.column("doc_id")]
    figures, names = _unpacked(known)
    for values in figures:
        total = np.concatenate([[0], np.cumsum(np.append(values, 0)[of])])[ends]
        out.append(pa.array(np.where(whole, np.diff(total), 0)))
    texts = (b";".join([names[i] for i in of[a:b].tolist()]) if w else b"" for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), whole.tolist(), strict=True))
    out.append(pa.array((hashlib.sha256(t).hexdigest() if t else "" for t in texts) if digest else (t.decode() for t in texts), pa.string()))
    table = pa.table(out, names=["doc_id", *FIGURES, "groups"])
    release_memory()
    return table


def align_documents(docs: DataFrame, files: Tokenizers, *, links: str = "ends", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2``; with ``digest``
    their SHA-256) of every row, and the counts of linked id pairs (a, b, count, best)."""
    cut, blocks = files.cut_safe(), group_count(docs, least=1)
    key = F.col("doc_id").cast("long")
    placed = docs.select(F.pmod(F.xxhash64(key, "text"), F.lit(blocks)).cast("int").alias("block"), key.alias("doc_id"), "text")
    rows = placed.repartition(blocks, "block")
    counted = rows.select("block", "text").mapInArrow(partial(_occurring, cut=cut), "block int, stretch string, n long")
    held = stored(counted.groupBy("block", "stretch").agg(F.sum("n").alias("n")))
    distinct = held.groupBy("stretch").agg(F.sum("n").alias("n"))
    encoded = stored(distinct.mapInArrow(partial(_tokens, files=files, cut=cut), f"stretch string, n long, tokens {TOKENS}").withColumn("key", F.monotonically_increasing_id()))
    broken = encoded.where(F.size("tokens") == 0).select("stretch")
    if broken.limit(1).count():  # what documents with such a stretch hold counts for nothing
        hit = held.join(broken, "stretch", "left_semi").select("block").distinct()
        in_blocks = rows.join(hit, "block", "left_semi").select(F.monotonically_increasing_id().alias("row"), "text")
        in_blocks = stored(in_blocks.mapInArrow(partial(_in_order, cut=cut), "row long, stretch string"))
        void = in_blocks.join(broken, "stretch", "left_semi").select("row").distinct()
        gone = in_blocks.join(void, "row", "left_semi").groupBy("stretch").agg(F.count(F.lit(1)).alias("gone"))
        encoded = stored(encoded.where(F.size("tokens") > 0).join(gone, "stretch", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone").where("n > 0"))
    spelled, counts = align_stretches(encoded, links)
    forget(encoded)
    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        return _assembled(left, right, digest, cut)

    fields = ", ".join(f"{c} long" for c in FIGURES)
    # stretches go to blocks by their hash: one that shares it comes along, and is not looked up
    code = F.xxhash64("stretch").alias("code")
    done = []
    for wave in range(WAVES):
        mine = F.pmod("block", F.lit(WAVES)) == wave
        by_block = held.where(mine).select("block", code).join(packed(spelled).select(code, "*"), "code").drop("code").groupBy("block")
        texts = placed.where(mine).repartition(blocks, "block")
        done.append(stored(texts.groupBy("block").cogroup(by_block).applyInArrow(assemble, f"doc_id long, {fields}, groups string")))
    forget(held, spelled)
    return reduce(DataFrame.union, done), counts
