"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Sources get targets by weight (with a ceiling of ``max_repeats`` times their size, the
excess reshared), then integer block quotas by highest quotients; each source's quota is
apportioned over its shards the same way.  A shard's documents stand in seeded order on a
ring of tokens; its quota is whole rounds of the ring plus an arc of blocks from a seeded
block on.  Only sums by source and by (source, shard) and one window inside a shard are
needed, so a hot source spreads over its shards.

Defined results: a null text or a text without words has size 0 and takes 0; a null source is
a source of its own, last in order; repeated rows are separate documents; an empty table gives
an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def quota_by_quotients(df: DataFrame, by: list[str], key: list[str], value: str, seats: Column) -> DataFrame:
    """Sainte-Lague: rows of ``df`` (unique ``by`` + ``key``) with the column ``quota``.

    Seats go to the highest quotients value / (2k - 1).  Seats that are certain are given at once:
    a row's quota differs from its exact share by less than half its share of the row
    count plus 2, so only quotients in that margin are listed and ranked.
    """
    w = Window.partitionBy(*by)
    share = F.when(F.col("_all") > 0, F.col(value) / F.col("_all")).otherwise(F.lit(0.0))
    df = df.withColumns({"_all": F.sum(value).over(w), "_n": F.count(F.lit(1)).over(w), "_seats": seats})
    df = df.withColumn("_slack", (F.ceil(share * F.col("_n") / 2) + 2).cast("long")).withColumn("_exact", F.floor(share * F.col("_seats")).cast("long"))
    df = df.withColumn("_base", F.greatest(F.lit(0), F.col("_exact") - F.col("_slack")))
    df = df.withColumn("_left", F.col("_seats") - F.sum("_base").over(w))
    listed = df.select("*", F.explode(F.sequence(F.col("_base") + 1, F.col("_exact") + F.col("_slack") + 1)).alias("_k"))
    order = Window.partitionBy(*by).orderBy(F.desc("_q"), *[F.col(k).asc_nulls_last() for k in key], "_k")
    ranked = listed.withColumn("_q", F.col(value) / (2 * F.col("_k") - 1)).withColumn("_rank", F.row_number().over(order))
    won = (F.col("_rank") <= F.col("_left")) & (F.col(value) > 0)
    keep = [c for c in df.columns if not c.startswith("_")]
    return ranked.groupBy(*keep, "_base").agg(F.count_if(won).alias("_won")).select(*keep, (F.col("_base") + F.col("_won")).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float) -> DataFrame:
    """(source, source_size, target): water filling of ``share`` times all tokens by weight."""
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_room = Window.partitionBy(F.lit(0)).orderBy("room", "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("place", F.row_number().over(rank)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    t = t.withColumn("room", max_repeats * F.col("source_size") / F.col("weight"))
    t = t.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(max_repeats * F.sum("source_size").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_level = F.min_by("level", F.when(F.col("room") > F.col("level"), F.struct("room", "place"))).over(whole)
    t = t.withColumn("level", F.coalesce(open_level, F.max("room").over(whole)))
    return t.select("source", "source_size", F.least(max_repeats * F.col("source_size"), F.col("level") * F.col("weight")).cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_repeats: int = 2,
    block_tokens: int = 4,
    shards: int = 32,
    shard_rows: int = 200_000,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of the document's tokens in the mix, repeats counted: at most
    ``max_repeats`` times its size.  A source has ``shards`` shards, or more where they would hold over ``shard_rows`` rows.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw"))
    sizes = materialize(sizes)
    dealt = sizes.groupBy(F.col("source").alias("s2")).agg(F.greatest(F.lit(shards), F.ceil(F.count(F.lit(1)) / shard_rows)).alias("shards"))
    shard = F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("shards"))
    sizes = sizes.join(materialize(dealt), F.col("source").eqNullSafe(F.col("s2"))).select("doc_id", "source", "size", "draw", shard.alias("shard"))

    total = Window.partitionBy(F.lit(0))
    targets = source_targets(sizes, weights, share, max_repeats)
    targets = targets.withColumn("seats", F.round(F.sum("target").over(total) / block_tokens).cast("long"))
    quotas = quota_by_quotients(targets, ["seats"], ["source"], "target", F.col("seats"))
    cells = sizes.groupBy("source", "shard").agg(F.sum("size").alias("ring"))
    cells = cells.join(quotas.select(F.col("source").alias("s2"), "source_size", "target", F.col("quota").alias("blocks")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    cells = quota_by_quotients(cells, ["source"], ["shard"], "ring", F.col("blocks"))
    most, ring = max_repeats * F.col("ring"), F.col("ring")
    take = F.when(F.col("target") >= max_repeats * F.col("source_size"), most).otherwise(F.least(F.col("quota") * block_tokens, most))
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")), F.lit("|"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    cells = cells.withColumn("take", take).withColumns({
        "rounds": F.when(ring > 0, F.floor(F.col("take") / ring)).otherwise(0).cast("long"),
        "start": F.when(ring > 0, F.pmod(first * block_tokens, ring)).otherwise(0),
    }).withColumn("arc", F.col("take") - F.col("rounds") * ring)
    cells = materialize(cells.select(F.col("source").alias("s2"), F.col("shard").alias("h2"), "source_size", "target", "ring", "rounds", "start", "arc"))

    w = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size")
    placed = sizes.withColumn("b", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("size"))
    placed = placed.join(cells, (F.col("shard") == F.col("h2")) & F.col("source").eqNullSafe(F.col("s2")))
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("b"), hi) - F.greatest(F.col("a"), lo))
    end = F.col("start") + F.col("arc")
    taken = F.col("rounds") * F.col("size") + over(F.col("start"), end) + over(F.col("start") - ring, end - ring)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as its taken tokens fill it (rounded); columns as in ``docs``.

    Where ``doc_id`` repeats, rows are matched by id, source and size and keep their number.
    """
    key = ["doc_id", "source", "size"]
    mix = mix_sources(docs, **options).groupBy(*[F.col(k).alias(f"m_{k}") for k in key]).agg(F.round(F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))).cast("int").alias("copies"))
    mix = materialize(mix.where("copies > 0"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.struct("*").alias("row"))
    match = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size"))
    return rows.join(mix, match).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
