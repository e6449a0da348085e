"""Chunked texts: labelled ranges of code points, mixed texts, interval complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.schema import LabelSpace


def whole_text_chunks(rows: DataFrame, space: LabelSpace, id_col: str = "id") -> DataFrame:
    """One chunk a head over the whole text, labelled by (head, level)."""
    chunks = [
        F.struct(F.lit(0).alias("start"), F.length("text").alias("len"), space.label(h, F.col(h)).alias("label")) for h in space.heads
    ]
    return rows.select(F.col(id_col).alias("id"), "text", F.array(*chunks).alias("chunks"))


def is_neutral(chunks: Column, space: LabelSpace) -> Column:
    """Whether the set of labels is exactly that of the heads' neutral labels."""
    found = F.array_sort(F.array_distinct(F.transform(chunks, lambda c: c.label)))
    return found == F.array(*[F.lit(x) for x in sorted(space.neutral)])


def next_id(texts: DataFrame) -> DataFrame:
    return texts.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("next_id"))


def intersects(a_start: Column, a_len: Column, b_start: Column, b_len: Column) -> Column:
    """Closed ranges; a length of 0 counts as 1."""
    last = lambda s, n: s + F.greatest(F.lit(0), n - 1)
    return (a_start <= last(b_start, b_len)) & (b_start <= last(a_start, a_len))


def ranges_meet(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Either range has an end inside the other, ends included; lengths of 0 end before they start."""
    return (
        a_first.between(b_first, b_last) | a_last.between(b_first, b_last) | b_first.between(a_first, a_last) | b_last.between(a_first, a_last)
    )


def complement(taken: DataFrame, lengths: DataFrame, key: str = "id") -> DataFrame:
    """(key, start, len): the maximal runs of 0 .. n-1 that no range (start, len) takes out."""
    clipped = (
        taken.select(key, "start", "len")
        .join(lengths.select(key, "n"), key)
        .select(key, F.greatest("start", F.lit(0)).alias("s"), F.least(F.col("start") + F.col("len"), "n").alias("e"))
        .where("s < e")
    )
    ends = lengths.select(key, F.col("n").alias("s"), F.col("n").alias("e"))
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = clipped.unionByName(ends).withColumn("from", F.coalesce(F.max("e").over(before), F.lit(0)))
    return covered.where("s > from").select(key, F.col("from").alias("start"), (F.col("s") - F.col("from")).alias("len"))


def concatenated(parts: DataFrame, key: str = "mix_id", order: str = "part") -> DataFrame:
    """(key, text, chunks): parts joined by a space, chunks moved along; the space is in no chunk.

    ``parts`` has key, order, text and chunks. No space precedes a part while the text is still empty.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text")
    shown = F.coalesce(F.max((length > 0).cast("int")).over(w), F.lit(0)) == 1
    placed = parts.withColumn("_lead", shown.cast("int"))
    placed = placed.withColumn("_at", F.coalesce(F.sum(F.length("text") + F.col("_lead")).over(w), F.lit(0)) + F.col("_lead"))
    moved = F.transform("chunks", lambda c: F.struct((c.start + F.col("_at")).cast("int").alias("start"), c.len.alias("len"), c.label.alias("label")))
    piece = F.struct(order, F.concat(F.when(F.col("_lead") == 1, " ").otherwise(""), "text").alias("t"), moved.alias("c"))
    grouped = placed.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return grouped.select(
        key,
        F.concat_ws("", F.transform("p", lambda x: x.t)).alias("text"),
        F.flatten(F.transform("p", lambda x: x.c)).alias("chunks"),
    )


def _draw(*keys) -> Column:
    """A number in 0 .. 2^32-1 from the md5 of the keys: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


MIX_BLOCK = 4096


def mix_plan(spark, n_loaded: int, n_neutral: int, n_mixes: int, seed: int = 0, fewest: int = 3, most: int = 4) -> DataFrame:
    """(mix_id, part, loaded, pool_row): which row of which pool each part of a mixed text takes.

    Parts come from either pool by a fair draw; a mix of one pool only has its last part turned
    over to the other. The k-th draw from a pool takes row k, turned by a draw for each round
    through the pool, so a pool is used up before a row comes again. k is numbered by blocks of mixes.
    """
    if not n_loaded or not n_neutral:
        raise ValueError("both pools need at least one text")
    size = (_draw(F.lit(seed), F.lit("size"), F.col("mix_id")) % (most - fewest + 1) + fewest).cast("int")
    mixes = spark.range(n_mixes).select(F.col("id").alias("mix_id")).withColumn("size", size)
    coin = lambda part: (_draw(F.lit(seed), F.lit("pool"), F.col("mix_id"), part) % 2).cast("int")
    mixes = mixes.withColumn("coins", F.transform(F.sequence(F.lit(0), F.col("size") - 1), coin))
    whole = F.aggregate("coins", F.lit(0), lambda a, x: a + x)
    parts = mixes.select("mix_id", "size", whole.alias("whole"), F.posexplode("coins").alias("part", "coin"))
    turned = F.when((F.col("part") == F.col("size") - 1) & ((F.col("whole") == 0) | (F.col("whole") == F.col("size"))), 1 - F.col("coin"))
    parts = parts.withColumn("loaded", F.coalesce(turned, F.col("coin"))).withColumn("block", F.floor(F.col("mix_id") / MIX_BLOCK))
    blocks = parts.groupBy("loaded", "block").count()
    earlier = Window.partitionBy("loaded").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("loaded", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("loaded", "block").orderBy("mix_id", "part")) - 1
    numbered = parts.withColumn("k", within).join(blocks, ["loaded", "block"]).withColumn("k", F.col("k") + F.col("shift"))
    n = F.when(F.col("loaded") == 1, F.lit(n_loaded)).otherwise(F.lit(n_neutral))
    lap = F.floor(F.col("k") / n)
    return numbered.select(
        "mix_id", "part", "loaded", ((F.col("k") + _draw(F.lit(seed), F.lit("round"), F.col("loaded"), lap)) % n).cast("long").alias("pool_row")
    )


def exact_mix_plan(loaded: list[int], neutral: list[int], n_mixes: int, seed: int = 0, fewest: int = 3, most: int = 4) -> list[tuple[int, int, int]]:
    """(mix_id, part, id) by the sequential rule: draws without replacement from refilled pools.

    Mixes of one pool only are drawn again with the pools put back. Ids only, on the driver.
    """
    from random import Random

    if not loaded or not neutral:
        raise ValueError("both pools need at least one text")
    rng, plan = Random(seed), []
    pools = {True: list(loaded), False: list(neutral)}
    while n_mixes > 0:
        size = rng.choice(range(fewest, most + 1))
        saved = {k: list(v) for k, v in pools.items()}
        mix, kinds = [], set()
        for _ in range(size):
            kind = rng.choice([True, False])
            chosen = rng.choice(pools[kind])
            pools[kind].remove(chosen)
            mix.append(chosen)
            kinds.add(kind)
            if not pools[kind]:
                pools[kind] = list(loaded if kind else neutral)
        if len(kinds) < 2:
            pools = saved
            continue
        at = plan[-1][0] + 1 if plan else 0
        plan += [(at, part, chosen) for part, chosen in enumerate(mix)]
        n_mixes -= 1
    return plan
