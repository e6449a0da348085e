"""Merging duplicates with an auditable conflict log.

Texts are equal if they are when lower-cased. Only a digest of the text, the row's
number and its levels are shuffled, and both results come from aggregates, so a
text with very many copies is combined before it meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVEL = 4


def folded_key(text: Column) -> Column:
    return F.sha2(F.lower(text), 256)


def dedup_merged(rows: DataFrame, levels: list[str], order: str = "row_idx") -> DataFrame:
    """The first row of each text, with its own spelling and the largest levels of the group."""
    keyed = rows.select(F.col(order), folded_key(F.col("text")).alias("_key"), *levels)
    merged = keyed.groupBy("_key").agg(F.min(order).alias(order), *[F.max(c).alias(c) for c in levels])
    return rows.select(order, "text").join(merged.drop("_key"), order)


def conflicts(rows: DataFrame, levels: list[str], order: str = "row_idx", max_level: int = MAX_LEVEL) -> DataFrame:
    """survivor_idx, dupe_idx, primary_* and dupe_* levels, text of the survivor.

    A duplicate conflicts if, for some level column, both the largest level before it and its
    own are not 0. The largest level before a row is the highest level whose first
    appearance in the group is earlier, so first appearances by level are all that is gathered.
    """
    keyed = rows.select(F.col(order), folded_key(F.col("text")).alias("_key"), *levels)
    firsts = [
        F.min(F.when(F.col(c) >= k, F.col(order))).alias(f"_{c}_{k}") for c in levels for k in range(1, max_level + 1)
    ]
    groups = keyed.groupBy("_key").agg(F.min(order).alias("survivor_idx"), F.count(F.lit(1)).alias("_n"), *firsts).where("_n > 1")

    def before(c: str) -> Column:
        found = F.lit(0)
        for k in range(1, max_level + 1):
            found = F.when(F.col(f"_{c}_{k}") < F.col(order), k).otherwise(found)
        return found

    dupes = keyed.join(groups, "_key").where(F.col(order) != F.col("survivor_idx"))
    dupes = dupes.select(
        "survivor_idx",
        F.col(order).alias("dupe_idx"),
        *[before(c).alias(f"primary_{c}") for c in levels],
        *[F.col(c).alias(f"dupe_{c}") for c in levels],
    )
    clash = F.lit(False)
    for c in levels:
        clash = clash | ((F.col(f"primary_{c}") != 0) & (F.col(f"dupe_{c}") != 0))
    texts = rows.select(F.col(order).alias("survivor_idx"), "text")
    return dupes.where(clash).join(texts, "survivor_idx")
