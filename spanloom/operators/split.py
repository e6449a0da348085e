"""Folds: counts, iterative stratification, quotas, materialised folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ingest import with_row_index


def checked_ratios(ratios: list[float], prefixes: int | None = None) -> np.ndarray:
    folds = np.asarray(ratios, dtype=np.float32)
    if float(np.sum(folds)) != 1.0:
        raise ValueError("fold ratios must sum to 1")
    if prefixes is not None and prefixes != len(folds):
        raise ValueError("one prefix a fold is needed")
    return folds


def fold_counts(total: int, ratios: list[float]) -> list[int]:
    """Rounded up, then one off the largest fold until the sum is right."""
    if total < 0:
        raise ValueError("the total must not be negative")
    counts = [int(x) for x in np.ceil(checked_ratios(ratios) * np.float32(total))]
    while sum(counts) > total:
        counts[counts.index(max(counts))] -= 1
    return counts


def stratified(labels: np.ndarray, ratios: list[float], seed: int = 0) -> np.ndarray:
    """The fold of each sample by iterative stratification over multi-hot rows (Sechidis et al., 2011).

    The rarest label left is dealt first, its samples in index order, each to the fold that lacks most
    of that label, then to the one with most room; remaining ties are drawn. Samples without any
    label go last, to the fold with most room.
    """
    rng = np.random.default_rng(seed)
    hot = np.asarray(labels) != 0
    n, width = hot.shape
    room = np.array(fold_counts(n, ratios))
    left = hot.sum(axis=0)
    need = np.array([fold_counts(int(c), ratios) for c in left]).reshape(width, len(room)).T.copy()
    fold = np.full(n, -1)
    queues = [np.flatnonzero(hot[:, j]) for j in range(width)]

    def draw(options: np.ndarray) -> int:
        return int(options[0] if len(options) == 1 else rng.choice(options))

    def place(i: int, wish: np.ndarray) -> None:
        open_folds = np.flatnonzero(room > 0)
        best = open_folds[wish[open_folds] == wish[open_folds].max()]
        k = draw(best[room[best] == room[best].max()])
        fold[i] = k
        room[k] -= 1
        need[k, hot[i]] -= 1
        left[hot[i]] -= 1

    while (left > 0).any():
        j = draw(np.flatnonzero(left == left[left > 0].min()))
        for i in queues[j]:
            if fold[i] < 0:
                place(i, need[:, j])
    for i in np.flatnonzero(fold < 0):
        place(i, room)
    return fold


def exact_folds(samples: DataFrame, ratios: list[float], seed: int = 0) -> DataFrame:
    """(sample_idx, fold) by the sequential rule, in one task over indexes and labels only."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sample_idx")
        if len(rows):
            fold = stratified(np.array(rows["labels"].tolist()), ratios, seed)
            yield pd.DataFrame({"sample_idx": rows["sample_idx"].to_numpy(), "fold": fold})

    return samples.select("sample_idx", "labels").repartition(1).mapInPandas(deal, "sample_idx long, fold int")


def quota_folds(samples: DataFrame, ratios: list[float], key: str = "labels") -> DataFrame:
    """(sample_idx, fold) by quotas: each distinct label vector is dealt by the fold counts.

    Vectors are numbered by md5 of the index, so a fold takes an even share of each. Rows are numbered through by ranges
    and a vector's first number is taken off, so a vector that most samples share is no task of its own; the quotas, a row a
    distinct vector, stay a table.
    """
    folds = [float(x) for x in checked_ratios(ratios)]

    @F.pandas_udf("array<long>")
    def upper(counts: pd.Series) -> pd.Series:
        return counts.map(lambda n: np.cumsum(fold_counts(int(n), folds)).tolist())

    hashed = samples.select("sample_idx", key, F.md5(F.col("sample_idx").cast("string")).alias("_h"))
    numbered = with_row_index(hashed, [key, "_h", "sample_idx"], "_at")
    quotas = numbered.groupBy(key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("_upper", upper("_n"))
    fold = F.size(F.filter("_upper", lambda u: u <= F.col("_at") - F.col("_first")))
    return numbered.join(quotas, key).select("sample_idx", fold.alias("fold"))


def text_folds(samples: DataFrame, ratios: list[float], seed: int = 0) -> DataFrame:
    """(text_id, fold): all samples of a text in one fold, by the hash of its id."""
    upper = np.cumsum(checked_ratios(ratios)).tolist()[:-1]
    share = F.pmod(F.xxhash64("text_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    fold = F.size(F.filter(F.array(*map(F.lit, upper)), lambda u: u <= share)) if upper else F.lit(0)
    return samples.select("text_id").distinct().select("text_id", fold.alias("fold"))


def two_level(samples: DataFrame, ratios: list[float] = (0.9, 0.1), seed: int = 0, exact: bool = False) -> DataFrame:
    """(sample_idx, fold): train, validation and test by splitting twice."""
    deal = (lambda s: exact_folds(s, list(ratios), seed)) if exact else (lambda s: quota_folds(s, list(ratios)))
    first = deal(samples)
    rest = samples.join(first.where("fold = 0").select("sample_idx"), "sample_idx", "left_semi")
    second = deal(rest)
    return second.unionByName(first.where("fold > 0").select("sample_idx", F.lit(2).alias("fold")))


def materialised(samples: DataFrame, folds: DataFrame, order: str = "sample_idx") -> DataFrame:
    """Samples of each fold with windows renumbered by first appearance: (fold, sample_idx, enc_id, new_enc_id)."""
    rows = samples.select("sample_idx", "enc_id").join(folds, "sample_idx")
    firsts = with_row_index(rows.groupBy("fold", "enc_id").agg(F.min(order).alias("first")), ["fold", "first", "enc_id"], "_at")
    before = firsts.groupBy("fold").agg(F.min("_at").alias("_before"))
    new = firsts.join(before, "fold").select("fold", "enc_id", (F.col("_at") - F.col("_before")).alias("new_enc_id"))
    return rows.join(new, ["fold", "enc_id"])


def fold_windows(windows: DataFrame, samples: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """The windows that a fold's samples use, once each."""
    used = samples.join(folds.where(F.col("fold") == fold), "sample_idx").select("enc_id")
    return windows.join(used, "enc_id", "left_semi")
