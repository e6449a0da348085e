"""Integrated gradients by window, merged into one influence table a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_softmax(weights: np.ndarray, heads: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer of words by the mean of the window and their own vector."""

    def forward(x: np.ndarray) -> np.ndarray:
        logits = (x + x.mean(axis=0)) @ weights
        parts = np.split(logits, np.cumsum(heads)[:-1], axis=1)
        return np.hstack([np.exp(p - p.max(1, keepdims=True)) / np.exp(p - p.max(1, keepdims=True)).sum(1, keepdims=True) for p in parts])

    return forward


def integrated_gradients(x: np.ndarray, weights: np.ndarray, heads: list[int], head: int, steps: int = 100) -> np.ndarray:
    """(out word, in word) influence on the winning label of ``head``, from a zero baseline.

    The gradient of ``linear_softmax`` is known in closed form; it is averaged at the middle of each step,
    times the input, over the embedding's components.
    """
    n, dim = x.shape
    first = sum(heads[:head])
    cut = slice(first, first + heads[head])
    forward = linear_softmax(weights, heads)
    won = forward(x)[:, cut].argmax(axis=1)
    w = weights[:, cut]
    total = np.zeros((n, n, dim))
    for t in (np.arange(steps) + 0.5) / steps:
        p = forward(t * x)[:, cut]
        chosen = p[np.arange(n), won]
        slope = chosen[:, None] * (w[:, won].T - p @ w.T)
        total += slope[:, None, :] / n
        total[np.arange(n), np.arange(n)] += slope
    return (total / steps * x[None, :, :]).mean(axis=2)


Forward = Callable[[np.ndarray], np.ndarray]


def gradients_by_difference(x: np.ndarray, forward: Forward, heads: list[int], head: int, steps: int = 100, nudge: float = 1e-4) -> np.ndarray:
    """As ``integrated_gradients``, for any scorer (n, dim) -> (n, labels).

    A word's gradient times its own vector is the slope of the scores as that vector grows, and is had from two calls a
    word and step.
    """
    n, dim = x.shape
    first = sum(heads[:head])
    cut = slice(first, first + heads[head])
    won = forward(x)[:, cut].argmax(axis=1)
    total = np.zeros((n, n))
    for t in (np.arange(steps) + 0.5) / steps:
        for i in range(n):
            up, down = t * x, t * x
            up[i] += nudge * x[i]
            down[i] -= nudge * x[i]
            slope = (forward(up)[:, cut] - forward(down)[:, cut]) / (2 * nudge)
            total[:, i] += slope[np.arange(n), won]
    return total / steps / dim


def explained(windows: DataFrame, scorer: np.ndarray | Forward, heads: list[int], steps: int = 100) -> DataFrame:
    """(text_id, start_word, head, out_pos, in_pos, influence) of windows (text_id, start_word, embeds).

    ``scorer`` is any function of a window's vectors, or the weights of ``linear_softmax``, whose gradient is known.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for text_id, start, embeds in zip(frame["text_id"], frame["start_word"], frame["embeds"]):
                if not len(embeds):
                    continue
                x = np.stack(list(embeds)).astype(float)
                for head in range(len(heads)):
                    known = isinstance(scorer, np.ndarray)
                    found = integrated_gradients(x, scorer, heads, head, steps) if known else gradients_by_difference(x, scorer, heads, head, steps)
                    out, inn = np.indices(found.shape).reshape(2, -1)
                    yield pd.DataFrame({"text_id": text_id, "start_word": start, "head": head, "out_pos": start + out, "in_pos": start + inn, "influence": found.ravel()})

    return windows.select("text_id", "start_word", "embeds").mapInPandas(
        run, "text_id long, start_word int, head int, out_pos int, in_pos int, influence double"
    )


def merged_influence(parts: DataFrame, normalise: bool = False, tiny: float = 1e-12) -> DataFrame:
    """(text_id, head, out_pos, in_pos, influence): the mean over windows; pairs in no common window are absent.

    Normalised, each word's row is divided by its largest absolute value, unless that is tiny.
    """
    merged = parts.groupBy("text_id", "head", "out_pos", "in_pos").agg(F.avg("influence").alias("influence"))
    if not normalise:
        return merged
    most = F.max(F.abs("influence")).over(Window.partitionBy("text_id", "head", "out_pos"))
    scaled = merged.withColumn("_most", most)
    return scaled.withColumn("influence", F.col("influence") / F.when(F.col("_most") < tiny, 1.0).otherwise(F.col("_most"))).drop("_most")


def convergence(influences: DataFrame) -> DataFrame:
    """Per step count: largest, smallest, median (the lower middle) and mean change in percent from the step count before.

    ``influences`` has steps, text_id, head, out_pos, in_pos and influence.
    """
    w = Window.partitionBy("text_id", "head", "out_pos", "in_pos").orderBy("steps")
    before = F.lag("influence").over(w)
    change = F.abs(F.try_divide(F.col("influence") - before, before)) * 100
    rows = influences.withColumn("change", change).where(F.col("change").isNotNull())
    return rows.groupBy("steps").agg(
        F.max("change").alias("max_change"),
        F.min("change").alias("min_change"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY change)").alias("median_change"),
        F.avg("change").alias("mean_change"),
    )
