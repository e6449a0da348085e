"""Scores of windows, merged over overlaps, and the winning label of each head.

A scorer maps windows to rows (text_id, start_word, place, confs); anything with
``heads``, ``max_len`` and ``score`` serves. ``ArrowScorer`` runs a numpy function over
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.tokens import mean_vector


class Scorer(Protocol):
    heads: list[int]
    max_len: int

    def score(self, windows: DataFrame) -> DataFrame: ...


class ArrowScorer:
    """Scores windows (text_id, start_word, embeds) by ``forward``: (n, dim) vectors to (n, labels) confidences."""

    def __init__(self, forward: Callable[[np.ndarray], np.ndarray], heads: list[int], max_len: int = 1024):
        self.forward, self.heads, self.max_len = forward, heads, max_len

    def score(self, windows: DataFrame) -> DataFrame:
        forward, longest = self.forward, self.max_len

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                rows = []
                for text_id, start, embeds in zip(frame["text_id"], frame["start_word"], frame["embeds"]):
                    if len(embeds) > longest:
                        raise ValueError(f"a window of {len(embeds)} is longer than the model's {longest}")
                    if len(embeds):
                        confs = forward(np.stack(list(embeds)).astype(float))
                        rows += [(text_id, start, i, c.tolist()) for i, c in enumerate(confs)]
                yield pd.DataFrame(rows, columns=["text_id", "start_word", "place", "confs"])

        return windows.select("text_id", "start_word", "embeds").mapInPandas(
            run, "text_id long, start_word int, place int, confs array<double>"
        )


def head_softmax(logits: Column, heads: list[int]) -> Column:
    """Softmax within each head, concatenated."""

    def one(cut: Column) -> Column:
        top = F.array_max(cut)
        total = F.aggregate(cut, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.transform(cut, lambda x: F.exp(x - top) / total)

    starts = [sum(heads[:i]) for i in range(len(heads))]
    return F.concat(*[one(F.slice(logits, at + 1, n)) for at, n in zip(starts, heads)])


def winning_labels(confs: Column, heads: list[int]) -> Column:
    """The label of the largest confidence of each head; ties take the first."""
    found, at = [], 0
    for n in heads:
        cut = F.slice(confs, at + 1, n)
        found.append((F.array_position(cut, F.array_max(cut)) - 1 + at).cast("int"))
        at += n
    return F.array(*found)


def winning_hot(confs: Column, heads: list[int]) -> Column:
    """Winning labels as a multi-hot vector."""
    won = winning_labels(confs, heads)
    return F.transform(F.sequence(F.lit(0), F.lit(sum(heads) - 1)), lambda i: F.array_contains(won, i).cast("int"))


def merged_over_windows(scores: DataFrame, n_labels: int) -> DataFrame:
    """(text_id, word, confs): the mean over the windows that hold a word, aligned by word position."""
    word = (F.col("start_word") + F.col("place")).alias("word")
    return scores.select("text_id", word, "confs").groupBy("text_id", "word").agg(mean_vector("confs", n_labels).alias("confs"))


def in_long_form(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, conf) of vectors."""
    return vectors.select(*keys, F.posexplode("confs").alias("label", "conf"))


def predicted(scores: DataFrame, units: DataFrame, heads: list[int], unit: str = "word") -> DataFrame:
    """(text_id, unit, start, len, confs, labels) of words, or of tokens by ``pos``; texts without any give no rows."""
    vectors = merged_over_windows(scores, sum(heads)).withColumnRenamed("word", unit)
    return units.join(vectors, ["text_id", unit]).select(
        "text_id", unit, "start", (F.col("end") - F.col("start")).alias("len"), "confs", winning_labels(F.col("confs"), heads).alias("labels")
    )


def predicted_words(scores: DataFrame, spans: DataFrame, heads: list[int]) -> DataFrame:
    return predicted(scores, spans, heads)


def predicted_tokens(scores: DataFrame, tokens: DataFrame, heads: list[int]) -> DataFrame:
    """As for words: ``start_word`` and ``place`` of the scores count tokens."""
    return predicted(scores, tokens, heads, "pos")


def words_from_tokens(tokens: DataFrame, heads: list[int]) -> DataFrame:
    """Word predictions from token confidences: ``tokens`` has text_id, pos, word, start, end and confs."""
    found = tokens.groupBy("text_id", "word").agg(
        F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), mean_vector("confs", sum(heads)).alias("confs")
    )
    return found.select(
        "text_id", "word", "start", (F.col("end") - F.col("start")).alias("len"), "confs", winning_labels(F.col("confs"), heads).alias("labels")
    )


def evaluated(models: dict[int, Scorer], windows: DataFrame, samples: DataFrame) -> DataFrame:
    """The evaluation table: each window is scored once a model, then samples pick their place."""
    out = None
    for version, model in models.items():
        scores = model.score(windows)
        rows = samples.join(scores, (samples.text_id == scores.text_id) & (samples.start_word == scores.start_word) & (samples.target == scores.place))
        one = rows.select(
            F.lit(version).alias("model_version"),
            samples.sample_idx,
            samples.labels.cast("array<float>").alias("expected_labels"),
            winning_hot(F.col("confs"), model.heads).cast("array<float>").alias("found_labels"),
            F.col("confs").cast("array<float>").alias("confidence"),
        )
        out = one if out is None else out.unionByName(one)
    return out
