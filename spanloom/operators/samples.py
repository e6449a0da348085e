"""Labels of tokens and words, inside the row or by range join, and one multi-hot sample a word and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.corpus import ranges_meet
from spanloom.operators.tokens import SpaceTokenizer, Tokenizer, starts_of, words_of
from spanloom.schema import LabelSpace


def spans_of(texts: DataFrame) -> DataFrame:
    """(text_id, chunk_no, c_start, c_len, label) of texts with chunks."""
    return texts.select(F.col("id").alias("text_id"), F.posexplode("chunks").alias("chunk_no", "c")).select(
        "text_id", "chunk_no", F.col("c.start").alias("c_start"), F.col("c.len").alias("c_len"), F.col("c.label").alias("label")
    )


def unit_labels(units: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, chunk_no): labels of chunks that meet a token or word; units without any are kept with nulls.

    ``units`` has text_id, start, end (exclusive) and the keys. The join is on text_id, the range a condition
    beside it.
    """
    right = spans.withColumnRenamed("text_id", "_text_id")
    meets = ranges_meet(F.col("start"), F.col("end") - 1, F.col("c_start"), F.col("c_start") + F.col("c_len") - 1)
    joined = units.join(right, (F.col("text_id") == F.col("_text_id")) & meets, "left")
    return joined.groupBy(*keys, "label").agg(F.min("chunk_no").alias("chunk_no"))


def with_neutral(units: DataFrame, space: LabelSpace) -> Column:
    """Labels of special and empty tokens: each head's neutral label."""
    return F.array(*[F.lit(x) for x in space.neutral])


def label_lists(units: DataFrame, spans: DataFrame, keys: list[str], space: LabelSpace) -> DataFrame:
    """(keys, labels): distinct labels in chunk order; empty where none meets; neutral for special or empty units."""
    found = unit_labels(units, spans, keys).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("chunk_no", "label")))), lambda x: x.label).alias("labels")
    )
    skipped = (F.col("special") if "special" in units.columns else F.lit(False)) | (F.col("start") == F.col("end"))
    marks = units.select(*keys, skipped.alias("_skip"))
    return found.join(marks, keys).select(*keys, F.when(F.col("_skip"), with_neutral(units, space)).otherwise(F.col("labels")).alias("labels"))


def multi_hot(labels: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(labels, i).cast("int"))


def labels_in_row(unit: Column, chunks: Column, space: LabelSpace) -> Column:
    """Labels of a unit (start, end, special) by the chunks beside it: distinct, in chunk order; neutral for special or empty units."""
    meets = lambda c: ranges_meet(unit.start, unit.end - 1, c.start, c.start + c.len - 1)
    found = F.array_distinct(F.transform(F.filter(chunks, meets), lambda c: c.label))
    neutral = F.array(*[F.lit(x) for x in space.neutral])
    return F.when(unit.special | (unit.start == unit.end), neutral).otherwise(found)


def _samples(units: DataFrame, space: LabelSpace, size: int, overlap: float, covering: bool) -> DataFrame:
    """``units`` has text_id, units and chunks; a unit in an overlap gives one sample a window."""
    rows = units.select("text_id", "chunks", "units", F.size("units").alias("n")).select("text_id", "chunks", "n", F.posexplode_outer("units").alias("place", "unit"))
    rows = rows.where("unit IS NOT NULL")
    hot = multi_hot(labels_in_row(F.col("unit"), F.col("chunks"), space), space.size)
    starts = starts_of(F.col("place"), F.col("n"), size, overlap, covering)
    found = rows.select("text_id", "place", hot.alias("labels"), starts.alias("starts")).select("text_id", "place", "labels", F.explode("starts").alias("start_word"))
    return found.select("text_id", "start_word", (F.col("place") - F.col("start_word")).cast("int").alias("target"), "labels")


def _tokenised(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """text_id, chunks and tokens of texts (id, text, chunks)."""
    rows = texts.select(F.col("id").alias("text_id"), "text", "chunks")
    if isinstance(tokenizer, SpaceTokenizer):
        return rows.select("text_id", "chunks", tokenizer.tokens(F.col("text")).alias("tokens"))
    return tokenizer.tokenised(rows).join(rows.select("text_id", "chunks"), "text_id")


def token_samples(texts: DataFrame, space: LabelSpace, size: int, overlap: float = 1 / 3, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(text_id, start_word, target, labels) by token: windows over token positions, none after one that reaches the end."""
    units = _tokenised(texts, tokenizer or SpaceTokenizer()).withColumnRenamed("tokens", "units")
    return _samples(units, space, size, overlap, covering=True)


def word_samples(texts: DataFrame, space: LabelSpace, size: int, overlap: float = 1 / 3, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(text_id, start_word, target, labels) of texts (id, text, chunks); an empty text gives none."""
    tokenizer = tokenizer or SpaceTokenizer()
    units = _tokenised(texts, tokenizer).select("text_id", "chunks", words_of(F.col("tokens"), tokenizer.mark).alias("units"))
    return _samples(units, space, size, overlap, covering=False)


def label_counts(labels: DataFrame, size: int) -> DataFrame:
    """How often each of ``size`` labels is set in multi-hot vectors, in one pass."""
    sums = labels.agg(F.array(*[F.coalesce(F.sum(F.get("labels", F.lit(i)).cast("long")), F.lit(0)) for i in range(size)]).alias("sums"))
    return sums.select(F.posexplode("sums").alias("label", "n"))
