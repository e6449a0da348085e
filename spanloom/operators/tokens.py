"""Tokens, words, windows and word vectors.

A tokenizer makes, for each text, an array of tokens (pos, id, piece, start, end, special); ``SpaceTokenizer`` works
on built-in functions, ``FileTokenizer`` runs a tokenizer file over Arrow batches. Words are marked and measured inside the
row, so a text is never spread over rows and gathered again. Offsets are code points; an empty or null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "▁"
TOKEN = "struct<pos:int,id:int,piece:string,start:int,end:int,special:boolean>"
_BLOCK = 256


class Tokenizer(Protocol):
    """``tokenised`` turns (text_id, text) into (text_id, tokens); no special tokens are added. ``mark`` begins a word's first piece."""

    mark: str

    def tokenised(self, texts: DataFrame) -> DataFrame: ...


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """Sums of the values before each place. Blocks are summed apart, so a long array takes no quadratic time."""

    def block_sums(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(block, start, lambda a, x: F.struct((a.total + x).alias("total"), F.concat(a.sums, F.array(a.total)).alias("sums")))

    def shifted(blocks: Column) -> Column:
        return _let(block_sums(F.transform(blocks, lambda b: b.total)).sums, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(b.sums, lambda x: x + F.get(base, i)))))

    def cut(v: Column) -> Column:
        firsts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return _let(F.transform(firsts, lambda at: block_sums(F.slice(v, at, F.lit(_BLOCK)))), shifted)

    return _let(values, cut)


@dataclass(frozen=True)
class SpaceTokenizer:
    """Pieces between single spaces, of ``width`` code points at most if given; the first piece of a word carries the mark."""

    width: int | None = None
    mark: str = MARK

    def tokens(self, text: Column) -> Column:
        def pieces(word: Column, start: Column) -> Column:
            size = F.length(word)
            starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(self.width)) if self.width else F.array(F.lit(0))
            cut = lambda k: F.substr(word, k + 1, F.lit(self.width)) if self.width else word
            return F.transform(
                starts,
                lambda k: F.struct(
                    F.when(k == 0, F.concat(F.lit(self.mark), cut(k))).otherwise(cut(k)).alias("piece"),
                    (start + k).cast("int").alias("start"),
                    (start + F.least(size, k + self.width) if self.width else start + size).cast("int").alias("end"),
                ),
            )

        def numbered(p: Column, i: Column) -> Column:
            return F.struct(i.alias("pos"), F.lit(None).cast("int").alias("id"), p.piece.alias("piece"), p.start.alias("start"), p.end.alias("end"), F.lit(False).alias("special"))

        def placed(words: Column) -> Column:
            starts = running(F.transform(words, lambda w: (F.length(w) + 1).cast("long")))
            return _let(starts, lambda at: F.transform(F.flatten(F.transform(words, lambda w, i: pieces(w, F.get(at, i)))), numbered))

        found = _let(F.split(text, " "), placed)
        return F.when(F.length(text) > 0, found).otherwise(F.array().cast(f"array<{TOKEN}>"))

    def tokenised(self, texts: DataFrame) -> DataFrame:
        return texts.select("text_id", self.tokens(F.col("text")).alias("tokens"))


@dataclass(frozen=True)
class FileTokenizer:
    """A tokenizer file of the ``tokenizers`` library, over Arrow batches; offsets and the special mask are the library's.

    ``unk`` names a token that counts as ordinary although it is marked special; ``mark`` is what the file's pieces begin a word with.
    """

    path: str
    mark: str = MARK
    unk: str | None = None

    def tokenised(self, texts: DataFrame) -> DataFrame:
        path, unk = self.path, self.unk

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from tokenizers import Tokenizer as Library

            library = Library.from_file(path)
            unk_id = library.token_to_id(unk) if unk is not None else None
            added = {i for i, t in library.get_added_tokens_decoder().items() if t.special}
            for frame in batches:
                rows = []
                for text in frame["text"]:
                    found = library.encode(text or "", add_special_tokens=False)
                    rows.append(
                        [
                            {"pos": k, "id": i, "piece": p, "start": a, "end": b, "special": (i in added and i != unk_id) or a == b}
                            for k, (i, p, (a, b)) in enumerate(zip(found.ids, found.tokens, found.offsets))
                        ]
                    )
                yield pd.DataFrame({"text_id": frame["text_id"], "tokens": rows})

        return texts.select("text_id", "text").mapInPandas(run, f"text_id long, tokens array<{TOKEN}>")


def spread(df: DataFrame, keep: list[str], array: str, first: str) -> DataFrame:
    """One row a struct of an array column, with the columns ``keep``; ``first`` is a field that is never null.

    The outer form stays free of a filter on the array's size, which would be pushed below and make the array again for each element.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(first).isNotNull())


def space_tokens(texts: DataFrame, width: int | None = None) -> DataFrame:
    """The tokens of ``SpaceTokenizer``, one a row."""
    return token_rows(SpaceTokenizer(width).tokenised(texts))


def token_rows(tokenised: DataFrame) -> DataFrame:
    return spread(tokenised, ["text_id"], "tokens", "pos")


def word_numbers(tokens: Column, mark: str = MARK) -> Column:
    """The word of each token: a new one starts at, and after, a special token and at a marked piece."""

    def starts(t: Column, i: Column) -> Column:
        new = (i > 0) & (t.special | F.get(tokens, i - 1).special | F.startswith(t.piece, F.lit(mark)))
        return new.cast("long")

    return _let(F.transform(tokens, starts), lambda new: F.zip_with(running(new), new, lambda before, x: (before + x).cast("int")))


def words_of(tokens: Column, mark: str = MARK) -> Column:
    """(word, start, end, n_tokens, special) of each word; the end is exclusive."""

    def spans(numbers: Column) -> Column:
        n = F.size(tokens)
        place = F.filter(F.transform(numbers, lambda w, i: F.when(F.coalesce(F.get(numbers, i - 1) != w, F.lit(True)), i)), lambda i: i.isNotNull())

        def span(at: Column) -> Column:
            def one(first: Column, w: Column) -> Column:
                after = F.coalesce(F.get(at, w + 1), n)
                return F.struct(
                    w.alias("word"), F.get(tokens, first).start.alias("start"), F.get(tokens, after - 1).end.alias("end"),
                    (after - first).cast("long").alias("n_tokens"), F.get(tokens, first).special.alias("special"),
                )

            return F.transform(at, one)

        return _let(place, span)

    return _let(word_numbers(tokens, mark), spans)


def word_rows(texts: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(text_id, word, start, end, n_tokens, special) of texts (text_id, text), without a shuffle."""
    tokenizer = tokenizer or SpaceTokenizer()
    found = tokenizer.tokenised(texts).select("text_id", words_of(F.col("tokens"), tokenizer.mark).alias("words"))
    return spread(found, ["text_id"], "words", "word")


def is_special(special_mask: Column, token_id: Column, unk_id: int, start: Column, end: Column) -> Column:
    """Marked special and not the unknown token, or of no length."""
    return ((special_mask == 1) & (token_id != unk_id)) | (start == end)


def with_words(tokens: DataFrame) -> DataFrame:
    """Adds word: a new one starts at, and after, a special token and at a marked piece."""
    w = Window.partitionBy("text_id").orderBy("pos")
    starts = (F.col("pos") > 0) & (
        F.col("special") | F.lag("special", 1, False).over(w) | F.startswith("piece", F.lit(MARK))
    )
    return tokens.withColumn("_new", starts.cast("int")).withColumn("word", F.sum("_new").over(w).cast("int")).drop("_new")


def word_spans(tokens: DataFrame) -> DataFrame:
    """(text_id, word, start, end, n_tokens) of tokens with words; the end is exclusive."""
    return tokens.groupBy("text_id", "word").agg(
        F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.count(F.lit(1)).alias("n_tokens")
    )


class Embedder(Protocol):
    """``embedded`` adds embedding, an array of numbers, to tokens of one row each."""

    def embedded(self, tokens: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class TableEmbedder:
    """Vectors by token id, from a table (token_id, embedding); a token that the table lacks goes."""

    table: DataFrame

    def embedded(self, tokens: DataFrame) -> DataFrame:
        return tokens.join(self.table.select(F.col("token_id").alias("_id"), "embedding"), F.col("id") == F.col("_id")).drop("_id")


@dataclass(frozen=True)
class ContextEmbedder:
    """Vectors that depend on the whole text: ``forward`` takes a text's token ids to (n, dim) vectors, over Arrow batches."""

    forward: Callable[[np.ndarray], np.ndarray]

    def embedded_texts(self, tokenised: DataFrame) -> DataFrame:
        """(text_id, tokens, vectors) of (text_id, tokens)."""
        forward = self.forward

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                ids = [np.array([t["id"] for t in row], dtype=np.int64) for row in frame["tokens"]]
                yield pd.DataFrame({"text_id": frame["text_id"], "tokens": frame["tokens"], "vectors": [forward(x).tolist() if len(x) else [] for x in ids]})

        return tokenised.mapInPandas(run, f"text_id long, tokens array<{TOKEN}>, vectors array<array<double>>")

    def embedded(self, tokens: DataFrame) -> DataFrame:
        names = [c for c in TOKEN[7:-1].replace(":", ",").split(",")[::2]]
        gathered = tokens.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("tokens"))
        rows = self.embedded_texts(gathered).select("text_id", F.posexplode("vectors").alias("pos", "embedding"))
        return tokens.join(rows, ["text_id", "pos"])


def embedded(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """Tokens with their vectors: ``table`` has token_id and embedding."""
    return tokens.join(table.select("token_id", "embedding"), "token_id")


def mean_vector(column: str, dim: int) -> Column:
    """The element-wise mean of arrays, aggregated place by place: a group is never gathered."""
    return F.array(*[F.avg(F.get(F.col(column), F.lit(i)).cast("double")) for i in range(dim)])


def word_vectors(tokens: DataFrame, dim: int) -> DataFrame:
    """(text_id, word, vector): the mean of a word's token vectors."""
    return tokens.groupBy("text_id", "word").agg(mean_vector("embedding", dim).alias("vector"))


def checked_overlap(overlap: float) -> float:
    if not 0 <= overlap <= 0.9:
        raise ValueError("the overlap must be between 0 and 0.9")
    return overlap


def window_starts(n: Column, size: int, overlap: float = 1 / 3) -> Column:
    """0 alone if all fits, else every step up to the end, windows inside the one before included."""
    step = size - int(size * checked_overlap(overlap))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(step)))


def covering_starts(n: Column, size: int, overlap: float = 1 / 3) -> Column:
    """As a tokenizer's overflow does: no window starts once one has reached the end."""
    step = size - int(size * checked_overlap(overlap))
    return F.filter(window_starts(n, size, overlap), lambda s: (s == 0) | (s + size - step < n))


def windows(words: DataFrame, size: int, overlap: float = 1 / 3) -> DataFrame:
    """(text_id, start_word, n): unpadded windows; the mask is implied by n. ``words`` has text_id and n_words."""
    cut = words.select("text_id", "n_words", F.explode(window_starts(F.col("n_words"), size, overlap)).alias("start_word"))
    return cut.select("text_id", "start_word", F.least(F.lit(size), F.col("n_words") - F.col("start_word")).cast("int").alias("n"))


def padded(values: Column, size: int, zero: Column) -> Column:
    """For a scorer that wants full windows: the values, then zeros."""
    return F.concat(values, F.array_repeat(zero, F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def starts_of(place: Column, n: Column, size: int, overlap: float = 1 / 3, covering: bool = False) -> Column:
    """The starts of the windows that hold a place of 0 .. n-1."""
    step = size - int(size * checked_overlap(overlap))
    lowest = F.when(n <= size, F.lit(0)).otherwise(F.greatest(F.ceil((place - size + 1) / step) * step, F.lit(0)))
    highest = F.when(n <= size, F.lit(0)).otherwise(F.floor(place / step) * step)
    starts = F.sequence(lowest.cast("int"), highest.cast("int"), F.lit(step))
    return F.filter(starts, lambda s: (s == 0) | (s + size - step < n)) if covering else starts


def window_words(spans: DataFrame, size: int, overlap: float = 1 / 3) -> DataFrame:
    """Words by window: (text_id, start_word, place, word, start, end); a word in an overlap is in each window."""
    if "n_words" not in spans.columns:
        spans = spans.join(spans.groupBy("text_id").agg((F.max("word") + 1).alias("n_words")), "text_id")
    starts = starts_of(F.col("word"), F.col("n_words"), size, overlap)
    return spans.select("text_id", "word", "start", "end", F.explode(starts).alias("start_word")).withColumn("place", F.col("word") - F.col("start_word"))


def text_words(texts: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """As ``word_rows``, with n_words, the number of the text's words."""
    tokenizer = tokenizer or SpaceTokenizer()
    found = tokenizer.tokenised(texts).select("text_id", words_of(F.col("tokens"), tokenizer.mark).alias("words"))
    # The size is a column of its own first, or every word's row would carry the whole array.
    return spread(found.select("text_id", F.size("words").alias("n_words"), "words"), ["text_id", "n_words"], "words", "word")


def window_slices(units: Column, size: int, overlap: float = 1 / 3, covering: bool = False) -> Column:
    """(start, n, units, mask) of each window over an array: slices without padding, the mask as ones."""
    starts = (covering_starts if covering else window_starts)(F.size(units), size, overlap)

    def window(at: Column) -> Column:
        held = F.slice(units, at + 1, F.lit(size))
        return F.struct(at.alias("start"), F.size(held).alias("n"), held.alias("units"), F.array_repeat(F.lit(1), F.size(held)).alias("mask"))

    return F.transform(F.when(F.size(units) > 0, starts).otherwise(F.array().cast("array<int>")), window)
