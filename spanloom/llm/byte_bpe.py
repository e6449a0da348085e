"""Byte-level BPE by Spark higher-order functions.

A word is the array of its bytes' ids, each packed below its place and the rank of the pair it begins; a fold over it
merges, one step at a time, the adjacent pair of lowest rank (the leftmost of equals) until no pair has a rank, and looks
up the two pairs that a merge makes. As a token's rank is its id, a pair of ids leads to the rank of their merge: two
literal arrays hold these, a slot a pair, so that a look-up is two array accesses.

Only distinct words are folded. Texts come in blocks of ``BLOCK`` bytes or more of the partition at hand; a
block is one row with its distinct words and, for each text, the places of its words among them. The words of a block are folded once, and
texts pick their ids by place. Nothing is shuffled, sampled or kept between blocks. Pieces over ``LONG`` bytes, where a fold would take quadratic
time, get the library's ids.

Decoding looks each id's bytes up in a literal array and concatenates the pieces.

Defined results: null and empty texts have no ids; very long texts are encoded whole, in a block of their own;
special tokens' strings are ordinary text; repeated rows are encoded alike; an empty table gives no rows;
other columns pass through, but for one named as the result.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import let, read, small_batches, without

LONG, BLOCK = 512, 1 << 25
#: No rank, above any; the bits of an id, and the id at either end of a word.
_NONE = _ID = (1 << 20) - 1
_libraries: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def library(ranks_path: str, pattern: str):
    """The library's own encoding, once a process."""
    if ranks_path not in _libraries:
        import tiktoken

        _libraries[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    return _libraries[ranks_path]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let`` without an array: the fold of no elements evaluates ``value`` once and hands it on."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(base, slots): the pair of ``left`` and ``right`` has its slot at base[left] + right, which holds left and rank.

    Rows of pairs with one left id are laid over each other, the largest first, each at a drawn shift that hits no taken slot.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    top = max(ranks.values()) + 1
    base, slots = np.full(top, -top, np.int32), np.full(1 << (4 * (top + sum(map(len, rows.values())))).bit_length() - 1, -1, np.int64)
    draw = np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights, tries = np.array([r for r, _ in row]), 8
        while not (fits := (slots[(at := draw.integers(0, len(slots) - top, tries))[:, None] + rights] < 0).all(1)).any():
            tries = min(2 * tries, 256)
        base[left] = at[fits.argmax()]
        slots[base[left] + rights] = [left << 20 | rank for _, rank in row]
    return base, slots


def merge_literals(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The same as literals; an empty slot is null."""
    base, slots = merge_table(ranks)
    return tuple(F.from_json(F.lit(json.dumps(t, separators=(",", ":"))), kind) for t, kind in ((base.tolist(), "array<int>"), ([None if s < 0 else s for s in slots.tolist()], "array<bigint>")))


def first_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte and the rank of each pair of bytes."""
    pair = np.array([ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)], np.int32)
    return np.array([ranks[bytes([b])] for b in range(256)], np.int32), pair


def starts(words: pa.StringArray, folds: np.ndarray, first: np.ndarray, pair: np.ndarray) -> pa.ListArray:
    """The elements of each word before the fold, between two elements without a rank; none but these where ``folds`` is false."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    data, size = data[np.repeat(folds, size)], np.where(folds, size, 0)
    begin = (np.cumsum(size) - size).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(size + 2)])
    # Added in place, as these arrays are the worker's largest.
    inner = np.full(len(data), _NONE, np.int64)
    inner[:-1] = pair[data[:-1].astype(np.int32) << 8 | data[1:]]
    inner[(begin + size - 1)[size > 0]] = _NONE
    inner <<= 20
    inner += np.arange(1, len(data) + 1, dtype=np.int32)
    inner -= np.repeat(begin, size)
    inner <<= 20
    inner |= first[data]
    found = np.full(offsets[-1], _NONE << 40 | _ID, np.int64)
    found[offsets[1:] - 1] |= size.astype(np.int64) + 1 << 20
    within = np.ones(len(found), bool)
    within[offsets[:-1]] = within[offsets[1:] - 1] = False
    found[within] = inner
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found))


def pieces(text: Column, pattern: str) -> Column:
    """The matches of the splitting pattern, with Unicode white space as the library sees it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def folded(start: Column, base: Column, slots: Column) -> Column:
    """The ids of one word, from its elements: the rank of the pair that begins here, the place, the id."""

    def rank(left: Column, right: Column) -> Column:
        """At bit 40. A slot of another left id, or none, is no rank."""
        return F.shiftleft(F.least(F.get(slots, F.get(base, left.cast("int")) + right.cast("int")).bitwiseXOR(F.shiftleft(left, 20)), F.lit(_NONE)), 40)

    def merged(elements: Column, low: Column, place: Column) -> Column:
        token = F.shiftright(low, 40)
        taken, after = F.get(elements, place + 1), F.get(elements, place + 2)

        def changed(before: Column) -> Column:
            whole = rank(token, after.bitwiseAND(_ID)).bitwiseOR(low.bitwiseAND(_ID << 20)).bitwiseOR(token)
            ahead = rank(before.bitwiseAND(_ID), token).bitwiseOR(before.bitwiseAND((1 << 40) - 1))
            return F.transform(elements, lambda e: F.when(e == low, whole).when(e == before, ahead).otherwise(e))

        return F.array_remove(bound(F.get(elements, place - 1), changed), taken)

    def step(elements: Column, _: Column) -> Column:
        # array_position leaves its loop by an exception, which costs more than the rest of a step.
        place = lambda low: F.array_min(F.transform(elements, lambda e, i: F.when(e == low, i)))
        return bound(F.array_min(elements), lambda low: F.when(low < _NONE << 40, bound(place(low), lambda p: merged(elements, low, p))).otherwise(elements))

    ids = lambda elements: F.array_remove(F.transform(elements, lambda e: e.bitwiseAND(_ID).cast("int")), _ID)
    return F.aggregate(F.slice(start, 4, LONG), start, step, ids)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and the ids of the whole text."""
    small_batches(docs.sparkSession)
    ranks = load_ranks(ranks_path)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in without(docs.select(*(keep or docs.columns)), out).columns]).alias("row"), pieces(F.col(text_col), pattern).alias("words"))
    kind = rows.schema["row"].dataType.simpleString()
    bytes_ids, bytes_ranks = first_ranks(ranks)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            row, words = (pa.concat_arrays(table.column(i).chunks) for i in (0, 1))
            coded = words.flatten().dictionary_encode()
            places = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(words.value_lengths()).cast(pa.int32())]), coded.indices)
            texts = pa.StructArray.from_arrays([row, places], ["row", "places"])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            long = pc.greater(pc.binary_length(coded.dictionary), LONG)
            encode = library(ranks_path, pattern).encode_ordinary if pc.any(long).as_py() else None
            given = [encode(w.as_py()) if x else None for w, x in zip(coded.dictionary, long.to_pylist())] if encode else [None] * len(coded.dictionary)
            return pa.RecordBatch.from_arrays([one(texts), one(starts(coded.dictionary, ~long.to_numpy(zero_copy_only=False), bytes_ids, bytes_ranks)), one(pa.array(given, pa.list_(pa.int32())))], ["texts", "starts", "given"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(1).flatten().nbytes
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    made = rows.mapInArrow(blocks, f"texts array<struct<row:{kind},places:array<int>>>, starts array<array<bigint>>, given array<array<int>>")

    base, slots = merge_literals(ranks)

    def ids(base: Column, slots: Column) -> Column:
        return F.zip_with("starts", "given", lambda s, g: F.coalesce(g, folded(s, base, slots)))

    def texts(found: Column) -> Column:
        return F.transform("texts", lambda t: F.struct(t.row.alias("row"), F.flatten(F.transform(t.places, lambda i: F.get(found, i))).alias(out)))

    spread = made.select(F.inline_outer(let(let(base, lambda b: let(slots, lambda s: ids(b, s))), texts))).where("row IS NOT NULL")
    return spread.select("row.*", out)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of the ids, as binary."""
    table: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token.hex().upper()
    literal = F.from_json(F.lit(json.dumps(table)), "array<string>")
    return let(literal, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encoded(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), load_ranks(path)), 256).alias("decoded_sha256"),
    )
