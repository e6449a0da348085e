"""Hierarchical multi-length packing.

Windows come in tiers of a power of two of tokens. A document's full windows of
the longest tier stand alone; its rest is routed to the shortest tier that holds
it. Tiers are packed longest first: a window opens with one rest of its tier, its
gap takes the longest whole rests of shorter tiers that fit and is then closed
exactly by cutting one more, whose remainder goes back to its own tier. Windows
are dealt to step groups, largest first to the group with the fewest tokens, so
that steps of a trainer carry equal work.

A task packs its own partition as a stream, with no shuffle: documents come in
chunks of a bounded number of tokens, and what a chunk can't close exactly is
carried to the next one. Only the end of a partition leaves windows shorter than
the shortest tier, cut at powers of two.

Ids are those of the tokenizer file as it stands, without added ones: the string of a
special token within a text is its id.

Defined results: null and empty texts are the closing id alone; very long texts are encoded whole; rows without id
keep a null id; repeated rows are packed again; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import read, small_batches

TIERS, CLOSING_ID, CHUNK_TOKENS, STEP_TOKENS = (256, 512, 1024, 2048), 1, 1 << 21, 1 << 17
WORDS, CHUNK_WORDS = 250_000, 1 << 19
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)
_encoders: dict = {}


class Encoder:
    """The ids of a tokenizer file, without added special tokens.

    Where the file is a plain byte-level BPE, words are split beforehand (``split``), each distinct word of many texts is looked up
    once, and the library's model is asked for those that the last ``WORDS`` to twice ``WORDS`` distinct ones lack. Texts that
    hold a special token's string, or letters beyond Latin, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printed}))}
        self.words, self.older = {}, {}

    def _packed(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            letters = word.encode().decode("latin-1").translate(self.letters)
            found = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
        if len(self.words) >= WORDS:
            self.words, self.older = {}, self.words
        self.words[word] = found
        return found

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def of_words(self, words: pa.ListArray) -> list[np.ndarray]:
        """The ids of each text, of its words."""
        coded = words.flatten().dictionary_encode()
        known, packed = self.words.get, self._packed
        values = [known(w) or packed(w) for w in coded.dictionary.to_pylist()]
        table = np.frombuffer(b"".join(values), dtype=np.uint32)
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        place = coded.indices.to_numpy()
        size = sizes[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        first = (np.cumsum(sizes) - sizes)[place]
        ids = table[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())])].tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]


def split(text: Column, tokenizer_path: str) -> tuple[Column, Column]:
    """(whole, words): the text where it must go to the library whole, else its words; ``PATTERN`` is the byte-level pre-tokenizer's."""
    import public_tokenizers

    with open(tokenizer_path, encoding="utf-8") as file:
        made = json.load(file)
    cut = made["pre_tokenizer"] or {}
    plain = not made["normalizer"] and not made["post_processor"] and made["model"]["type"] == "BPE"
    plain &= cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    text = F.coalesce(text, F.lit(""))
    odd = text.rlike(r"[^\x{0}-\x{24F}]") if plain else F.lit(True)
    for token in made["added_tokens"]:
        odd = odd | F.contains(text, F.lit(token["content"]))
    words = F.regexp_extract_all(text, F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))
    return F.when(odd, text), F.when(~odd, words)


def encoder(tokenizer_path: str) -> Encoder:
    """The encoder of a tokenizer file, once a process."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path]


class Packer:
    """Packs rests of (length, key, start) into exact windows; keys order ties."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.pool = tuple(sorted(tiers)), []

    def add(self, key: int, tokens: int) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows of a document, as lists of (key, start, length); its rest joins the pool."""
        longest = self.tiers[-1]
        whole = tokens // longest * longest
        for start in range(0, whole, longest):
            yield [(key, start, longest)]
        if tokens > whole:
            insort(self.pool, (tokens - whole, key, whole))

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows that close exactly, longest tier first; the others' rests stay in the pool."""
        pool = self.pool
        while pool:
            first = pool.pop()
            tier = next(t for t in self.tiers if t >= first[0])
            held, gap = [first], tier - first[0]
            while gap and pool:
                at = bisect_right(pool, (gap, float("inf"), 0))
                if at:
                    held.append(pool.pop(at - 1))
                    gap -= held[-1][0]
                else:
                    size, key, start = pool.pop(0)
                    held.append((gap, key, start))
                    insort(pool, (size - gap, key, start + gap))
                    gap = 0
            if gap:
                for rest in held:
                    insort(pool, rest)
                return
            yield [(key, start, size) for size, key, start in held]

    def tail(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left, end to end, in windows of descending powers of two."""
        left = sum(size for size, _, _ in self.pool)
        rests = iter(self.pool)
        size, key, start = next(rests, (0, 0, 0))
        while left:
            room = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            left -= room
            held = []
            while room:
                if not size:
                    size, key, start = next(rests)
                take = min(size, room)
                held.append((key, start, take))
                size, start, room = size - take, start + take, room - take
            yield held
        self.pool = []


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: largest first to the group with the fewest tokens."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, groups[i] = heapq.heappop(heap)
        heapq.heappush(heap, (load + sizes[i], groups[i]))
    return groups


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    closing_id: int = CLOSING_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row a piece (``SCHEMA``); ids are little-endian unsigned 32-bit numbers, null unless asked for."""
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
            + [("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())]
        )
        encode = encoder(tokenizer_path)

        def encoded(held: list[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
            rows = pa.Table.from_batches(held).combine_chunks()
            words = rows.column("words").combine_chunks()
            parts = encode.of_words(words.chunk(0) if isinstance(words, pa.ChunkedArray) else words)
            for doc_id, text, ids in zip(rows.column("doc_id").to_pylist(), rows.column("whole").to_pylist(), parts):
                yield doc_id, np.append(ids if text is None else encode.whole(text), np.uint32(closing_id))

        def chunks() -> Iterator[tuple[int | None, np.ndarray]]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch.column(2).flatten())
                if n >= CHUNK_WORDS:
                    yield from encoded(held)
                    held, n = [], 0
            if held:
                yield from encoded(held)

        packer, held = Packer(tiers), {}
        base = TaskContext.get().partitionId() << 40
        sequences = steps = keys = tokens = 0

        def rows(windows: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            columns: list[list] = [[] for _ in schema]
            sizes = [sum(n for _, _, n in w) for w in windows]
            groups = step_groups(sizes, STEP_TOKENS)
            for window, size, group in zip(windows, sizes, groups):
                offset = 0
                for key, start, n in window:
                    doc_id, ids = held[key]
                    piece = ids[start : start + n].tobytes()
                    row = (doc_id, start, n, zlib.crc32(piece), len(ids), base + sequences, offset, size, base + steps + group, piece if with_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += n
                sequences += 1
            steps += max(groups, default=-1) + 1
            for at in range(0, len(columns[0]), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 4096], f.type) for c, f in zip(columns, schema)], schema=schema)

        windows: list = []
        for doc_id, ids in chunks():
            held[keys] = (doc_id, ids.astype("<u4", copy=False))
            windows += packer.add(keys, len(ids))
            keys += 1
            tokens += len(ids)
            if tokens >= CHUNK_TOKENS:
                windows += packer.windows()
                yield from rows(windows)
                open_keys = {key for _, key, _ in packer.pool}
                held = {key: held[key] for key in open_keys}
                windows, tokens = [], 0
        windows += packer.windows()
        windows += packer.tail()
        yield from rows(windows)
        encode.older = {}  # a worker that waits for its next task keeps less

    whole, words = split(F.col(text_col), tokenizer_path)
    return docs.select(F.col(id_col).alias("doc_id"), whole.alias("whole"), words.alias("words")).mapInArrow(pack, SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    found = packed(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
