"""Language identification of spans in mixed-language text.

The script of a word narrows its candidates to the languages that were learned
with it. Each candidate scores the word by its character trigrams, a Viterbi path
over the words pays a penalty for each switch of language, and runs of one
language are the spans. The language with most letters in its spans is the
document's.

Learned from about ``SAMPLE`` documents a language outside the held-out fold (all, if it has
fewer): those whose hash of the id lies under the share that the language's count sets, so
no language is sorted in one task. A language keeps at most ``GRAMS`` trigrams, the most
frequent; scripts are counted apart from them. Labelling covers every whole text.

Defined results: a null text, or one without letters, is ``und`` with score 0 and no
spans; a word in a script no language was learned with supports none of them, and
a text of only such words gets the first language, in alphabetical order, with
score 0; rows without lang teach nothing; ties go to the first language in
alphabetical order; repeated rows are labelled alike; an empty table gives no
rows. Without any labelled row every text is ``und``. Other columns pass through, but
for those of the results' names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import fold_of, read, small_batches, without
from spanloom.session import shared_dir

SAMPLE, GRAMS, HELD_OUT = 2000, 20_000, 2
SWITCH, FLOOR, BATCH_CHARS, KNOWN_WORDS = 9.0, -8.0, 20_000_000, 300_000
WORD = re.compile(r"[^\W\d_]+")
#: First and last code points of scripts; letters elsewhere count as Latin.
SCRIPTS = {
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3134F)],
}
_RANGES = sorted((a, b, name) for name, ranges in SCRIPTS.items() for a, b in ranges)


def script(word: str) -> str:
    at = ord(word[0])
    if at < 0x370:
        return "Latin"
    return next((name for a, b, name in _RANGES if a <= at <= b), "Latin")


def grams(word: str) -> list[str]:
    framed = f"^{word}$"
    return [framed[i : i + 3] for i in range(len(framed) - 2)]


@dataclass(frozen=True)
class Model:
    """Log probabilities by trigram, one number a language; the languages of each script."""

    languages: list[str]
    table: dict[str, list[float]]
    unseen: list[float]
    scripts: dict[str, list[bool]]


def fit(docs: DataFrame, sample: int = SAMPLE, kept_grams: int = GRAMS) -> Model:
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
    sizes = {r.lang: r["count"] for r in taught.groupBy("lang").count().collect()}
    shares = [(lang, min(1.0, sample / n)) for lang, n in sizes.items()]
    if not shares:
        return Model([], {}, [], {})
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in shares]), F.array(*[F.lit(v) for _, v in shares])), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    rows = taught.where(drawn).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found: Counter = Counter()
            for lang, text in zip(frame["lang"], frame["text"]):
                for word, n in Counter(WORD.findall(text.lower())).items():
                    found[lang, "script:" + script(word)] += n
                    for g in grams(word):
                        found[lang, g] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["lang", "gram", "n"])

    counts = rows.mapInPandas(count, "lang string, gram string, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("script", F.startswith("gram", F.lit("script:"))).checkpoint()
    least = dict.fromkeys(sizes, 0)
    held = dict.fromkeys(sizes, 0)
    many = counts.where("NOT script").groupBy("lang", "n").count().orderBy("lang", F.desc("n"))
    # One row a distinct count: a language's smallest count that keeps it within its number of trigrams.
    for r in many.toLocalIterator():
        held[r.lang] += r["count"]
        if held[r.lang] > kept_grams and not least[r.lang]:
            least[r.lang] = r.n + 1
    bound = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in least]), F.array(*[F.lit(v) for v in least.values()])), F.col("lang"))
    kept = counts.where(F.col("script") | (F.col("n") >= bound)).select("lang", "gram", "n").collect()
    languages = sorted({r.lang for r in kept})
    at = {lang: i for i, lang in enumerate(languages)}
    by_gram: dict[str, np.ndarray] = {}
    by_script: dict[str, np.ndarray] = {}
    for r in kept:
        home, name = (by_script, r.gram[7:]) if r.gram.startswith("script:") else (by_gram, r.gram)
        home.setdefault(name, np.zeros(len(languages)))[at[r.lang]] = r.n
    total = np.sum(list(by_gram.values()), axis=0) if by_gram else np.zeros(len(languages))
    size = total + 0.5 * (len(by_gram) + 1)
    letters = np.maximum(np.sum(list(by_script.values()), axis=0), 1) if by_script else np.ones(len(languages))
    return Model(
        languages,
        {g: np.log((n + 0.5) / size).tolist() for g, n in by_gram.items()},
        np.log(0.5 / size).tolist() if len(languages) else [],
        {s: (n / letters >= 0.01).tolist() for s, n in by_script.items()},
    )


class _Index(dict):
    """Numbers words as they come."""

    def __init__(self):
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        return at


class Labeller:
    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)
        self.rows = {g: i for i, g in enumerate(model.table)}
        self.table = np.array([*model.table.values(), model.unseen]).reshape(len(self.rows) + 1, self.n)
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.scores, self.letters = np.zeros((0, self.n)), np.zeros(0, dtype=np.int64)

    def settle(self) -> None:
        """Scores the words that have come since: log odds against the best candidate, 0 or below.

        Languages without the word's script stay below the floor; a script of no language says nothing.
        """
        words = self.index.words[len(self.letters) :]
        if not words:
            return
        unseen, row = len(self.table) - 1, self.rows.get
        flat = [row(g, unseen) for w in words for g in grams(w)]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        total = np.add.reduceat(self.table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        scripts: dict[str, int] = {}
        home = np.fromiter((scripts.setdefault(script(w), len(scripts)) for w in words), dtype=np.int64, count=len(words))
        allowed = np.array([self.model.scripts.get(s, [False] * self.n) for s in scripts], dtype=bool)[home]
        best = np.where(allowed, total, -np.inf).max(axis=1)
        best[~np.isfinite(best)] = 0.0
        score = np.where(allowed, np.maximum(total - best[:, None], FLOOR), 2 * FLOOR)
        letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words), dtype=np.int64, count=len(words))
        score[~allowed.any(axis=1) | (letters == 0)] = 0.0
        self.scores = np.concatenate([self.scores, score])
        self.letters = np.concatenate([self.letters, letters])

    def ids(self, text: str | None) -> np.ndarray:
        """Each word's row among the scores."""
        found = WORD.findall((text or "").lower())
        return np.fromiter(map(self.index.__getitem__, found), dtype=np.int32, count=len(found))

    def paths(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best language at each word of each text; texts step side by side, longest first."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[: len(sizes)]
        scores = self.scores
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        value = np.zeros((len(sizes), self.n))
        stays, froms = [], []
        for t in range(longest):
            k = active[t]
            v = value[:k]
            if t:
                best = v.argmax(axis=1)
                switch = v[np.arange(k), best] - SWITCH
                stay = v >= switch[:, None]
                np.maximum(v, switch[:, None], out=v)
                stays.append(stay)
                froms.append(best.astype(np.int16))
            v += scores[flat[starts[:k] + t]]
        path = np.zeros(len(flat), dtype=np.int16)
        now = value.argmax(axis=1) if len(sizes) else np.zeros(0, dtype=np.int64)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            path[starts[:k] + t] = now[:k]
            if t:
                rows = np.arange(k)
                now[:k] = np.where(stays[t - 1][rows, now[:k]], now[:k], froms[t - 1])
        out: list = [None] * len(texts)
        for i, start, n in zip(order, starts, sizes):
            out[i] = path[start : start + n]
        return out

    def spans(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of letters, spans of (first word, words, language)) for each text."""
        names = self.model.languages
        if not names:
            yield from (("und", 0.0, []) for _ in texts)
            return
        parts = [self.ids(t) for t in texts]
        self.settle()
        paths = self.paths(parts)
        spoken = self.scores.any(axis=1) | (self.n == 1)
        for ids, path in zip(parts, paths):
            letters = self.letters[ids]
            if not letters.sum():
                yield "und", 0.0, []
                continue
            evidence = np.bincount(path, weights=letters * spoken[ids], minlength=self.n)
            edges = np.flatnonzero(np.diff(path)) + 1
            firsts = np.concatenate([[0], edges])
            ends = np.concatenate([edges, [len(path)]])
            best = int(evidence.argmax())
            found = [(int(a), int(b - a), names[path[a]]) for a, b in zip(firsts, ends)]
            yield names[best], float(evidence[best] / letters.sum()), found


RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("first_word", T.IntegerType()),
                        T.StructField("words", T.IntegerType()),
                        T.StructField("lang", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def labelled(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and spans to every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)

        def done(texts: list) -> pd.DataFrame:
            rows = [
                (lang, score, [{"first_word": a, "words": n, "lang": x} for a, n, x in spans])
                for lang, score, spans in labeller.spans(texts)
            ]
            if len(labeller.index) > KNOWN_WORDS:
                labeller.forget()
            return pd.DataFrame(rows, columns=RESULT.names)

        texts, held = [], 0
        for batch in batches:
            texts += batch.tolist()
            held += sum(len(t) for t in batch if t is not None)
            if held > BATCH_CHARS:
                yield done(texts)
                texts, held = [], 0
        if texts:
            yield done(texts)

    kept = without(docs, *RESULT.names).columns
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct().alias("row")
    return docs.select(row, label(F.col(text_col)).alias("label")).select("row.*", "label.*")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return labelled(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
