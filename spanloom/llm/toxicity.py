"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of tokens, each of a class: insult, threat, target,
negation, report, clause break or other; insults and threats carry a weight. Three small transducers read classes: one
opens a scope of negation for a few tokens, one marks reported speech up to the
end of the clause, one marks a clause that has named a target. Their product is
one transducer whose arcs put each insult or threat into a slot (kind, negated,
reported, targeted); the last of the three reads a clause from both ends, so a target
counts on either side of the word. A clause is thus scored as a whole: the same word weighs
differently under negation, in reported speech, or aimed at somebody. Slots sum
the lexicon's weights, and a logistic layer turns slots into a score.

The insult lexicon is learned from labelled rows, cut into the same tokens: words and word beginnings whose
occurrences are nearly all in toxic texts; a beginning needs several such words.
Occurrences are counted by distinct neighbours, so copies of a text count once. At most ``SAMPLE`` labelled rows a class
(smallest hash of the id first) are used to fit, and the lexicon has at most
``LEXICON`` entries; scoring covers every whole text.

Defined results: null and empty texts score as texts without any match; a null
id counts as empty text for the fold;
several labels of one id count as toxic if one is; without labels the seed
lexicon and prior weights are used; repeated rows score alike; very long texts are
read whole; an empty table gives no rows; other columns pass through, but for one named score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import fold_of, read, small_batches
from spanloom.session import shared_dir

SAMPLE, LEXICON, THRESHOLD, HELD_OUT = 6000, 20_000, 0.3, 2
MIN_EVIDENCE, MIN_PURITY, MIN_WORDS, SCOPE = 13.0, 0.95, 4, 3
PREFIXES = range(3, 8)

#: Words of the closed classes, in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur he she they them du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted vosotros".split()
NEGATIONS = "not no never cannot nicht kein keine nie pas jamais aucun nunca jamás ni".split()
REPORTS = "said says told wrote called quoted reported according sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = "kill murder hurt destroy beat stab shoot burn töten umbringen tuer frapper matar golpear".split()
#: Insults to start from where no labelled row says otherwise.
SEED_INSULTS = "idiot moron stupid trash scum loser clown pathetic worthless disgusting".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;\n]")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower().replace("\u2019", "'"))


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][class]`` is the next state; ``marks[state]`` is what holds for a match read there."""

    arcs: tuple[tuple[int, ...], ...]
    marks: tuple[bool, ...]


def _scope() -> Transducer:
    """State k: k more tokens are negated."""
    rows = [[max(0, k - 1)] * 7 for k in range(SCOPE + 1)]
    for row in rows:
        row[NEGATION], row[BREAK] = SCOPE, 0
    return Transducer(tuple(map(tuple, rows)), tuple(k > 0 for k in range(SCOPE + 1)))


def _until_break(opening: int) -> Transducer:
    rows = [[state] * 7 for state in (0, 1)]
    for row in rows:
        row[opening], row[BREAK] = 1, 0
    return Transducer(tuple(map(tuple, rows)), (False, True))


def composed(parts: list[Transducer]) -> tuple[list[list[int]], list[int]]:
    """The product: arcs by state and class, and for each state its marks as bits."""
    sizes = [len(p.arcs) for p in parts]
    total = math.prod(sizes)

    def unpacked(state: int) -> list[int]:
        out = []
        for n in sizes:
            out.append(state % n)
            state //= n
        return out

    def packed(states: list[int]) -> int:
        value = 0
        for s, n in zip(reversed(states), reversed(sizes)):
            value = value * n + s
        return value

    arcs = [[packed([p.arcs[s][c] for p, s in zip(parts, unpacked(q))]) for c in range(7)] for q in range(total)]
    marks = [sum(p.marks[s] << i for i, (p, s) in enumerate(zip(parts, unpacked(q)))) for q in range(total)]
    return arcs, marks


ARCS, MARKS = composed([_scope(), _until_break(REPORT), _until_break(TARGET)])
#: Two kinds (insult, threat) by eight combinations of negated, reported and targeted.
SLOTS, TARGETED = 16, 4
_CLOSED = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}


class Reader:
    """Runs the composed transducer over texts, with the lexicon's weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        self.lengths = sorted({len(k) - 1 for k in lexicon if k.endswith("*")})

    def _look(self, word: str) -> tuple[int, float]:
        weight = self.lexicon.get(word, 0.0)
        for n in self.lengths:
            if n <= len(word):
                weight = max(weight, self.lexicon.get(word[:n] + "*", 0.0))
        if weight > 0:
            return INSULT, weight
        if len(word) == 1 and not word.isalnum():
            return BREAK, 0.0
        kind = NEGATION if word.endswith("n't") else _CLOSED.get(word, OTHER)
        return kind, 1.0 if kind == THREAT else 0.0

    def slots(self, text: str | None) -> list[float]:
        out = [0.0] * SLOTS
        known, state = self.known, 0
        waiting: list[tuple[int, float]] = []  # of this clause, no target named so far
        if len(known) > 400_000:
            known.clear()
        for word in tokens_of(text):
            found = known.get(word)
            if found is None:
                found = known[word] = self._look(word)
            kind = found[0]
            if kind == OTHER:
                state = ARCS[state][kind]
                continue
            if kind == INSULT or kind == THREAT:
                slot = 8 * (kind - INSULT) + MARKS[state]
                if MARKS[state] & TARGETED:
                    out[slot] += found[1]
                else:
                    waiting.append((slot, found[1]))
            elif waiting and (kind == TARGET or kind == BREAK):
                for slot, weight in waiting:
                    out[slot + TARGETED if kind == TARGET else slot] += weight
                waiting.clear()
            state = ARCS[state][kind]
        for slot, weight in waiting:
            out[slot] += weight
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, weight of at most ``sample`` rows a class outside the held-out fold."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    chosen = [marks.where(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    # At most 2 * sample ids are broadcast.
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words, and beginnings as ``abc*``, with their weights."""

    @F.pandas_udf("array<string>")
    def lowered(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [w for w in tokens_of(t) if w[0].isalnum() or w[0] == "_"])

    zipped = F.arrays_zip(
        F.col("ws"),
        F.concat(F.array(F.lit("")), F.col("ws")).alias("before"),
        F.expr("slice(ws, 2, size(ws))").alias("after"),
    )
    words = sample.select("toxic", lowered("text").alias("ws")).select("toxic", F.inline(zipped)).where(F.length("ws") >= 3)
    contexts = words.select("toxic", F.col("ws").alias("word"), F.xxhash64("before", "after").alias("c")).distinct()
    by_word = contexts.groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") != 1).alias("neg")
    )
    by_word = by_word.checkpoint()
    total = by_word.agg(F.sum("pos"), F.sum("neg")).first()
    if not total[0] or not total[1]:
        return {w: 4.0 for w in SEED_INSULTS}
    base = total[0] / (total[0] + total[1])
    starts = F.transform(
        F.filter(F.array(*[F.lit(n) for n in PREFIXES]), lambda n: n < F.length("word")),
        lambda n: F.concat(F.col("word").substr(F.lit(1), n), F.lit("*")),
    )
    entries = by_word.select(F.explode(F.concat(F.array("word"), starts)).alias("entry"), "pos", "neg")
    entries = entries.groupBy("entry").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("words")
    )
    p, n = F.col("pos"), F.col("neg")
    evidence = p * F.log(p / ((p + n) * base)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - base)))).otherwise(0.0)
    kept = entries.where((p > 0) & (p >= MIN_PURITY * (p + n)) & (~F.endswith("entry", F.lit("*")) | (F.col("words") >= MIN_WORDS))).withColumn("evidence", evidence).where(F.col("evidence") >= MIN_EVIDENCE)
    rows = kept.orderBy(F.desc("evidence"), "entry").limit(LEXICON).collect()
    found = {r.entry: math.log((r.pos + 0.5) / (r.neg + 0.5) * (1 - base) / base) for r in rows}
    return found or {w: 4.0 for w in SEED_INSULTS}


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights, the bias last, by damped Newton steps."""
    x = np.hstack([np.log1p(x), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    weight = weight / weight.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / len(y) + penalty @ w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: list[float]


PRIOR_WEIGHTS = [1.0, 0.3] * 8 + [-3.0]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and slot weights from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    rows = labelled_sample(docs, labels, sample).checkpoint()
    lexicon = learned_lexicon(rows)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts in batches:
            yield pd.Series([reader.slots(t) for t in texts])

    got = rows.select("toxic", slots("text").alias("x")).collect()
    y = np.array([float(r.toxic == 1) for r in got])
    if not len(y) or y.min() == y.max():
        return Model(lexicon, PRIOR_WEIGHTS)
    x = np.array([r.x for r in got])
    counts = dict(labels.where(fold_of(F.col("doc_id")) != HELD_OUT).groupBy("toxic").count().where("toxic IN (0, 1)").collect())
    share = {c: counts.get(c, 1) / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return Model(lexicon, fitted(x, y, weight).tolist())


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score, between 0 and 1, to every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, w = Reader(model.lexicon), np.array(model.weights)
        for texts in batches:
            x = np.log1p(np.array([reader.slots(t) for t in texts]).reshape(-1, SLOTS))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return docs.withColumn("score", score(F.col(text_col)))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
