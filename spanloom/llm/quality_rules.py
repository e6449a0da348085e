"""Quality rules as a short-circuit cascade.

On a bounded sample each rule's cost (seconds to evaluate it alone, the least of several
runs less that of an empty run) and selectivity (share of rows it rejects) are estimated;
rules then run in order of rejection per cost, and a row that one rejects is not shown to the later ones: the
cascade is one CASE expression, whose branches Spark evaluates lazily. A rule computes its own
measures from the text, so ``filtered`` never computes a measure that only later rules need;
``judged`` returns all measures and runs the same cascade over them. The order
changes the cost, never the verdict. The sample is drawn from the whole table.

Everything is built-in expressions inside the row: a text's words, lines and
windows never leave it, so no key is shuffled.

Defined results: a null text has no words and fails the base rules, as an empty
one does; very long texts are measured whole; repeated rows get the same verdict; an empty table gives no rows and
the declared order; other columns pass through, but for those of the results' names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import let, read, without, words

#: Symbols the contract counts.
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS, RUNS, MIN_WORDS, MAX_REPEAT_PERCENT, LEAST_COST = 2048, 3, 50, 50, 1e-3


class Measures(dict):
    """Measures by name: columns, made from the text and its words when they are first asked for."""

    def __init__(self, text: Column, ws: Column):
        self.text, self.ws = text, ws

    def __missing__(self, name: str) -> Column:
        self[name] = MEASURES[name](self.text, self.ws)
        return self[name]


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a boolean column of the measures."""

    name: str
    rejects: Callable[[Measures], Column]


def repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array ``ws``."""

    def covered(h: Column) -> Column:
        entries = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(e: Column) -> Column:
            hit = F.filter(e, lambda x, j: x.h.eqNullSafe(F.get(e, j - 1).h) | x.h.eqNullSafe(F.get(e, j + 1).h))
            return F.array_sort(F.transform(hit, lambda x: x.i))

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(entries, marked), length)

    def counted(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(ws) < 4, 0).otherwise(let(ws, counted)).cast("long")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


#: Each measure by the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, ws: F.size(ws).cast("long"),
    "word_chars": lambda text, ws: F.length(F.concat_ws("", ws)).cast("long"),
    "n_symbols": lambda text, ws: F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    "n_dup_lines": lambda text, ws: _duplicate_lines(text).cast("long"),
    "n_repeat_words": lambda text, ws: repeat_words(ws),
    "n_lines": lambda text, ws: F.size(F.split(text, "\n")),
    "n_shouts": lambda text, ws: F.regexp_count(text, F.lit("!!")),
    "n_letters": lambda text, ws: F.regexp_count(text, F.lit(r"\p{L}")),
}
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to the rows.

    The measures come out of a generator of one row: later filters stay above it, so none is evaluated twice.
    """
    measures = let(
        words(F.col("text")),
        lambda w: F.struct(*[MEASURES[name](whole(F.col("text")), w).alias(name) for name in RETURNED]),
    )
    return without(docs, *RETURNED).select("*", F.inline(F.array(measures)))


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m["n_words"] < MIN_WORDS),
        Rule("repeats", lambda m: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
    ]


def default_rules() -> list[Rule]:
    return [
        Rule("mean_word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"])),
        Rule("symbols", lambda m: m["n_symbols"] > 0.3 * m["n_words"]),
        Rule("duplicate_lines", lambda m: m["n_dup_lines"] > 0.5 * m["n_lines"]),
        Rule("shouting", lambda m: m["n_shouts"] > 0.3 * m["n_words"]),
        Rule("few_letters", lambda m: m["n_letters"] < 0.5 * m["word_chars"]),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float


def estimates(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample of the texts, in order of rejection per cost; ties keep the declared order."""
    total = docs.count()
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    sample = (docs.select("text") if share == 1.0 else docs.select("text").sample(share, seed=7)).cache()
    try:
        seen = sample.count()
        if not seen:
            return [Estimate(rule, LEAST_COST, 0.0) for rule in rules]

        def alone(rule: Rule) -> Column:
            return let(words(F.col("text")), lambda w: rule.rejects(Measures(whole(F.col("text")), w)))

        def run(column: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hit = sample.agg(F.count_if(column)).first()[0]
            return time.perf_counter() - began, hit

        empty = let(words(F.col("text")), lambda w: F.size(w) < 0)
        floor = min(run(empty)[0] for _ in range(RUNS + 1))
        made = []
        for rule in rules:
            tried = [run(alone(rule)) for _ in range(RUNS)]
            made.append(Estimate(rule, max(min(t for t, _ in tried) - floor, LEAST_COST), tried[0][1] / seen))
    finally:
        sample.unpersist()
    return sorted(made, key=lambda e: -e.rejected / e.cost)


def cascade_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    return [e.rule for e in estimates(docs, rules, sample_rows)]


def cascade(order: list[Rule], m: Measures) -> Column:
    """The name of the first rule in ``order`` that rejects, null if none does."""
    chain = F.when(F.lit(False), F.lit(""))
    for rule in order:
        chain = chain.when(rule.rejects(m), rule.name)
    return chain


def base_failed(m: Measures) -> Column:
    first, *others = [rule.rejects(m) for rule in base_rules()]
    for other in others:
        first = first | other
    return first


def judged(docs: DataFrame, rules: list[Rule] | None = None, order: list[Rule] | None = None) -> DataFrame:
    """The rows with their measures, failed_rule, base_failed and kept."""
    rules = base_rules() + (rules if rules is not None else default_rules())
    order = order or cascade_order(docs, rules)
    m = Measures(whole(F.col("text")), words(F.col("text")))
    m |= {name: F.col(name) for name in RETURNED}
    rows = measured(docs).withColumn("failed_rule", cascade(order, m))
    return rows.withColumns({"base_failed": base_failed(m), "kept": F.col("failed_rule").isNull()})


def filtered(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that every rule keeps, with their own columns; a measure is computed only if the cascade comes to its rule."""
    rules = base_rules() + (rules if rules is not None else default_rules())
    order = cascade_order(docs, rules)
    verdict = let(words(F.col("text")), lambda w: F.struct(cascade(order, Measures(whole(F.col("text")), w)).alias("failed")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return own.select("row", F.inline(F.array(verdict))).where("failed IS NULL").select("row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM i),
c AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_symbols > 0.3 * n_words
    OR n_dup_lines > 0.5 * len(string_split(text, chr(10)))
    OR len(regexp_extract_all(text, '!!')) > 0.3 * n_words
    OR len(regexp_extract_all(text, '\p{L}')) < 0.5 * word_chars) AS kept
FROM b
"""
