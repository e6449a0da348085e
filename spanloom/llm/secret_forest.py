"""Secret scans: a random forest that removes false positives from candidates.

Candidates are what the pattern ``CANDIDATE`` finds: dotted tokens, values of six characters or more
that a word naming a secret is assigned, and runs of twelve or more key-like characters;
of the runs, those with a digit, a known key prefix or case that changes often.
Features of a candidate: its length, character shares and transitions between
classes, how much of it a dictionary covers, whether it lies on a path, and the
words next to it. The forest is grown from labelled findings, and is then an
expression of nested CASEs: scanning runs in the row on built-in functions alone,
and shuffles nothing. Labelled findings are a parameter; the default set is
generated by rule from a seed (``LABELLED`` rows at most are used).

Places come from the construction: the pattern splits the text into gaps and matches,
whose lengths add up, so no value is searched for again and a long text takes one pass.

Defined results: null and empty texts have no findings; very long texts are scanned whole;
offsets count code points from 0; a candidate that occurs twice is two findings; repeated rows are scanned
alike; an empty table gives no rows; other columns pass through, but for
those of the results' names.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import let, read, without

LABELLED, TREES, DEPTH, LEAF, SEED, THRESHOLD, AROUND = 3000, 15, 6, 4, 7, 0.5, 48
#: Public prefixes of issued keys, words that name a secret, words that name a harmless value, filler.
PREFIX = r"(^|[-_+/])(AKIA|ASIA|gh[pousr]_|sk[-_]|rk_|xox[abprs]-|glpat-|npm_|eyJ|AIza|SG\.)"
_NAMES = r"secret|passw(?:or)?d|passwd|pwd|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private"
KEY_WORDS = rf"(?i)({_NAMES})\W{{0,4}}$"
ASSIGNED = rf"(?i:{_NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
DOTTED = r"(?:SG|eyJ[A-Za-z0-9_\-]{8,})(?:\.[A-Za-z0-9_\-]{12,}){1,2}"
CANDIDATE = rf"{DOTTED}|(?<=[=:\"'\s])(?<=[=:]\s{{0,2}}[\"']?)(?<={ASSIGNED})[^\s\"',;<>()]{{6,}}|[A-Za-z0-9+/_\-]{{12,}}"
#: Fixed pattern: runs that may be keys by themselves.
KEY_LIKE = r"[0-9]|([a-z][A-Z].*){3}"
PLAIN_WORDS = r"(?i)(commit|sha\d*|md5|digest|checksum|uuid|guid|version|build|revision|hash|etag|isbn|card|order|phone|id|ref)\W{0,4}$"
FILLER = r"(?i)(example|sample|placeholder|change_?me|your|dummy|test|x{4,}|1234|abcd|0{5,})"
DICTIONARY = (
    "the and ing ion ent that with this from have were which there their would about other after first under never where "
    "name user file data home page main node test time work list code image index config server client local public static "
    "ver ung lich keit heit eine sch ment tion que elle eau ado ando mente idad"
).split()


def features(cand: Column, before: Column, after: Column) -> Column:
    """A struct of doubles, in the order of ``NAMES``."""
    size = F.length(cand)
    share = lambda pattern: F.regexp_count(cand, F.lit(pattern)) / size
    flag = lambda condition: condition.cast("double")
    steps = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"
    left = F.length(F.regexp_replace(F.lower(cand), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    made = {
        "length": size.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "transitions": share(steps),
        "vowels": share("[aeiouAEIOU]"),
        "dictionary": 1 - left / size,
        "distinct": F.size(F.array_distinct(F.split(cand, ""))) / size,
        "hex": flag(cand.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "slashes": F.regexp_count(cand, F.lit("/")).cast("double"),
        "dashes": F.regexp_count(cand, F.lit("[-_]")).cast("double"),
        "prefix": flag(cand.rlike(PREFIX)),
        "others": share(r"[^A-Za-z0-9+/_\-]"),
        "dotted": flag(cand.rlike(f"^{DOTTED}$")),
        "on_path": flag(before.rlike(r"(\w/|\\|://\S*|@)$") | after.rlike(r"^(\.\w|@|/\w)")),
        "key_word": flag(before.rlike(KEY_WORDS)),
        "plain_word": flag(before.rlike(PLAIN_WORDS)),
        "assigned": flag(before.rlike(r"[=:]\s?[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "filler": flag(cand.rlike(FILLER)),
    }
    return F.struct(*[value.alias(name) for name, value in made.items()])


NAMES = (
    "length digits upper lower transitions vowels dictionary distinct hex slashes dashes prefix others dotted on_path key_word plain_word "
    "assigned quoted filler"
).split()


def labelled_findings(spark: SparkSession, rows: int = LABELLED, seed: int = SEED) -> DataFrame:
    """before, cand, after, label: findings labelled by the rule that made them."""
    rng = random.Random(seed)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, base64s, upper = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    word = lambda: "".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 4)))
    key = lambda: rng.choice(["token", "password", "secret", "api_key", "API-KEY", "access_key", "TOKEN", "passwd", "auth token", "client_secret"])
    sign = lambda: rng.choice(["=", " = ", ": ", ":", " ="])
    cased = lambda s: s.upper() if rng.random() < 0.25 else s
    any_secret = lambda: rng.choice([of(hexes, rng.choice([16, 18, 20, 24, 32, 40, 64])), of(base64s, rng.randint(16, 48)), of(upper, rng.randint(16, 40)), of(string.ascii_lowercase + string.digits, rng.randint(14, 40))])
    issued = lambda: rng.choice(["AKIA" + of(upper, 16), "ghp_" + of(string.ascii_letters + string.digits, 36), "sk-" + of(base64s[:62], 32), "xoxb-" + of("0123456789", 11) + "-" + of(base64s[:62], 20), "AIza" + of(base64s[:62], 35)])

    def one() -> tuple:
        kind = rng.randrange(21)
        text, end = f"{word()} {word()} ", f" {word()} {word()}"
        if kind < 3:
            quote = rng.choice(['"', "'", ""])
            return f"{text}{key()}{sign()}{quote}", cased(any_secret()), quote + end, 1
        if kind == 3:
            return f"{text}{key()} ", any_secret(), end, 1
        if kind < 7:
            return text + rng.choice(["", key() + sign(), '"']), issued(), rng.choice([end, '"', "", "," + end]), 1
        if kind == 7:
            return f"{text}{rng.choice(['commit', 'sha256:', 'md5 ', 'checksum: ', 'digest=', 'revision '])} ", of(hexes, rng.choice([32, 40, 64])), end, 0
        if kind == 8:
            return f"{text}{rng.choice(['id ', 'uuid: ', ''])}", "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12)), end, 0
        if kind == 9:
            return f"{text}{rng.choice(['/', 'src/', 'https://', ''])}", "/".join(word() for _ in range(rng.randint(2, 4))) + str(rng.randrange(99)), rng.choice([".py", ".html", end]), 0
        if kind == 10:
            return text, of("0123456789", rng.randint(12, 19)), end, 0
        if kind == 11:
            return text, cased(word() + rng.choice(["-", "_", ""]) + word() + of("0123456789", rng.randint(1, 4))), end, 0
        if kind == 12:
            filler = rng.choice(["your_token_here_123", "xxxxxxxxxxxx1234", "changeme12345678", "EXAMPLEKEY1234567", "000000000000", "placeholder-0001", "test1234test1234"])
            return f"{text}{key()}{sign()}", filler, end, 0
        if kind == 13:
            return f"{text}{word()}{rng.choice(['.', '@'])}", word() + of("0123456789", 2), rng.choice(["@" + word(), ".com", end]), 0
        if kind == 14:
            return text, of(hexes, rng.choice([16, 32, 40, 64])), end, 0
        if kind == 15:
            strong = of(string.ascii_letters + string.digits + "!$%&#@.", rng.randint(8, 20))
            quote = rng.choice(['"', "'", ""])
            return f"{text}{key()}{sign()}{quote}", rng.choice([strong, of(string.ascii_letters, rng.randint(14, 32))]), quote + end, 1
        if kind == 16:
            phrase = "".join(of(string.ascii_lowercase, rng.randint(3, 7)) for _ in range(rng.randint(3, 5)))
            quote = rng.choice(['"', "'"])
            return f"{text}{key()}{rng.choice(['=', ' = '])}{quote}", phrase, quote + end, 1
        if kind == 17:
            piece = lambda n: of(string.ascii_letters + string.digits + "_-", n)
            dotted = rng.choice(["SG." + piece(22) + "." + piece(43), "eyJ" + piece(17) + "." + piece(rng.randint(20, 60)) + "." + piece(43)])
            return text + rng.choice(["", key() + sign(), '"', "Bearer "]), dotted, rng.choice([end, '"', ","]), 1
        if kind == 18:
            plain = rng.choice([word(), of(string.ascii_lowercase, rng.randint(6, 11)), word() + rng.choice([".", "!", "?"])])
            return f"{text}{key()}{rng.choice([': ', ' : ', ':'])}", plain, end, 0
        if kind == 19:
            plain = rng.choice(["required", "string", "None,", "null", "undefined", "getenv(", "os.environ", "${" + word() + "}", "self." + word(), word() + "()"])
            return f"{text}{key()}{sign()}", plain, rng.choice([end, "[", ")"]), 0
        if kind == 20:
            camel = word() + "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
            return text, rng.choice([camel, camel + str(rng.randrange(10))]), end, 0
        return text, of("0123456789", 4) + "-" + of("0123456789", 2) + "-" + of("0123456789", 2) + "-" + word(), end, 0

    return spark.createDataFrame([one() for _ in range(rows)], "before string, cand string, after string, label int")


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees as nested tuples (feature, threshold, left, right), leaves as shares of label 1."""
    rng = np.random.default_rng(seed)
    tried = max(3, int(np.sqrt(x.shape[1])))

    def node(rows: np.ndarray, left_depth: int):
        here = y[rows]
        if left_depth == 0 or len(rows) < 2 * LEAF or here.min() == here.max():
            return round(float(here.mean()), 4)
        best = None
        for f in rng.choice(x.shape[1], tried, replace=False):
            values = x[rows, f]
            for cut in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 12))):
                low = values <= cut
                n = int(low.sum())
                if n < LEAF or len(rows) - n < LEAF:
                    continue
                p, q = here[low].mean(), here[~low].mean()
                impurity = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, int(f), float(cut), low)
        if best is None:
            return round(float(here.mean()), 4)
        _, f, cut, low = best
        return f, cut, node(rows[low], left_depth - 1), node(rows[~low], left_depth - 1)

    return [node(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest_score(forest: list, made: Column) -> Column:
    def tree(at) -> Column:
        if isinstance(at, float):
            return F.lit(at)
        f, cut, low, high = at
        return F.when(made.getField(NAMES[f]) <= cut, tree(low)).otherwise(tree(high))

    total = F.lit(0.0)
    for at in forest:
        total = total + tree(at)
    return total / len(forest)


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> list:
    labelled = (labelled if labelled is not None else labelled_findings(spark)).limit(LABELLED)
    rows = labelled.select(features(F.col("cand"), F.col("before"), F.col("after")).alias("f"), "label").collect()
    return grown(np.array([list(r.f) for r in rows]), np.array([r.label for r in rows], dtype=float))


def _parts(text: Column) -> Column:
    """gaps and cands: the text is the first gap, the first match, the second gap, and so on."""
    return F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("cands"))


def _findings(parts: Column, forest: list) -> Column:
    """Array of (run, start, length, score) of the candidates; ``run`` is the match's number."""
    empty = F.array().cast("array<struct<run:int,at:int,cand:string,before:string>>")
    key_value = rf"(?:{ASSIGNED})$"

    def step(acc: Column, c: Column) -> Column:
        gap = F.get(parts.gaps, acc.run)

        def placed(here: Column) -> Column:
            found = F.array(F.struct(acc.run.alias("run"), here.at.alias("at"), c.alias("cand"), here.before.alias("before")))
            fits = c.rlike(KEY_LIKE) | c.rlike(PREFIX) | here.before.rlike(key_value)
            return F.struct(
                (acc.run + 1).alias("run"),
                (here.at + F.length(c)).alias("at"),
                F.right(F.concat(here.before, c), F.lit(AROUND)).alias("before"),
                F.when(fits, F.concat(acc.found, found)).otherwise(acc.found).alias("found"),
            )

        return let(F.struct((acc.at + F.length(gap)).alias("at"), F.right(F.concat(acc.before, gap), F.lit(AROUND)).alias("before")), placed)

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("at"), F.lit("").alias("before"), empty.alias("found"))

    def judged(x: Column) -> Column:
        after = F.left(F.concat(F.get(parts.gaps, x.run + 1), F.coalesce(F.get(parts.cands, x.run + 1), F.lit(""))), F.lit(AROUND))
        score = let(features(x.cand, x.before, after), lambda made: forest_score(forest, made))
        return F.struct(x.run.alias("run"), x["at"].alias("start"), F.length(x.cand).alias("length"), score.alias("score"))

    return F.transform(F.aggregate(parts.cands, start, step, lambda acc: acc.found), judged)


def findings(text: Column, forest: list) -> Column:
    """Array of (run, start, length, score) of a text's candidates."""
    return let(_parts(F.coalesce(text, F.lit(""))), lambda parts: _findings(parts, forest))


def scanned(docs: DataFrame, forest: list, text_col: str = "text") -> DataFrame:
    """One row a candidate: the row's columns, start, length, score and is_secret."""
    names = "start", "length", "score"
    made = F.transform(findings(F.col(text_col), forest), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    # The outer form: a filter on the number of findings would make them several times over.
    found = without(docs, *names, "is_secret").select("*", F.inline_outer(made)).where("length IS NOT NULL")
    return found.withColumn("is_secret", F.col("score") >= THRESHOLD)


def redacted(docs: DataFrame, forest: list, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The rows with every secret in their text replaced."""
    text = F.col(text_col)

    def masked(parts: Column) -> Column:
        def joined(secret: Column) -> Column:
            runs = F.transform(parts.cands, lambda c, i: F.when(F.array_contains(secret, i), F.lit(mask)).otherwise(c))
            whole = F.transform(parts.gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(runs, i), F.lit(""))))
            return F.when(F.size(secret) == 0, text).otherwise(F.array_join(whole, ""))

        secret = F.transform(F.filter(_findings(parts, forest), lambda s: s.score >= THRESHOLD), lambda s: s.run)
        return let(secret, joined)

    return docs.withColumn(text_col, F.when(text.isNotNull(), let(_parts(F.coalesce(text, F.lit(""))), masked)))


def op8_secret_forest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scanned(docs, fit(spark))
    value = F.substr("text", F.col("start") + 1, "length")
    return found.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
        F.sha2(value, 256).alias("value_sha256"), "score", "is_secret",
    )
