"""SimHash near-duplicates by anchor-point covering.

A fingerprint has two halves of 32 bits; of two fingerprints at 3 or fewer
differing bits one half differs in at most one. The anchors of a half are the
words of the Hamming code of length 31 (its 32nd bit is left out of the anchor):
a perfect code of covering radius 1. A fingerprint's home is the one anchor
within radius 1 of its half, and it is replicated to every anchor within
radius 1 + 1: one if the half is a code word, else 16. If x and y differ in at
most one bit of a half, x's home is among y's replicas, so homes meet replicas
anchor by anchor and are compared in full there. Equal fingerprints are merged
beforehand, so copies add no comparisons.

``near_copies`` decides by the measure itself: two texts are joined if their sets of
five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come from two
sides, and every one is counted shingle by shingle before it joins anything:

* fingerprints of the five-word shingles, linked at the same anchors, join the closest copies;
* a fingerprint can't promise a similarity of 0.8, so prefixes complete the links: with all
  shingles in one order, sets x and y at 0.8 share ``a = ceil(4 (|x| + |y|) / 9)`` of them, hence
  one among the first |x| - a + 1 of x and |y| - a + 1 of y. None is lost. The order
  takes shingles that a sample shows to be common last, which decides the cost alone:
  texts meet in what is rare about them, not in a passage that they share.

Before all pairs of a shingle are compared, rounds compare each text with the most
central text of its shingles, which joins a large group of copies in as many
comparisons as it has texts; pairs that verified links have joined already are not compared again.
A parity bitmap (its differing bits never outnumber the differing shingles) drops pairs
that cannot reach 0.8 before their texts are read; it has as many bits as the set has shingles, or more.

Defined results: null and empty texts have no shingles and fingerprint zero,
which links like any other; a row without doc_id gets a fingerprint and no
component; repeated rows share one; an empty table gives no rows. For ``near_copies``
texts without words are copies of each other, and those of fewer than five words have one shingle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import read, small_batches
from spanloom.operators.components import connected_components, merging
from spanloom.session import Scratch, shared_dir, written

SEED, SHINGLE, THRESHOLD, CODE_BITS = 42, 3, 3, 31
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 16
#: Similarity 4 / 5 of the sets of five-word shingles, in whole numbers; bits of the bitmap.
COPY_SHINGLE, PARITY_BITS = 5, 1024
#: For the cost alone: one text in so many is sampled for common shingles, shingles kept, pairs a posting that are compared without a further round, rounds, comparisons a text in a round.
EVERY, COMMON, LEAST, PAIRS, ROUNDS, TRIES = 8, 1 << 18, 2, 0.1, 4, 2


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, in order; of all words if there are fewer; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(found) - size + 1)
    joined, ends, at = b" ".join(found), [], 0
    for w in found:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[min(size, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), dtype=np.uint64, count=n)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes, as an unsigned integer: a bit is 1 if set in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        part = hashes[i : i + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned integer."""
    return majority_bits(shingle_hashes(text, SHINGLE))


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in text], dtype=np.uint64).astype(np.int64))


def copy_shingles(text: str | None) -> np.ndarray:
    """The distinct five-word shingles, ascending."""
    return np.unique(shingle_hashes(text, COPY_SHINGLE))


@F.pandas_udf(T.ArrayType(T.LongType()))
def copy_shingle_set(text: pd.Series) -> pd.Series:
    return pd.Series([copy_shingles(t).astype(np.int64) for t in text])


def set_marks(common: dict[int, int]):
    """UDF of a text's set: node (its digest), n, fp, how central it is (the counts of its common shingles), the prefix by (count among the common ones, hash) and the parity bitmap."""
    known = np.array(sorted(common), dtype=np.int64)
    counts = np.array([common[k] for k in known.tolist()], dtype=np.int64)

    @F.pandas_udf("node long, n int, fp long, central long, prefix array<long>, bits array<long>")
    def marks(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            found = copy_shingles(t)
            n, signed = len(found), found.astype(np.int64)
            weight = np.zeros(n, dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                weight = np.where(known[at] == signed, counts[at], 0)
            first = signed[np.lexsort((signed, weight))[: n - (4 * n + 4) // 5 + 1]]
            width = max(PARITY_BITS, 1 << (n - 1).bit_length()) if n else PARITY_BITS
            odd = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
            node = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)
            fp = np.uint64(majority_bits(found)).astype(np.int64)
            rows.append((node, n, fp, int(weight.sum()), first, bits))
        return pd.DataFrame(rows, columns=["node", "n", "fp", "central", "prefix", "bits"])

    return marks


@F.pandas_udf(T.BooleanType())
def are_copies(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the Jaccard similarity is 4 / 5 or more."""
    last, kept, out = None, None, []
    for s, t in zip(a, b):
        if kept is None or t != last:
            last, kept = t, copy_shingles(t)
        other = copy_shingles(s)
        shared = len(np.intersect1d(other, kept, assume_unique=True))
        out.append(9 * shared >= 4 * (len(other) + len(kept)))
    return pd.Series(out, dtype=bool)


def _errors() -> list[list[int]]:
    """By syndrome: the errors of weight 2 or less that lead from a half to an anchor."""
    size = CODE_BITS + 1
    table = [[0]]
    for s in range(1, size):
        table.append([1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, size) if i < i ^ s])
    return table


def _syndrome(half: Column) -> Column:
    """XOR of the places, from 1, of the set bits among the first 31."""
    total = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> j & 1)
        total = total + (F.bit_count(half.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    return total


_WORD = (1 << CODE_BITS) - 1


def _anchors(rows: DataFrame) -> DataFrame:
    """Adds s, the syndrome, to rows with side and half."""
    return rows.withColumn("s", _syndrome(F.col("half")))


def _key(half: Column) -> Column:
    return F.shiftleft("side", 32).bitwiseOR(half).alias("anchor")


def _replicas() -> Column:
    """The errors that lead from a half of syndrome s to the anchors within radius plus threshold."""
    table = F.array(*[F.array(*[F.lit(e).cast("long") for e in row]) for row in _errors()])
    return F.element_at(table, F.col("s").cast("int") + 1)


def links(fps: DataFrame) -> DataFrame:
    """(u, v) ids of distinct fingerprints at 3 or fewer differing bits; ``fps``: fp (unique), node."""
    word = F.lit(_WORD).cast("long")
    side = lambda n, half: F.struct(F.lit(n).cast("long").alias("side"), half.bitwiseAND(word).alias("half"))
    pair = F.array(side(0, F.col("fp")), side(1, F.shiftrightunsigned("fp", 32)))
    halves = _anchors(fps.select("node", "fp", F.inline(pair)))
    home = F.when(F.col("s") == 0, F.col("half")).otherwise(
        F.col("half").bitwiseXOR(F.expr("shiftleft(1L, cast(greatest(s - 1, 0) AS INT))"))
    )
    homes = halves.select(_key(home), "node", "fp")
    replicas = halves.select("side", "half", F.col("node").alias("node2"), F.col("fp").alias("fp2"), F.explode(_replicas()).alias("e"))
    replicas = replicas.select(_key(F.col("half").bitwiseXOR(F.col("e"))), "node2", "fp2")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= THRESHOLD
    return homes.join(merging(replicas), "anchor").where((F.col("fp") < F.col("fp2")) & near).select(F.col("node").alias("u"), F.col("node2").alias("v"))


def common_shingles(texts: DataFrame) -> dict[int, int]:
    """Counts of the shingles most frequent in a share of the distinct texts, ``COMMON`` at most; ``texts``: text, h."""
    sample = texts.where(F.pmod("h", F.lit(EVERY)) == 0).dropDuplicates(["h"])
    found = sample.select(F.explode(copy_shingle_set("text")).alias("key")).groupBy("key").count().where(F.col("count") >= LEAST)
    most = found.orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    return dict(zip(most["key"].to_pylist(), most["count"].to_pylist()))


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _meet(x: Column, y: Column) -> Column:
    """Whether a shingle at places ``pos`` of two sets of ``n`` is in the prefixes that a pair of these sizes needs."""
    shared = F.ceil((x.n + y.n) * 4 / 9)
    return _fits(x.n, y.n) & (x.pos + shared <= x.n) & (y.pos + shared <= y.n)


def _halved(bits: Column) -> Column:
    """The bitmap of half the size: a place's bit is that of its number modulo the size."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _apart(a: Column, b: Column) -> Column:
    """Differing bits of two bitmaps; sizes that fit differ by one doubling at most."""
    a, b = F.when(F.size(a) > F.size(b), _halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), _halved(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) of nodes whose similarity is 4 / 5 or more; ``sets``: node, n, bits, h; ``texts``: text, h."""
    left, right = (sets.select(*[F.col(c).alias(c + side) for c in ("node", "n", "bits", "h")]) for side in "12")
    both = pairs.join(merging(left), F.col("u") == F.col("node1")).join(merging(right), F.col("v") == F.col("node2")).where(_fits(F.col("n1"), F.col("n2")))
    near = both.where(9 * _apart(F.col("bits1"), F.col("bits2")) <= F.col("n1") + F.col("n2"))
    near = scratch.written(near.select("u", "v", "h1", "h2"), "near")
    needed = near.select(F.col("h1").alias("h")).union(near.select("h2")).distinct()
    held = texts.join(merging(needed), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    first, second = held.select(F.col("h").alias("h1"), F.col("text").alias("a")), held.select(F.col("h").alias("h2"), F.col("text").alias("b"))
    found = near.join(merging(first), "h1").join(merging(second), "h2")
    return scratch.written(found.where(are_copies("a", "b")).select("u", "v"), "links")


def anchor_pairs(sets: DataFrame) -> DataFrame:
    """(u, v): nodes of equal fingerprints, each with the least, and the least nodes of fingerprints at 3 or fewer bits; ``sets``: node, fp."""
    fps = sets.groupBy("fp").agg(F.min("node").alias("node"))
    equal = sets.join(merging(fps.withColumnRenamed("node", "least")), "fp").where("node > least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    return equal.unionByName(links(fps))


def _every_pair(now: DataFrame, at: DataFrame) -> DataFrame:
    """(u, v) of different components at each shingle, both within the prefixes that the pair needs."""
    units = now.join(merging(at.select("key")), "key", "left_semi").select("key", F.struct("node", "n", "pos", "component").alias("x"))
    both = units.join(merging(units.withColumnRenamed("x", "y")), "key")
    pairs = both.where((F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _meet(F.col("x"), F.col("y")))
    return pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def _central_pairs(now: DataFrame, at: DataFrame) -> DataFrame:
    """(u, v): each text with the few most central texts of other components that it meets most often."""
    seen = now.select("key", "component", F.struct("node", "n", "pos").alias("x")).join(merging(at.select("key", "one", "two")), "key")
    seen = seen.withColumn("y", F.when(F.col("one.component") != F.col("component"), F.col("one")).otherwise(F.col("two")))
    seen = seen.where((F.col("y.component") != F.col("component")) & _meet(F.col("x"), F.col("y")))
    most = seen.groupBy(F.col("x.node").alias("node"), F.col("y.node").alias("v")).count()
    most = most.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "v")))
    return most.where(F.col("place") <= TRIES).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))


def copy_links(postings: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component): components of all links at 4 / 5 or more; ``postings``: key, node, n, pos, central."""
    repeated = postings.groupBy("key").count().where("count > 1").select("key")
    scratch = Scratch(postings.sparkSession)
    shared = scratch.written(postings.join(merging(repeated), "key"), "postings")
    size, before, edges, candidates = shared.count(), None, None, anchor_pairs(sets)
    now = shared.withColumn("component", F.col("node"))
    for turn in range(ROUNDS + 1):
        best = F.struct("central", F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "pos", "component")
        met = now.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.max(best).alias("best"))
        other = F.max(F.struct(F.xxhash64("component", F.lit(turn)), "best"))["best"]
        sums = F.sum("rows").alias("all"), F.sum(F.col("rows") * F.col("rows")).alias("own")
        at = met.groupBy("key").agg(*sums, F.max("best").alias("one"), other.alias("two"), F.count(F.lit(1)).alias("components"))
        at = scratch.written(at.where("components > 1"), "meetings")
        left = at.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()[0] or 0.0
        last = left <= PAIRS * size or turn == ROUNDS or (before is not None and left > 0.5 * before)
        before = left
        candidates = candidates.unionByName((_every_pair if last else _central_pairs)(now, at))
        found = verified(candidates.distinct(), sets, texts, scratch)
        edges = found if edges is None else edges.unionByName(found)
        joined = connected_components(edges)
        if last:
            scratch.clear()  # components are checkpointed
            return joined
        now = shared.join(merging(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
        candidates = joined.select(F.col("node").alias("u"), F.col("component").alias("v")).where("false")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared_dir(spark)
    marked = docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")).checkpoint()
    fps = marked.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node"))
    joined = connected_components(links(fps))
    component = fps.join(merging(joined), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    found = marked.join(merging(component), "fp", "left")
    return found.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def _copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, component) for every row: h is the digest of the text, component a number that near copies share."""
    spark = docs.sparkSession
    small_batches(spark)
    shared_dir(spark)
    texts = docs.select(F.col(text_col).alias("text"), _digest(text_col).alias("h"))
    marks = set_marks(common_shingles(texts))
    rows = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("h"), marks(F.col(text_col)).alias("m"))
    marked = written(rows.select("id", "h", "m.*"), "marks")
    one = [F.first(c).alias(c) for c in ("n", "fp", "bits")]
    sets = written(marked.groupBy("node").agg(*one, F.min("h").alias("h")), "sets")
    postings = marked.select("node", "n", "central", "prefix").dropDuplicates(["node"]).select("node", "n", "central", F.posexplode("prefix").alias("pos", "key"))
    joined = copy_links(postings, sets, texts)
    return marked.select("id", "h", "node").join(merging(joined), "node", "left").select("id", "h", F.coalesce("component", "node").alias("component"))


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id), the smallest id of the texts joined at 0.8 or more; a row without id has no component."""
    rows = _copies(docs, id_col, text_col).checkpoint()
    least = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(merging(least), "component").select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one row of each group of near copies: of the smallest id, then text digest; a row without id comes after all others.

    Rows are told apart by id and text digest, so different texts under one id are judged each for itself.
    """
    rows = _copies(docs, id_col, text_col)
    counted = rows.groupBy("component", "id", "h").count()
    first = counted.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "count")).alias("best"))
    best = written(first.select(F.col("best.id").alias("id2"), F.col("best.h").alias("h2"), F.col("best.count").alias("rows")), "kept")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), _digest(text_col).alias("h"))
    kept = keyed.join(merging(best), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left_semi")
    again = not best.where("rows > 1").isEmpty()
    return (kept.dropDuplicates(["id", "h"]) if again else kept).select("row.*")


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
