"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Every vector is
posted, with the pivot's place in that order, in the inverted files of its first
``PREFIX`` pivots; a query walks the files of its own pivots and sums what each
posting takes off the footrule distance of the two orders. Vectors within a
footrule radius, and the closest few by footrule in any case, are reranked by
their inner product in double precision.

Inner products are made comparable by distance in the usual way: indexed vectors
get one more coordinate, so that all have the norm of the longest, and queries a
zero there. Pivots and radius are fitted on at most ``SAMPLE`` vectors (smallest
hash of the id first), the radius as the one that would find ``TARGET`` of the true
neighbours in the sample; every vector is indexed, and nothing caps how many
candidates the radius admits.

Equal vectors are indexed once, with the smallest ids that can still be among
a query's nearest, and equal queries are searched once. Queries and index meet in
blocks of bounded size.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; rows without id neither; ties go to
the smaller id; repeated rows count once; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import read
from spanloom.session import shared_dir

PIVOTS, PREFIX, SAMPLE, PROBES, TARGET = 512, 64, 8192, 256, 0.975
INDEX_BLOCK, QUERY_BLOCK, NEAREST, QUERY_STEP = 8192, 2048, 20, 20


@dataclass(frozen=True)
class Index:
    pivots: np.ndarray
    norm: float
    prefix: int
    least: int  # of the footrule taken off, for a candidate


def usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def extended(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))[:, None]])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first, ties to the smaller number."""
    near = -(x @ pivots.T)
    if prefix < near.shape[1]:
        bound = np.partition(near, prefix - 1, axis=1)[:, prefix - 1 : prefix]
        near[near > bound] = np.inf
    return np.argsort(near, axis=1, kind="stable")[:, :prefix].astype("<u2")


class Postings:
    """The inverted files of a block of orders."""

    def __init__(self, block: np.ndarray, pivots: int):
        self.n, self.prefix = block.shape
        flat = block.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = (by_pivot // self.prefix).astype(np.int32)
        self.places = (by_pivot % self.prefix).astype(np.int32)
        self.ends = np.cumsum(np.bincount(flat, minlength=pivots)).tolist()
        at = np.arange(self.prefix)
        self.credits = (self.prefix - np.maximum(at[:, None], at[None, :])).astype(np.float64)

    def taken_off(self, order: np.ndarray) -> np.ndarray:
        """Half of what shared pivots take off the largest footrule, for each row."""
        files = [slice(self.ends[p - 1] if p else 0, self.ends[p]) for p in order]
        rows = np.concatenate([self.rows[f] for f in files])
        credit = np.concatenate([self.credits[place][self.places[f]] for place, f in enumerate(files)])
        return np.bincount(rows, weights=credit, minlength=self.n).astype(np.int64)


def fit(sample: np.ndarray, norm: float, pivots: int = PIVOTS, prefix: int = PREFIX) -> Index:
    """Pivots and radius from a sample of distinct vectors."""
    pivots = min(pivots, max(1, len(sample) // 2))
    prefix = min(prefix, pivots)
    x = extended(sample, norm)
    pivot_rows = x[:pivots]
    pivot_rows = pivot_rows / np.linalg.norm(pivot_rows, axis=1, keepdims=True)
    postings = Postings(orders(x, pivot_rows, prefix), pivots)
    others = np.arange(pivots, len(x)) if len(x) > pivots else np.arange(len(x))  # a pivot would find itself too well
    probes = others[:PROBES]
    asked = orders(np.hstack([sample[probes], np.zeros((len(probes), 1))]), pivot_rows, prefix)
    seen = []
    for probe, order in zip(probes, asked):
        score = sample @ sample[probe]
        score[probe] = -np.inf
        k = min(NEAREST, len(x) - 1)
        if k:
            seen.append(postings.taken_off(order)[np.argpartition(-score, k - 1)[:k]])
    found = np.sort(np.concatenate(seen)) if seen else np.zeros(1)
    return Index(pivot_rows, norm, prefix, int(found[int((1 - TARGET) * len(found))]))


def search_block(index: Index, ids: list, x: np.ndarray, order: np.ndarray, q: np.ndarray, q_order: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query row, index row, score): for each query the rows that can be among its ``k`` nearest."""
    postings = Postings(order, len(index.pivots))
    for j in range(len(q)):
        off = postings.taken_off(q_order[j])
        rows = np.flatnonzero(off >= index.least)
        if len(rows) < 2 * k:
            rows = np.argsort(-off, kind="stable")[: 2 * k]
        score = x[rows] @ q[j]
        if len(rows) > k:
            bound = np.partition(score, len(rows) - k)[len(rows) - k]
            keep = score >= bound
            rows, score = rows[keep], score[keep]
        best = sorted(zip(-score, (ids[r] for r in rows), rows))[:k]
        yield from ((j, int(r), float(-s)) for s, _, r in best)


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row where ``queries`` holds."""
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    dims = usual.first()
    result = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == dims.n)
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    distinct = (
        rows.select("id", "v", "asked", place.alias("place"))
        .where(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumn("key", F.element_at("ids", 1))
        .checkpoint()
    )
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, square = distinct.agg(F.count(F.lit(1)), F.max(squares)).first()
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()
    index = fit(np.array([r.v for r in sample], dtype=np.float64), float(np.sqrt(square)))

    asked = rows.where("asked").select(F.col("id").alias("query_id"), "v").distinct()
    asked = asked.join(distinct.select("v", "key"), "v").select("query_id", "key", "v").checkpoint()
    searched = asked.groupBy("key").agg(F.first("v").alias("v"))
    n_index = max(1, -(-n // INDEX_BLOCK))
    n_query = max(1, -(-searched.count() // QUERY_BLOCK))
    block = lambda count, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def with_order(query: bool):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(batch.schema.get_field_index("v")))
                x = np.hstack([x, np.zeros((len(x), 1))]) if query else extended(x, index.norm)
                order = orders(x, index.pivots, index.prefix)
                yield batch.append_column("o", pa.array([row.tobytes() for row in order], pa.binary()))

        return add

    vector = distinct.schema["v"].dataType.simpleString()
    posted = distinct.select("key", "ids", "v").mapInArrow(with_order(False), f"key long, ids array<long>, v {vector}, o binary")
    posted = posted.withColumn("i", block(n_index, 1)).withColumn("j", every(n_query))
    asking = searched.select("key", "v").mapInArrow(with_order(True), f"key long, v {vector}, o binary")
    asking = asking.withColumn("j", block(n_query, 2)).withColumn("i", every(n_index))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            unpack = lambda t: np.frombuffer(b"".join(t.column("o").to_pylist()), dtype="<u2").reshape(t.num_rows, -1)
            keys, asks, ids = left.column("key").to_pylist(), right.column("key").to_pylist(), left.column("ids").to_pylist()
            for j, r, score in search_block(index, keys, _matrix(left.column("v")), unpack(left), _matrix(right.column("v")), unpack(right), k + 1):
                for value in ids[r]:
                    out[0].append(asks[j])
                    out[1].append(value)
                    out[2].append(score)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["key", "vec_id", "score"])

    hits = posted.groupBy("i", "j").cogroup(asking.groupBy("i", "j")).applyInArrow(meet, "key long, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = asked.select("query_id", "key").join(hits, "key").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_permutation_index(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % QUERY_STEP == 0)
