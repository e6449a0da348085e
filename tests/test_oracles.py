"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from spanloom.operators import split
from spanloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    value = lambda x: round(float(x), 6) if isinstance(x, float) or hasattr(x, "quantize") else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal([tuple(r) for r in found.collect()], found.columns) == normal(cursor.fetchall(), columns)


def test_encoder_evaluation_covers_every_sample(spark):
    found = registry.QUERIES["encoder_evaluation"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(found) == len({(r.model_version, r.sample_idx) for r in found}) == 2 * n
    assert all(r.found_labels.count("1.0") == 2 for r in found)


def test_gradients_converge(spark):
    found = {r.steps: r for r in registry.QUERIES["gradient_convergence"](spark, SF).collect()}
    assert set(found) == {20, 40} and found[40].median_change < found[20].median_change < 1
    assert all(r.min_change <= r.median_change <= r.max_change for r in found.values())


def test_exact_split_fills_its_folds(spark):
    found = registry.QUERIES["stratified_split_exact"](spark, SF).groupBy("fold").count().collect()
    n = spark.read.parquet(f"{SF}/labels.parquet").count()
    assert [c for _, c in sorted(map(tuple, found))] == split.fold_counts(n, [0.9, 0.1])
