"""Orders of samples by epoch, and batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ingest import with_row_index


def epoch_key(seed: int, epoch: int, index: Column) -> Column:
    """md5 of seed, epoch and index: any epoch's order can be had without those before."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(max(epoch, 0))), index.cast("string")))


def permuted(samples: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Adds perm_pos, the sample's place in the epoch's order."""
    keyed = samples.withColumn("_key", epoch_key(seed, epoch, F.col("sample_idx")))
    return with_row_index(keyed, ["_key", "sample_idx"], "perm_pos").drop("_key")


def exact_order(n: int, seed: int = 0, epoch: int = 0) -> np.ndarray:
    """The order of a PCG64 generator: shuffled twice at first, once more for each epoch."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = np.arange(n)
    for _ in range(2 + max(epoch, 0)):
        rng.shuffle(order)
    return order


def batched(samples: DataFrame, batch: int = 4) -> DataFrame:
    return samples.withColumn("batch_id", F.floor(F.col("perm_pos") / batch))


def loaded(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples with their window: vectors where there are any, else token ids."""
    return samples.join(windows.select("enc_id", "n", "embeds", "token_ids"), "enc_id").withColumn(
        "by_vectors", F.col("embeds").isNotNull()
    )
