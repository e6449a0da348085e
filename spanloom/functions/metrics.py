"""Macro-F1 by label and model version, baselines, loss scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_rows(evaluation: DataFrame) -> DataFrame:
    """(model_version, sample_idx, label, expected, found) of an evaluation table."""
    zipped = F.arrays_zip("expected_labels", "found_labels")
    return evaluation.select("model_version", "sample_idx", F.posexplode(zipped).alias("label", "z")).select(
        "model_version", "sample_idx", "label", F.col("z.expected_labels").cast("int").alias("expected"), F.col("z.found_labels").cast("int").alias("found")
    )


def confusion(expected: Column, found: Column) -> list[Column]:
    hit = lambda e, f: F.count_if((expected == e) & (found == f))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")]


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 of the classes 0 and 1 that are expected or found at all."""
    one = F.try_divide(2 * tp, 2 * tp + fp + fn)
    zero = F.try_divide(2 * tn, 2 * tn + fp + fn)
    n = one.isNotNull().cast("int") + zero.isNotNull().cast("int")
    return F.try_divide(F.coalesce(one, F.lit(0.0)) + F.coalesce(zero, F.lit(0.0)), n)


def f1_by_label(rows: DataFrame, keys: tuple[str, ...] = ("model_version", "label")) -> DataFrame:
    """(keys, f1, support): ``rows`` has expected and found."""
    counts = rows.groupBy(*keys).agg(*confusion(F.col("expected"), F.col("found")))
    f1 = macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.select(*keys, f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n"))


def f1_by_version(rows: DataFrame, weight: str = "support", leave_out: list[int] | None = None) -> DataFrame:
    """(model_version, weighted_f1, min_f1, max_f1) over labels; no weight at all gives null.

    ``weight`` is ``support`` or ``uniform``; ``leave_out`` holds labels to skip, such as the neutral ones.
    """
    labels = f1_by_label(rows)
    if leave_out:
        labels = labels.where(~F.col("label").isin(leave_out))
    w = F.col("support") if weight == "support" else F.col("n")
    return labels.groupBy("model_version").agg(
        F.try_divide(F.sum(F.col("f1") * w), F.sum(w)).alias("weighted_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1")
    )


def class_balance(rows: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """(keys, share_0, share_1) of expected values 0 and 1; halves if there is neither."""
    zero, one = F.count_if(F.col("expected") == 0), F.count_if(F.col("expected") == 1)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.try_divide(zero, zero + one), F.lit(0.5)).alias("share_0"), F.coalesce(F.try_divide(one, zero + one), F.lit(0.5)).alias("share_1")
    )


def f1_baseline(rows: DataFrame) -> DataFrame:
    """(label, majority, f1, support) on the lowest version: what the more frequent class, or 0 on a tie, would score."""
    lowest = rows.join(F.broadcast(rows.agg(F.min("model_version").alias("model_version"))), "model_version")
    counts = lowest.groupBy("label").agg(F.count_if(F.col("expected") == 1).alias("ones"), F.count_if(F.col("expected") == 0).alias("zeros"))
    ones, zeros, none = F.col("ones"), F.col("zeros"), F.lit(0).cast("long")
    says_one = macro_f1(ones, zeros, none, none)
    says_zero = macro_f1(none, none, ones, zeros)
    return counts.select(
        "label", (ones > zeros).cast("int").alias("majority"), F.when(ones > zeros, says_one).otherwise(says_zero).alias("f1"), ones.alias("support")
    )


def loss_scaling(counts: DataFrame, max_boost: float) -> DataFrame:
    """(label, scale): ``counts`` has label, n and f1. Rare labels that score badly weigh more; none seen gives 1.

    The table has one row a label.
    """
    most = counts.agg(F.max("n").alias("most"))
    inverse = counts.join(F.broadcast(most), F.lit(True)).withColumn(
        "inv", 1 / F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.coalesce(F.try_divide(F.col("n"), F.col("most")), F.lit(1.0))))
    )
    bounds = inverse.agg(F.min("inv").alias("low"), F.max("inv").alias("high"))
    share = F.coalesce(F.try_divide(F.col("inv") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return inverse.join(F.broadcast(bounds), F.lit(True)).select("label", (share * max_boost * (1 - F.col("f1")) + 1).alias("scale"))
