"""Catalogue of training checkpoints: lightning_logs/version_N/checkpoints/epoch=E-step=S.ckpt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """Checkpoints under a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ckpt").load(root)
    return parsed(files.select("path"))


def parsed(paths: DataFrame) -> DataFrame:
    """(version, epoch, step, path), numbers null where the path has none."""
    number = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("int")
    return paths.select(
        number(r"version_(\d+)/").alias("version"), number(r"epoch=(\d+)").alias("epoch"), number(r"step=(\d+)").alias("step"), "path"
    ).where("version IS NOT NULL")


def versions(catalog: DataFrame) -> DataFrame:
    """One row a version: the newest checkpoint by (epoch, step), nulls where there is none."""
    newest = F.max(F.struct("epoch", "step", "path"))
    return catalog.groupBy("version").agg(newest.alias("c")).select("version", "c.epoch", "c.step", "c.path").orderBy("version")


def with_checkpoints(catalog: DataFrame) -> DataFrame:
    """The versions that have a checkpoint."""
    return catalog.where("epoch IS NOT NULL").select("version").distinct().orderBy("version")


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version_{version}"


def checkpoint_path(catalog: DataFrame, version: int) -> str | None:
    """The newest checkpoint of a version, none if it has none."""
    found = versions(catalog.where((F.col("version") == version) & F.col("epoch").isNotNull())).first()
    return found.path if found else None


def last_version(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.max("version").alias("version"))


def cumulative_epochs(catalog: DataFrame, assumed: int | None = None) -> DataFrame:
    """(version, last_epoch): epochs of all versions before and its own last epoch.

    A version without a checkpoint counts as ``assumed`` epochs; without that it is an error. The window runs
    over one row a version.
    """
    missing = F.lit(assumed) if assumed is not None else F.raise_error(F.lit("a version has no checkpoint")).cast("int")
    before = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    ran = F.coalesce(F.col("epoch") + 1, missing)
    total = F.coalesce(F.sum(ran).over(before), F.lit(0)) + F.coalesce("epoch", F.lit(0))
    return versions(catalog).select("version", total.cast("long").alias("last_epoch"))


def expired(catalog: DataFrame, keep: int) -> DataFrame:
    """Checkpoints of all but the last ``keep`` versions; with 0, of all."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    ranks = catalog.select("version").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.desc("version"))))
    return catalog.join(F.broadcast(ranks.where(F.col("r") > keep).select("version")), "version")
