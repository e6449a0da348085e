"""Annotated sheets to tidy tables: tagging, level names, one column a type, binary labels, row numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.session import shared_dir

#: The sheets' level names.
LEVEL_NAMES = {"level 1": 1, "level 2": 2, "level 3": 3, "level 4": 4}
TYPES = ("ethnicity", "gender", "countries", "political", "religion")


def read_sheet(spark: SparkSession, path: str, kind: str, file_ord: int = 0, sheet: str = "in") -> DataFrame:
    """One exported sheet (a csv or Parquet file or folder; xlsx where pandas can read it), tagged with its type and order.

    ``row_in_file`` numbers the rows from 0 as they stand; a folder's files follow each other by name.
    """
    if path.endswith(".xlsx"):
        import pandas as pd

        frame = pd.read_excel(path, sheet_name=sheet)
        return tagged(spark.createDataFrame(frame.assign(row_in_file=range(len(frame)))), kind, file_ord)
    if path.endswith(".csv"):
        # A multi-line file is read by one task from its start, so the running id follows its rows.
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    else:
        rows = spark.read.parquet(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return tagged(with_row_index(rows, ["_file", "_row"], "row_in_file").drop("_file", "_row"), kind, file_ord)


def tagged(rows: DataFrame, kind: str, file_ord: int = 0) -> DataFrame:
    return rows.withColumns({"type": F.lit(kind), "file_ord": F.lit(file_ord)})


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def level_of(name: Column) -> Column:
    """1 to 4 for a level name in any case and spacing; anything else is an error."""
    table = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    found = F.try_element_at(table, F.lower(trimmed(name)))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown level: "), F.coalesce(name, F.lit("null")))).cast("int"))


def typed_levels(kind: Column, level: Column, types: tuple[str, ...] = TYPES) -> dict[str, Column]:
    """One level column a type: the level in its own, 0 in the others; an unknown type is an error."""
    known = F.when(kind.isin(*types), level).otherwise(
        F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("null")))).cast("int")
    )
    return {f"lvl_{t}_hate": F.when(kind == t, known).when(kind.isin(*types), 0).otherwise(known) for t in types}


def loaded_rows(sheet: DataFrame) -> DataFrame:
    """Levelled comments, trimmed."""
    return sheet.select("file_ord", "row_in_file", trimmed(F.col("Comment")).alias("text"), F.col("type"), level_of(F.col("HS Level")).alias("level")).select(
        "file_ord", "row_in_file", "text", *[c.alias(n) for n, c in typed_levels(F.col("type"), F.col("level")).items()]
    )


def neutral_rows(sheet: DataFrame) -> DataFrame:
    """Comments with all levels 0, as they are."""
    return sheet.select("file_ord", "row_in_file", F.col("Comment").alias("text"), *[F.lit(0).alias(f"lvl_{t}_hate") for t in TYPES])


def annotated_corpus(loaded: list[DataFrame], neutral: list[DataFrame]) -> DataFrame:
    """Sheets to the tidy table: levelled sheets in order, then neutral ones, with ``row_idx``."""
    rows = united([loaded_rows(s) for s in loaded] + [neutral_rows(s) for s in neutral])
    return with_row_index(rows, ["file_ord", "row_in_file"])


def united(parts: list[DataFrame]) -> DataFrame:
    """All parts in order; ``file_ord`` and ``row_in_file`` keep that order."""
    return reduce(DataFrame.unionByName, parts)


def row_max(df: DataFrame, suffix: str = "_hate") -> Column:
    """The largest of the columns that end in ``suffix``."""
    columns = [F.col(c) for c in df.columns if c.endswith(suffix)]
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def binary_hate(df: DataFrame) -> DataFrame:
    return df.withColumn("lvl_general_hate", (row_max(df) > 0).cast("int"))


def binary_illegality(df: DataFrame) -> DataFrame:
    """Rows whose largest level is 1 or 2 go; 3 and 4 are illegal."""
    most = row_max(df)
    return df.where(~most.isin(1, 2)).withColumn("lvl_illegality", most.isin(3, 4).cast("int"))


def with_row_index(df: DataFrame, order: list[str], name: str = "row_idx", parts: int | None = None) -> DataFrame:
    """Numbers rows from 0 by ``order``, which must be unique.

    Rows are dealt to ranges of the order; each range is numbered on its own and shifted by the
    rows of the ranges before it, so no task ever holds more than a range.
    """
    spark = df.sparkSession
    shared_dir(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    shifts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        shifts.append(total)
        total += sizes.get(part, 0)
    shift = F.element_at(F.array(*[F.lit(s).cast("long") for s in shifts or [0]]), F.col("_part") + 1)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, shift + place - 1).drop("_part")
