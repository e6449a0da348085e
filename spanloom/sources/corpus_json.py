"""Corpora as JSON: rows, one document, files; and stored data sets as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.schema import CHUNKED_TEXT, CORPUS, EVALUATION, SAMPLES, WINDOWS, LabelSpace
from spanloom.session import removed


def text_json(*columns: str) -> Column:
    return F.to_json(F.struct(*(columns or ("id", "text", "chunks"))))


def metadata(texts: DataFrame, space: LabelSpace) -> DataFrame:
    """Texts with the corpus's label definitions and group sizes beside them."""
    defs = F.create_map(*[F.lit(x) for i, name in space.names.items() for x in (str(i), name)])
    return texts.withColumns({"labelDefs": defs, "labelGrps": F.array(*map(F.lit, space.sizes))})


def corpus_document(texts: DataFrame, space: LabelSpace) -> DataFrame:
    """The whole corpus as one JSON document, for export of small corpora: all texts meet in one row."""
    rows = F.array_sort(F.collect_list(F.struct("id", "text", "chunks")))
    one = texts.agg(rows.alias("texts"))
    return metadata(one, space).select(F.to_json(F.struct("labelDefs", "labelGrps", "texts")).alias("json"))


def save_lines(texts: DataFrame, space: LabelSpace, path: str) -> None:
    """Texts as JSON lines in ``path``/texts, label definitions in ``path``/labels."""
    texts.select("id", "text", "chunks").write.mode("overwrite").json(f"{path}/texts")
    rows = [(i, name) for i, name in space.names.items()]
    texts.sparkSession.createDataFrame(rows, "label int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def parsed_document(json: Column) -> Column:
    return F.from_json(json, CORPUS)


def document_lines(texts: DataFrame, space: LabelSpace) -> DataFrame:
    """The corpus as the lines of one JSON document, in order in one partition: a text is a line of its own, so texts meet in a file but never in a row."""
    kind = texts.schema
    edges = metadata(texts.sparkSession.range(1), space).select(F.regexp_replace(F.to_json(F.struct("labelDefs", "labelGrps")), r"\}$", ',"texts":[').alias("head"))
    edge = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("edge"))
    edges = edges.select(F.inline(F.array(edge(0, F.col("head")), edge(2, F.lit("]}")))))
    none = [F.lit(None).cast(kind[c].dataType).alias(c) for c in ("id", "text", "chunks")]
    rows = texts.select(F.lit(1).alias("part"), F.lit(None).cast("string").alias("edge"), "id", "text", "chunks").unionByName(edges.select("part", "edge", *none))
    place = F.monotonically_increasing_id()  # from 0 in the only partition; the head is 0
    ordered = rows.repartition(1).sortWithinPartitions("part", "id", "text", "chunks").withColumn("place", place)
    line = F.concat(F.when(F.col("place") > 1, ",").otherwise(""), text_json())
    return ordered.select(F.coalesce("edge", line).alias("value"))


def save_document(texts: DataFrame, space: LabelSpace, path: str) -> None:
    """The corpus as one document in a file of its own under ``path``, a line a text."""
    document_lines(texts, space).write.mode("overwrite").text(path)


def load_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, chunks) and (label, name) of a corpus saved as lines."""
    texts = spark.read.schema(CHUNKED_TEXT).json(f"{path}/texts")
    return texts, spark.read.schema("label int, name string").json(f"{path}/labels")


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, chunks) of a corpus saved as one document.

    Documents with a line a text are read line by line, in many tasks; those laid out otherwise as a whole, each in one row.
    """
    value = F.col("value")
    head, foot = value.startswith('{"labelDefs":') & value.endswith(',"texts":['), value == "]}"
    parsed = F.from_json(F.regexp_replace(value, "^,", ""), f"{CHUNKED_TEXT}, _corrupt_record string", {"mode": "PERMISSIVE"})
    lines = spark.read.text(path).select(head.alias("head"), foot.alias("foot"), parsed.alias("t"))
    other = ~F.col("head") & ~F.col("foot") & (F.col("t").isNull() | F.col("t._corrupt_record").isNotNull())
    heads, feet, others = lines.agg(F.count_if("head"), F.count_if("foot"), F.count_if(other)).first()
    if heads and heads == feet and not others:
        return lines.where(~F.col("head") & ~F.col("foot")).select("t.id", "t.text", "t.chunks")
    return spark.read.option("multiLine", True).schema(T._parse_datatype_string(CORPUS)).json(path).select(F.inline("texts"))


def _checked(windows: DataFrame) -> None:
    """Optional columns must be given for every window or for none."""
    for column in ("token_ids", "embeds"):
        if column in windows.columns:
            n, missing = windows.agg(F.count(F.lit(1)), F.count_if(F.col(column).isNull())).first()
            if missing not in (0, n):
                raise ValueError(f"{column} must be given for every window or for none")


def create_dataset(spark: SparkSession, path: str) -> None:
    """An empty data set with the declared columns."""
    save_dataset(spark.createDataFrame([], WINDOWS), spark.createDataFrame([], SAMPLES), path)


def save_dataset(windows: DataFrame, samples: DataFrame, path: str) -> None:
    """Windows wide, samples narrow, each window stored once; optional columns must be given always or never."""
    _checked(windows)
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    samples.write.mode("overwrite").parquet(f"{path}/samples")


def append_dataset(windows: DataFrame, samples: DataFrame, path: str) -> None:
    """Adds windows and samples to a stored data set; what is stored decides which optional columns are given."""
    spark = windows.sparkSession
    stored, held = load_dataset(spark, path)
    both = stored.unionByName(windows, allowMissingColumns=True)
    _checked(both)
    windows.select(*[F.col(c).cast(stored.schema[c].dataType) if c in windows.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]).write.mode("append").parquet(f"{path}/windows")
    samples.select(*[F.col(c).cast(held.schema[c].dataType) for c in held.columns]).write.mode("append").parquet(f"{path}/samples")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/samples")


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def delete_dataset(spark: SparkSession, path: str) -> bool:
    """Removes the stored tables, wherever Spark keeps them."""
    return removed(spark, path)


def save_evaluation(evaluation: DataFrame, path: str) -> None:
    """Partitioned by version, so a version is read alone."""
    evaluation.write.mode("overwrite").partitionBy("model_version").parquet(path)


def load_evaluation(spark: SparkSession, path: str, versions: list[int] | None = None) -> DataFrame:
    """The evaluation table; with ``versions``, only their folders are read."""
    found = spark.read.schema(EVALUATION).parquet(path)
    return found if versions is None else found.where(F.col("model_version").isin(*versions))
