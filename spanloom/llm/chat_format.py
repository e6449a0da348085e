"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the conversation up to and
with that turn, of which only that reply is trainable. Turns after the last
assistant turn go to one further example without a target, so that no turn is
lost. An example is cut from its conversation's formatted text by length, so
the expansion itself moves only offsets.

Defined results: a null role or text counts as empty; turns are ordered by
(turn, role, text), nulls first, and repeated rows are repeated turns; rows with
a null conv_id form one conversation; an empty table gives no rows. Other
columns are ignored. One conversation must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that steer one of the common chat templates.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"


def escaped(text: Column) -> Column:
    """Doubles backslashes and breaks control strings by one after their first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])({CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, targets: array of (example, chars, loss_start, loss_chars, is_last)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        text.alias("text"),
    ).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit(TURN_OPEN), escaped(F.col("role")), F.lit(ROLE_CLOSE)).alias("head"),
        escaped(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + F.lit(len(TURN_CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumns(
        {
            "n": F.row_number().over(order),
            "end": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    turn = F.struct(
        "n",
        "end",
        (F.col("role") == target_role).alias("target"),
        F.length("body").alias("body_chars"),
        F.concat("head", "body", F.lit(TURN_CLOSE)).alias("piece"),
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.size("turns")
    spans = F.transform(
        F.filter("turns", lambda t: t.target | (t.n == last)),
        lambda t: F.struct(
            t.n.alias("example"),
            t.end.alias("chars"),
            F.when(t.target, t.end - len(TURN_CLOSE) - t.body_chars).alias("loss_start"),
            F.when(t.target, t.body_chars).otherwise(0).alias("loss_chars"),
            (t.n == last).alias("is_last"),
        ),
    )
    return grouped.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: t.piece)).alias("formatted"),
        spans.alias("targets"),
    )


def expand_targets(formatted: DataFrame) -> DataFrame:
    """One row an example: conv_id, example, text, loss_start (null without target), loss_chars, is_last."""
    return formatted.select("conv_id", "formatted", F.inline("targets")).select(
        "conv_id",
        "example",
        F.substring(F.col("formatted"), F.lit(1), F.col("chars").cast("int")).alias("text"),
        "loss_start",
        "loss_chars",
        "is_last",
    )


def parsed_turns(text: Column) -> Column:
    """Turns of a formatted text, as (role, text), unescaped."""
    pieces = F.slice(F.split(text, rf"\Q{TURN_OPEN}\E"), F.lit(2), F.greatest(F.size(F.split(text, rf"\Q{TURN_OPEN}\E")) - 1, F.lit(0)))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(p, ROLE_CLOSE, 1)).alias("role"),
            unescaped(F.regexp_extract(p, rf"(?s)^.*?\Q{ROLE_CLOSE}\E(.*)\Q{TURN_CLOSE}\E$", 1)).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Reads the examples back: one row a conversation."""
    loss = unescaped(
        F.when(
            F.col("loss_start").isNotNull(),
            F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")),
        )
    )
    read_back = examples.select(
        "conv_id",
        F.struct("example", loss.alias("loss")).alias("part"),
        F.length("text").alias("chars"),
        F.when(F.col("is_last"), F.col("text")).alias("whole"),
    )
    grouped = read_back.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
        F.first("whole", ignorenulls=True).alias("whole"),
    )
    joined = grouped.select(
        "conv_id",
        "formatted_chars",
        parsed_turns(F.col("whole")).alias("turns"),
        F.concat_ws("", F.transform("parts", lambda p: p.loss)).alias("loss"),
    )
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def planted(spark) -> DataFrame:
    """Conversation -7: control strings inside texts."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(expand_targets(format_conversations(turns.unionByName(planted(spark)))))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length('<|im_start|>' || '<|im_sep|>' || '<|im_end|>') + length(role || text)
    + length(role || text) - length(replace(role || text, '\', ''))
    + (SELECT len(regexp_extract_all(x, '[<\[](\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\])'))
       FROM (SELECT replace(text, '\', '\\') AS x)) AS chars
  FROM t),
w AS (
  SELECT *, sum(chars) OVER p AS upto, row_number() OVER p AS n, count(*) OVER (PARTITION BY conv_id) AS m
  FROM e WINDOW p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR n = m)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
