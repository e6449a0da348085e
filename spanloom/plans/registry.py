"""Named queries over the test tables, with their DuckDB twins.

Where the tables lack a column that an operator needs (severity levels, predictions,
scores), it is derived from ids by arithmetic or md5, the same in both engines.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import metrics
from spanloom.operators import corpus, encoder, explain, ingest, merge, permute, samples, scoring, split, tokens
from spanloom.schema import LabelSpace, label_defs, label_groups, label_space
from spanloom.session import shared_dir
from spanloom.sources import catalog, corpus_json, render

HEADS = ["mood", "topic"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(*keys: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two severity heads; topic has levels 0 and 3 only."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), "text", (F.col("doc_id") * 7 % 5).cast("int").alias("mood"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(3).alias("topic")
    )


LEVELS = """levels AS (SELECT doc_id AS row_idx, text, (doc_id * 7 % 5)::INTEGER AS mood,
  (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 3 END)::INTEGER AS topic FROM documents)"""


def chunked(spark: SparkSession, sf_dir: str) -> tuple:
    rows = levels(spark, sf_dir)
    space = label_space(rows, HEADS)
    return corpus.whole_text_chunks(rows, space, "row_idx"), space


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as parts of one text, a chunk a turn, labelled by role."""
    role = F.array_position(F.array(*map(F.lit, ["system", "user", "assistant"])), F.col("role")).cast("int") - 1
    chunk = F.struct(F.lit(0).alias("start"), F.length("text").alias("len"), role.alias("label"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(chunk).alias("chunks"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.concatenated(turns(spark, sf_dir), "conv_id", "turn").withColumnRenamed("conv_id", "id")


TALKS = """turns AS (
  SELECT conv_id, turn, text, list_position(['system', 'user', 'assistant'], role) - 1 AS label,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM conversations),
talks AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS text FROM turns GROUP BY conv_id),
pieces AS (SELECT id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS word FROM talks),
words AS (SELECT id, word, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY word
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pieces)"""


def talk_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = talks(spark, sf_dir)
    return tokens.text_words(texts.select(F.col("id").alias("text_id"), "text")), samples.spans_of(texts)


# --- ingest ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, doc_id % 4 + 1 AS level FROM documents""")
def level_map(spark, sf_dir):
    name = F.concat(F.lit(" LeVel "), (F.col("doc_id") % 4 + 1).cast("string"), F.lit("\t"))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.level_of(name).cast("long").alias("level"))


@query("""WITH t AS (SELECT doc_id, ['ethnicity', 'gender', 'countries', 'political', 'religion'][doc_id % 5 + 1] AS type,
    doc_id % 4 + 1 AS level FROM documents)
SELECT doc_id, CASE WHEN type = 'ethnicity' THEN level ELSE 0 END AS lvl_ethnicity_hate,
  CASE WHEN type = 'gender' THEN level ELSE 0 END AS lvl_gender_hate, CASE WHEN type = 'countries' THEN level ELSE 0 END AS lvl_countries_hate,
  CASE WHEN type = 'political' THEN level ELSE 0 END AS lvl_political_hate, CASE WHEN type = 'religion' THEN level ELSE 0 END AS lvl_religion_hate
FROM t""")
def type_dispatch(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ingest.TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    found = ingest.typed_levels(kind, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in found.items()])


def hate(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", *[(d * k % m).cast("int").alias(f"lvl_{t}_hate") for t, k, m in zip(ingest.TYPES, (7, 3, 11, 5, 2), (5, 4, 3, 2, 5))])


HATE = "greatest(doc_id * 7 % 5, doc_id * 3 % 4, doc_id * 11 % 3, doc_id * 5 % 2, doc_id * 2 % 5)"


@query(f"SELECT doc_id, (CASE WHEN {HATE} > 0 THEN 1 ELSE 0 END)::INTEGER AS lvl_general_hate FROM documents")
def binarise_max(spark, sf_dir):
    return ingest.binary_hate(hate(spark, sf_dir)).select("doc_id", "lvl_general_hate")


@query(f"SELECT doc_id, (CASE WHEN {HATE} IN (3, 4) THEN 1 ELSE 0 END)::INTEGER AS lvl_illegality FROM documents WHERE {HATE} NOT IN (1, 2)")
def binarise_filter(spark, sf_dir):
    return ingest.binary_illegality(hate(spark, sf_dir)).select("doc_id", "lvl_illegality")


@query("""SELECT doc_id, k AS file_ord, row_number() OVER (ORDER BY k, doc_id) - 1 AS row_idx FROM (
  SELECT doc_id, 0 AS k FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 1)""")
def row_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = [ingest.tagged(docs.where(F.col("doc_id") % 2 == k), "loaded", k) for k in (0, 1)]
    return ingest.with_row_index(ingest.united(parts), ["file_ord", "doc_id"]).select("doc_id", "file_ord", "row_idx")


@query(r"""SELECT doc_id, md5(regexp_replace(chr(9) || ' ' || text || chr(10), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""")
def trimmed_text(spark, sf_dir):
    text = F.concat(F.lit("\t "), "text", F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ingest.trimmed(text)).alias("text_md5"))


@query(r"""WITH t AS (SELECT doc_id, text, doc_id % 3 = 0 AS neutral, doc_id % 5 AS k, doc_id % 4 + 1 AS level FROM documents)
SELECT row_number() OVER (ORDER BY neutral, doc_id) - 1 AS row_idx, md5(CASE WHEN neutral THEN text ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS text_md5,
  (CASE WHEN NOT neutral AND k = 0 THEN level ELSE 0 END)::INTEGER AS lvl_ethnicity_hate, (CASE WHEN NOT neutral AND k = 1 THEN level ELSE 0 END)::INTEGER AS lvl_gender_hate,
  (CASE WHEN NOT neutral AND k = 2 THEN level ELSE 0 END)::INTEGER AS lvl_countries_hate, (CASE WHEN NOT neutral AND k = 3 THEN level ELSE 0 END)::INTEGER AS lvl_political_hate,
  (CASE WHEN NOT neutral AND k = 4 THEN level ELSE 0 END)::INTEGER AS lvl_religion_hate FROM t""")
def sheet_ingest(spark, sf_dir):
    """Two exported sheets, one csv with levels and one Parquet without, written and read again into the tidy table."""
    home = work_dir(spark, "sheets")
    rows = table(spark, sf_dir, "documents").withColumn("neutral", F.col("doc_id") % 3 == 0).sortWithinPartitions("doc_id")
    level = F.concat(F.lit(" Level "), (F.col("doc_id") % 4 + 1).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ingest.TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    ranged = rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    sheet = ranged.where("NOT neutral").select(F.col("text").alias("Comment"), level.alias("HS Level"), kind.alias("kind"))
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    sheet.write.csv(f"{home}/loaded.csv", **options)
    ranged.where("neutral").select(F.col("text").alias("Comment")).write.parquet(f"{home}/neutral")
    loaded = ingest.read_sheet(spark, f"{home}/loaded.csv", "", 0).withColumn("type", F.col("kind"))
    found = ingest.annotated_corpus([loaded], [ingest.read_sheet(spark, f"{home}/neutral", "", 1)])
    return found.select("row_idx", F.md5("text").alias("text_md5"), *[f"lvl_{t}_hate" for t in ingest.TYPES])


# --- merge, labels, corpus ------------------------------------------------------------------------


@query(f"""WITH {LEVELS}, g AS (SELECT *, row_number() OVER w AS rn, max(mood) OVER k AS m, max(topic) OVER k AS t FROM levels
  WINDOW w AS (PARTITION BY lower(text) ORDER BY row_idx), k AS (PARTITION BY lower(text)))
SELECT row_idx, md5(text) AS text_md5, m AS mood, t AS topic FROM g WHERE rn = 1""")
def dedup_merge(spark, sf_dir):
    return merge.dedup_merged(levels(spark, sf_dir), HEADS).select("row_idx", F.md5("text").alias("text_md5"), *HEADS)


@query(f"""WITH {LEVELS}, g AS (SELECT *, row_number() OVER w AS rn, first(row_idx) OVER w AS s, first(text) OVER w AS st,
    max(mood) OVER p AS pm, max(topic) OVER p AS pt FROM levels
  WINDOW w AS (PARTITION BY lower(text) ORDER BY row_idx),
    p AS (PARTITION BY lower(text) ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT s AS survivor_idx, row_idx AS dupe_idx, pm AS primary_mood, pt AS primary_topic, mood AS dupe_mood, topic AS dupe_topic,
  md5(st) AS text_md5 FROM g WHERE rn > 1 AND ((pm <> 0 AND mood <> 0) OR (pt <> 0 AND topic <> 0))""")
def dedup_conflicts(spark, sf_dir):
    return merge.conflicts(levels(spark, sf_dir), HEADS).withColumn("text_md5", F.md5("text")).drop("text")


@query(f"""WITH {LEVELS}, u AS (SELECT DISTINCT 0 AS h, 'mood' AS head, mood AS level FROM levels
  UNION ALL SELECT DISTINCT 1, 'topic', topic FROM levels)
SELECT head, level, (row_number() OVER (PARTITION BY h ORDER BY level) - 1)::INTEGER AS dense_index,
  (row_number() OVER (ORDER BY h, level) - 1)::INTEGER AS label, head || '_' || level AS name FROM u""")
def label_space_table(spark, sf_dir):
    return label_defs(levels(spark, sf_dir), HEADS)


@query(f"""WITH {LEVELS}, c AS (SELECT count(DISTINCT mood) AS m, count(DISTINCT topic) AS t FROM levels)
SELECT 'mood' AS head, 0 AS head_no, 0 AS first_label, m::INTEGER AS n_labels FROM c
UNION ALL SELECT 'topic', 1, m::INTEGER, t::INTEGER FROM c""")
def head_offsets(spark, sf_dir):
    return label_groups(levels(spark, sf_dir), HEADS)


CHUNKS = f"""{LEVELS}, spans AS (
  SELECT row_idx AS id, 0 AS start, length(text) AS len, (dense_rank() OVER (ORDER BY mood) - 1)::INTEGER AS label FROM levels
  UNION ALL SELECT row_idx, 0, length(text), ((SELECT count(DISTINCT mood) FROM levels) + dense_rank() OVER (ORDER BY topic) - 1)::INTEGER FROM levels)"""


@query(f"WITH {CHUNKS} SELECT id, start::INTEGER AS start, len::INTEGER AS len, label FROM spans")
def whole_text_chunks(spark, sf_dir):
    return chunked(spark, sf_dir)[0].select("id", F.inline("chunks"))


@query(f"WITH {LEVELS} SELECT row_idx AS id, mood = 0 AND topic = 0 AS is_neutral FROM levels")
def neutral_loaded(spark, sf_dir):
    texts, space = chunked(spark, sf_dir)
    return texts.select("id", corpus.is_neutral(F.col("chunks"), space).alias("is_neutral"))


@query("SELECT coalesce(max(doc_id) + 1, 0) AS next_id FROM documents")
def next_id(spark, sf_dir):
    return corpus.next_id(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query(f"WITH {TALKS} SELECT conv_id AS id, md5(k.text) AS text_md5, start::BIGINT AS start, length(t.text) AS len, label::BIGINT AS label FROM turns t JOIN talks k ON k.id = t.conv_id")
def concat_offsets(spark, sf_dir):
    rows = talks(spark, sf_dir).select("id", F.md5("text").alias("text_md5"), F.inline("chunks"))
    return rows.select("id", "text_md5", *[F.col(c).cast("long").alias(c) for c in ("start", "len", "label")])


DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"""WITH {LEVELS}, pools AS (SELECT row_idx, CASE WHEN mood = 0 AND topic = 0 THEN 0 ELSE 1 END AS loaded FROM levels),
numbered AS (SELECT *, row_number() OVER (PARTITION BY loaded ORDER BY row_idx) - 1 AS pool_row, count(*) OVER (PARTITION BY loaded) AS n FROM pools),
m AS (SELECT row_idx AS mix_id, {DRAW.format("'0|size|' || row_idx")} % 2 + 3 AS size FROM levels),
p AS (SELECT mix_id, size, unnest(range(0, size)) AS part FROM m),
c AS (SELECT *, {DRAW.format("'0|pool|' || mix_id || '|' || part")} % 2 AS coin FROM p),
w AS (SELECT *, sum(coin) OVER (PARTITION BY mix_id) AS whole FROM c),
l AS (SELECT mix_id, part, CASE WHEN part = size - 1 AND whole IN (0, size) THEN 1 - coin ELSE coin END AS loaded FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY loaded ORDER BY mix_id, part) - 1 AS k FROM l),
s AS (SELECT k.mix_id, k.part, k.loaded, (k.k + {DRAW.format("'0|round|' || k.loaded || '|' || (k.k // z.n)")}) % z.n AS pool_row
  FROM k JOIN (SELECT DISTINCT loaded, n FROM numbered) z USING (loaded))
SELECT mix_id, sum(length(d.text))::BIGINT + count(*) - 1 AS chars, count(*) AS parts, sum(s.loaded)::BIGINT AS loaded, min(n.row_idx) AS least_doc
FROM s JOIN numbered n USING (loaded, pool_row) JOIN levels d USING (row_idx) GROUP BY mix_id""")
def mixed_corpus(spark, sf_dir):
    texts, space = chunked(spark, sf_dir)
    rows = texts.select("id", (~corpus.is_neutral(F.col("chunks"), space)).cast("int").alias("loaded"))
    sizes = dict(rows.groupBy("loaded").count().collect())
    pools = [ingest.with_row_index(rows.where(F.col("loaded") == k), ["id"], "pool_row") for k in (0, 1)]
    plan = corpus.mix_plan(spark, sizes.get(1, 0), sizes.get(0, 0), sum(sizes.values()))
    parts = plan.join(pools[0].unionByName(pools[1]), ["loaded", "pool_row"]).join(texts, "id")
    mixed = corpus.concatenated(parts, "mix_id", "part")
    facts = parts.groupBy("mix_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("loaded").alias("loaded"), F.min("id").alias("least_doc"))
    return mixed.select("mix_id", F.length("text").cast("long").alias("chars")).join(facts, "mix_id")


@query(f"""WITH {TALKS}, taken AS (SELECT conv_id AS id, start AS s, start + length(text) AS e FROM turns WHERE label = 1),
n AS (SELECT id, length(text) AS n FROM talks), u AS (SELECT * FROM taken UNION ALL SELECT id, n, n FROM n),
g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM u)
SELECT id, f::BIGINT AS start, (s - f)::BIGINT AS len FROM g WHERE s > f""")
def interval_complement(spark, sf_dir):
    texts = talks(spark, sf_dir)
    taken = texts.select("id", F.inline("chunks")).where("label = 1")
    found = corpus.complement(taken, texts.select("id", F.length("text").alias("n")))
    return found.select("id", F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len"))


@query(f"""WITH {TALKS}, p AS (SELECT conv_id, turn, start AS a, length(text) % 3 AS al, start + turn AS b, turn % 2 AS bl FROM turns)
SELECT conv_id, turn, a <= b + greatest(0, bl - 1) AND b <= a + greatest(0, al - 1) AS clamped,
  (a BETWEEN b AND b + bl - 1) OR (a + al - 1 BETWEEN b AND b + bl - 1) OR (b BETWEEN a AND a + al - 1) OR (b + bl - 1 BETWEEN a AND a + al - 1) AS inclusive
FROM p""")
def range_intersections(spark, sf_dir):
    rows = talks(spark, sf_dir).select(F.col("id").alias("conv_id"), F.posexplode("chunks").alias("turn", "c"))
    a, al, b, bl = F.col("c.start"), F.col("c.len") % 3, F.col("c.start") + F.col("turn"), F.col("turn") % 2
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), corpus.intersects(a, al, b, bl).alias("clamped"), corpus.ranges_meet(a, a + al - 1, b, b + bl - 1).alias("inclusive")
    )


# --- tokens, windows, samples ---------------------------------------------------------------------

DOC_WORDS = """pieces AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS word FROM documents),
words AS (SELECT doc_id, word, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY word
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pieces)"""


@query(f"""WITH {DOC_WORDS} SELECT doc_id AS text_id, word::INTEGER AS word, s::INTEGER AS start, (s + length(w))::INTEGER AS "end",
  greatest(1, ceil(length(w) / 4.0))::BIGINT AS n_tokens FROM words""")
def word_offsets(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return tokens.word_rows(texts, tokens.SpaceTokenizer(4)).drop("special")


@query("""WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)
SELECT doc_id AS text_id, unnest(CASE WHEN n <= 1024 THEN [0] ELSE range(0, n, 683) END)::INTEGER AS start_word FROM n""")
def window_starts(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.size(F.split("text", " ")).alias("n_words"))
    return tokens.windows(n, 1024).select("text_id", "start_word")


@query("""WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), s AS (
  SELECT doc_id, n, unnest(CASE WHEN n <= 256 THEN [0] ELSE range(0, n, 171) END) AS s FROM n)
SELECT doc_id AS text_id, s::INTEGER AS start_token FROM s WHERE s = 0 OR s + 85 < n""")
def covering_windows(spark, sf_dir):
    n = F.size(F.split("text", " "))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), n.alias("n"))
    return docs.select("text_id", F.explode(tokens.covering_starts(F.col("n"), 256)).alias("start_token"))


@query(f"""WITH {TALKS} SELECT w.id AS text_id, w.word::INTEGER AS word, t.label::INTEGER AS label FROM words w LEFT JOIN turns t ON t.conv_id = w.id
  AND ((w.s BETWEEN t.start AND t.start + length(t.text) - 1) OR (w.s + length(w.w) - 1 BETWEEN t.start AND t.start + length(t.text) - 1)
    OR (t.start BETWEEN w.s AND w.s + length(w.w) - 1) OR (t.start + length(t.text) - 1 BETWEEN w.s AND w.s + length(w.w) - 1))
GROUP BY ALL""")
def word_labels(spark, sf_dir):
    words, spans = talk_words(spark, sf_dir)
    return samples.unit_labels(words, spans, ["text_id", "word"]).select("text_id", "word", "label")


ROLES = LabelSpace(("role",), ((0, 1, 2),))
MEETS = """((u.s BETWEEN t.start AND t.start + length(t.text) - 1) OR (u.e - 1 BETWEEN t.start AND t.start + length(t.text) - 1)
    OR (t.start BETWEEN u.s AND u.e - 1) OR (t.start + length(t.text) - 1 BETWEEN u.s AND u.e - 1))"""


def sample_sql(units: str, covering: bool) -> str:
    """Samples of units (id, pos, s, e) in windows of 64 at a third."""
    late = "WHERE f = 0 OR f + 21 < n" if covering else ""
    return f"""n AS (SELECT id, count(*) AS n FROM {units} GROUP BY id),
h AS (SELECT u.id, u.pos, any_value(n) AS n, CASE WHEN any_value(u.s) = any_value(u.e) THEN '1,0,0' ELSE
  concat_ws(',', count(*) FILTER (t.label = 0 AND {MEETS}) > 0, count(*) FILTER (t.label = 1 AND {MEETS}) > 0, count(*) FILTER (t.label = 2 AND {MEETS}) > 0) END AS hot
  FROM {units} u JOIN n USING (id) LEFT JOIN turns t ON t.conv_id = u.id GROUP BY u.id, u.pos),
f AS (SELECT id, pos, n, hot, unnest(CASE WHEN n <= 64 THEN [0::BIGINT] ELSE range((greatest(ceil((pos - 63) / 43.0), 0) * 43)::BIGINT, pos::BIGINT + 1, 43) END) AS f FROM h)
SELECT id AS text_id, f::INTEGER AS start_word, (pos - f)::INTEGER AS target, replace(replace(hot, 'true', '1'), 'false', '0') AS labels FROM f {late}"""


@query(f"""WITH {TALKS}, u AS (SELECT id, word AS pos, s, s + length(w) AS e FROM words), {sample_sql("u", False)}""")
def word_samples(spark, sf_dir):
    found = samples.word_samples(talks(spark, sf_dir), ROLES, 64)
    return found.withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH {TALKS}, x AS (SELECT id, word, s, w, unnest(CASE WHEN w = '' THEN [0] ELSE range(0, length(w), 4) END) AS k FROM words),
u AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY word, k) - 1 AS pos, s + k AS s, s + least(length(w), k + 4) AS e FROM x), {sample_sql("u", True)}""")
def token_samples(spark, sf_dir):
    found = samples.token_samples(talks(spark, sf_dir), ROLES, 64, tokenizer=tokens.SpaceTokenizer(4))
    return found.withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH {DOC_WORDS}, l AS (SELECT doc_id, dense_rank() OVER (ORDER BY doc_id * 7 % 5) - 1 AS a,
    (SELECT count(DISTINCT doc_id * 7 % 5) FROM documents) + dense_rank() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 3 END) - 1 AS b FROM documents),
n AS (SELECT doc_id, max(word) + 1 AS n FROM words GROUP BY doc_id),
x AS (SELECT doc_id, w, CASE WHEN n <= 256 THEN 1 ELSE word // 171 - greatest(ceil((word - 255) / 171.0), 0) + 1 END AS k FROM words JOIN n USING (doc_id)),
h AS (SELECT CASE WHEN w = '' THEN 0 ELSE a END AS label, k FROM x JOIN l USING (doc_id)
  UNION ALL SELECT CASE WHEN w = '' THEN (SELECT count(DISTINCT doc_id * 7 % 5) FROM documents) ELSE b END, k FROM x JOIN l USING (doc_id))
SELECT label::INTEGER AS label, sum(k)::BIGINT AS n FROM h GROUP BY label""")
def label_counts(spark, sf_dir):
    texts, space = chunked(spark, sf_dir)
    return samples.label_counts(samples.word_samples(texts, space, 256), space.size)


@query(f"""WITH {TALKS}, x AS (SELECT id, word, unnest(CASE WHEN w = '' THEN [0] ELSE range(0, length(w), 4) END) AS k, w FROM words),
t AS (SELECT id, word, {DRAW.format("(CASE WHEN k = 0 THEN '▁' ELSE '' END) || substr(w, (k + 1)::BIGINT, 4)")} % (SELECT max(vec_id) + 1 FROM embeddings) AS token_id FROM x),
v AS (SELECT id, word, unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS d FROM t JOIN embeddings e ON e.vec_id = t.token_id),
m AS (SELECT id, word, d, avg(x::DOUBLE) AS value FROM v GROUP BY ALL)
SELECT id AS text_id, word::INTEGER AS word, round(sum(value), 5) AS total, round(sum(value * d), 4) AS moment, round(max(value), 6) AS most FROM m GROUP BY ALL""")
def word_embeddings(spark, sf_dir):
    texts = talks(spark, sf_dir).select(F.col("id").alias("text_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    size = vectors.agg(F.max("token_id") + 1).first()[0]
    made = tokens.SpaceTokenizer(4).tokenised(texts)
    numbers = tokens.word_numbers(F.col("tokens"))
    zipped = F.arrays_zip(F.transform("tokens", lambda t: t.piece).alias("piece"), numbers.alias("word")).alias("zipped")
    found = tokens.spread(made.select("text_id", zipped), ["text_id"], "zipped", "word")
    found = found.withColumn("token_id", draw(F.col("piece")) % size)
    means = tokens.word_vectors(tokens.embedded(found, vectors), 64)
    total = lambda weigh: F.aggregate(F.transform("vector", weigh), F.lit(0.0), lambda a, x: a + x)
    return means.select(
        "text_id", "word", F.round(total(lambda x: x), 5).alias("total"), F.round(total(lambda x, i: x * (i + 1)), 4).alias("moment"), F.round(F.array_max("vector"), 6).alias("most")
    )


# --- scores ---------------------------------------------------------------------------------------


def hashed_scores(spark, sf_dir) -> DataFrame:
    """Windows of 32 words, each word with five confidences out of md5."""
    words, _ = talk_words(spark, sf_dir)
    placed = tokens.window_words(words, 32)
    conf = lambda i: (draw(F.col("text_id"), F.col("start_word"), F.col("place"), i) % 1000) / 1000.0
    return placed.select("text_id", "start_word", "place", "word", F.transform(F.sequence(F.lit(0), F.lit(4)), conf).alias("confs"))


SCORES = f"""{TALKS}, n AS (SELECT id, max(word) + 1 AS n FROM words GROUP BY id),
w AS (SELECT id, word, unnest(CASE WHEN n <= 32 THEN [0::BIGINT] ELSE range((greatest(ceil((word - 31) / 22.0), 0) * 22)::BIGINT, word::BIGINT + 1, 22) END) AS s
  FROM words JOIN n USING (id)),
c AS (SELECT id, word, s, unnest(range(0, 5)) AS label FROM w),
conf AS (SELECT id, word, label, {DRAW.format("id || '|' || s || '|' || (word - s) || '|' || label")} % 1000 / 1000.0 AS c FROM c),
merged AS (SELECT id, word, label, avg(c::DOUBLE) AS conf FROM conf GROUP BY ALL)"""


@query(f"WITH {SCORES} SELECT id AS text_id, word::INTEGER AS word, label::INTEGER AS label, round(conf, 6) AS conf FROM merged")
def overlap_merge(spark, sf_dir):
    merged = scoring.in_long_form(scoring.merged_over_windows(hashed_scores(spark, sf_dir), 5), ["text_id", "word"])
    return merged.select("text_id", F.col("word").cast("int").alias("word"), "label", F.round("conf", 6).alias("conf"))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY id, word, label >= 2 ORDER BY round(conf, 9) DESC, label) AS rn FROM merged)
SELECT id AS text_id, word::INTEGER AS word, min(label)::INTEGER AS first_head, max(label)::INTEGER AS second_head FROM r WHERE rn = 1 GROUP BY ALL""")
def winning_labels(spark, sf_dir):
    vectors = scoring.merged_over_windows(hashed_scores(spark, sf_dir), 5)
    won = scoring.winning_labels(F.transform("confs", lambda c: F.round(c, 9)), [2, 3])
    return vectors.select("text_id", F.col("word").cast("int").alias("word"), won[0].alias("first_head"), won[1].alias("second_head"))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY id, word, label >= 2 ORDER BY conf DESC, label) AS rn FROM merged),
v AS (SELECT id, word, min(label) AS a, max(label) AS b FROM r WHERE rn = 1 GROUP BY ALL)
SELECT id AS text_id, word::INTEGER AS word, s::INTEGER AS start, length(w)::INTEGER AS len, a || ',' || b AS labels FROM v JOIN words USING (id, word)""")
def word_predictions(spark, sf_dir):
    words, _ = talk_words(spark, sf_dir)
    found = scoring.predicted_words(hashed_scores(spark, sf_dir), words, [2, 3])
    return found.select("text_id", "word", "start", "len", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {TALKS}, x AS (SELECT id, word, s, w, unnest(CASE WHEN w = '' THEN [0] ELSE range(0, length(w), 4) END) AS k FROM words),
u AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY word, k) - 1 AS pos, s + k AS s, least(length(w) - k, 4) AS len FROM x),
n AS (SELECT id, count(*) AS n FROM u GROUP BY id),
f AS (SELECT id, pos, unnest(CASE WHEN n <= 32 THEN [0::BIGINT] ELSE range((greatest(ceil((pos - 31) / 22.0), 0) * 22)::BIGINT, pos::BIGINT + 1, 22) END) AS f FROM u JOIN n USING (id)),
c AS (SELECT id, pos, f, unnest(range(0, 2)) AS label FROM f),
m AS (SELECT id, pos, label, avg(({DRAW.format("id || '|' || f || '|' || (pos - f) || '|' || label")} % 1000)::DOUBLE) AS c FROM c GROUP BY ALL)
SELECT id AS text_id, pos::INTEGER AS pos, any_value(s)::INTEGER AS start, any_value(len)::INTEGER AS len,
  (CASE WHEN max(c) FILTER (label = 1) > max(c) FILTER (label = 0) THEN 1 ELSE 0 END)::INTEGER AS label FROM m JOIN u USING (id, pos) GROUP BY id, pos""")
def token_predictions(spark, sf_dir):
    """Windows of 32 tokens, each token with two confidences out of md5."""
    made = tokens.SpaceTokenizer(4).tokenised(talks(spark, sf_dir).select(F.col("id").alias("text_id"), "text"))
    sized = made.select("text_id", F.size("tokens").alias("n_words"), "tokens")
    units = tokens.spread(sized, ["text_id", "n_words"], "tokens", "pos")
    placed = tokens.window_words(units.withColumnRenamed("pos", "word"), 32)
    conf = lambda i: (draw(F.col("text_id"), F.col("start_word"), F.col("place"), i) % 1000).cast("double")
    scores = placed.select("text_id", "start_word", "place", F.transform(F.array(F.lit(0), F.lit(1)), conf).alias("confs"))
    found = scoring.predicted_tokens(scores, units, [2])
    return found.select("text_id", "pos", "start", "len", F.col("labels")[0].alias("label"))


@query(f"""WITH {TALKS}, x AS (SELECT id, word, s, w, unnest(CASE WHEN w = '' THEN [0] ELSE range(0, length(w), 4) END) AS k FROM words),
c AS (SELECT *, unnest(range(0, 2)) AS label FROM x),
m AS (SELECT id, word, label, any_value(s) AS s, any_value(w) AS w, avg(({DRAW.format("id || '|' || (s + k) || '|' || label")} % 1000)::DOUBLE) AS c FROM c GROUP BY id, word, label)
SELECT id AS text_id, word::INTEGER AS word, any_value(s)::INTEGER AS start, any_value(length(w))::INTEGER AS len,
  (CASE WHEN max(c) FILTER (label = 1) > max(c) FILTER (label = 0) THEN 1 ELSE 0 END)::INTEGER AS label FROM m GROUP BY id, word""")
def token_to_word_labels(spark, sf_dir):
    texts = talks(spark, sf_dir).select(F.col("id").alias("text_id"), "text")
    made = tokens.SpaceTokenizer(4).tokenised(texts)
    zipped = F.arrays_zip(F.col("tokens"), tokens.word_numbers(F.col("tokens")).alias("word"))
    found = tokens.spread(made.select("text_id", zipped.alias("zipped")), ["text_id"], "zipped", "word").select("text_id", "word", "tokens.*")
    conf = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (draw(F.col("text_id"), F.col("start"), i) % 1000).cast("double"))
    return scoring.words_from_tokens(found.withColumn("confs", conf), [2]).select("text_id", "word", "start", "len", F.col("labels")[0].alias("label"))


def embedding_windows(spark, sf_dir) -> DataFrame:
    """Embeddings as texts of ten words, one window each."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("text_id"), "vec_id", "embedding", "label")
    grouped = rows.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("r"))
    return grouped.select("text_id", F.lit(0).alias("start_word"), F.transform("r", lambda x: x.embedding).alias("embeds"), "r")


LINEAR = """x AS (SELECT vec_id, vec_id // 10 AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
a AS (SELECT id, vec_id, any_value(label) AS label, l, sum(x * sin({angle})) AS a FROM x, (SELECT unnest(range(0, 5)) AS l){more} GROUP BY ALL),
g AS (SELECT *, a + avg(a) OVER (PARTITION BY id, l{part}) AS g, count(*) OVER (PARTITION BY id, l{part}) AS n FROM a)"""


@query(f"""WITH {LINEAR.format(angle="v * (d * 5 + l)", more=", (SELECT unnest([1, 2]) AS v)", part=", v").replace("a AS (SELECT id,", "a AS (SELECT v, id,")},
r AS (SELECT *, row_number() OVER (PARTITION BY v, vec_id, l >= 2 ORDER BY g DESC, l) AS rn FROM g)
SELECT v::INTEGER AS model_version, vec_id AS sample_idx, string_agg(CASE WHEN l = label % 2 OR l = label % 3 + 2 THEN '1' ELSE '0' END, ',' ORDER BY l) AS expected,
  string_agg(CASE WHEN rn = 1 THEN '1' ELSE '0' END, ',' ORDER BY l) AS found FROM r GROUP BY ALL""")
def model_evaluation(spark, sf_dir):
    """Every model over every window: two linear scorers."""
    weights = {v: np.sin(v * np.arange(64 * 5)).reshape(64, 5) for v in (1, 2)}
    found = evaluations(spark, sf_dir, {v: explain.linear_softmax(w, [2, 3]) for v, w in weights.items()})
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int")), ",")
    return found.select("model_version", "sample_idx", text("expected_labels").alias("expected"), text("found_labels").alias("found"))


@query()
def encoder_evaluation(spark, sf_dir):
    """As model_evaluation, with encoders of one and two layers."""
    found = evaluations(spark, sf_dir, {v: encoder.Encoder(64, [2, 3], layers=v) for v in (1, 2)})
    return found.select("model_version", "sample_idx", F.to_json("found_labels").alias("found_labels"))


def evaluations(spark, sf_dir, forwards: dict) -> DataFrame:
    windows = embedding_windows(spark, sf_dir)
    hot = lambda x: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((x.label % 2 == i) | (x.label % 3 + 2 == i)).cast("int"))
    found = windows.select("text_id", "start_word", F.posexplode("r").alias("target", "x"))
    found = found.select("text_id", "start_word", "target", F.col("x.vec_id").alias("sample_idx"), hot(F.col("x")).alias("labels"))
    return scoring.evaluated({v: scoring.ArrowScorer(f, [2, 3]) for v, f in forwards.items()}, windows, found)


def influences(spark, sf_dir, steps: int) -> DataFrame:
    weights = np.sin(np.arange(64 * 5)).reshape(64, 5)
    return explain.explained(embedding_windows(spark, sf_dir), weights, [2, 3], steps)


@query(f"""WITH {LINEAR.format(angle="d * 5 + l", more="", part="")}, ts AS (SELECT (k + 0.5) / 50 AS t FROM (SELECT unnest(range(0, 50)) AS k)),
e AS (SELECT id, vec_id, l, (l >= 2)::INTEGER AS head, t, n, exp(t * (g - max(g) OVER (PARTITION BY vec_id, l >= 2, t))) AS e FROM g, ts),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, head, t) AS p FROM e),
w AS (SELECT vec_id, (l >= 2)::INTEGER AS head, arg_max(l, g) AS won FROM g GROUP BY ALL),
s AS (SELECT p.id, p.vec_id, p.head, i.vec_id AS other, any_value(p.n) AS n, p.t, max(p.p) FILTER (p.l = w.won) AS chosen, max(i.a) FILTER (p.l = w.won) AS own, sum(p.p * i.a) AS mean
  FROM p JOIN w USING (vec_id, head) JOIN a i ON i.id = p.id AND i.l = p.l GROUP BY p.id, p.vec_id, p.head, i.vec_id, p.t),
f AS (SELECT id, vec_id, other, head, (1.0 / any_value(n) + (vec_id = other)::INTEGER) / 64 * avg(chosen * (own - mean)) AS f FROM s GROUP BY id, vec_id, other, head),
m AS (SELECT *, max(abs(f)) OVER (PARTITION BY vec_id, head) AS most FROM f)
SELECT id AS text_id, head, (vec_id % 10)::INTEGER AS out_pos, (other % 10)::INTEGER AS in_pos, round(f / CASE WHEN most < 1e-12 THEN 1 ELSE most END, 5) + 0.0 AS influence FROM m""")
def integrated_gradients(spark, sf_dir):
    found = explain.merged_influence(influences(spark, sf_dir, 50), normalise=True)
    return found.withColumn("influence", F.round("influence", 5) + 0.0)


@query()
def gradient_convergence(spark, sf_dir):
    parts = [influences(spark, sf_dir, s).withColumn("steps", F.lit(s)) for s in (10, 20, 40)]
    return explain.convergence(ingest.united(parts))


@query(f"""WITH {TALKS}, n AS (SELECT id, max(word) + 1 AS n FROM words GROUP BY id),
w AS (SELECT id, word, unnest(CASE WHEN n <= 8 THEN [0::BIGINT] ELSE range((greatest(ceil((word - 7) / 6.0), 0) * 6)::BIGINT, word::BIGINT + 1, 6) END) AS s
  FROM words JOIN n USING (id)),
p AS (SELECT a.id, a.word AS o, b.word AS i, {DRAW.format("a.id || '|' || a.s || '|' || a.word || '|' || b.word")} % 1000 / 1000.0 - 0.5 AS f
  FROM w a JOIN w b ON a.id = b.id AND a.s = b.s),
m AS (SELECT id, o, i, avg(f::DOUBLE) AS f FROM p GROUP BY ALL), t AS (SELECT *, max(abs(f)) OVER (PARTITION BY id, o) AS most FROM m)
SELECT id AS text_id, o::INTEGER AS out_pos, i::INTEGER AS in_pos, round(f / CASE WHEN most < 1e-12 THEN 1 ELSE most END, 6) + 0.0 AS influence FROM t""")
def influence_merge(spark, sf_dir):
    words, _ = talk_words(spark, sf_dir)
    held = tokens.window_words(words, 8).groupBy("text_id", "start_word").agg(F.collect_list("word").alias("held"))
    pairs = held.select("text_id", "start_word", "held", F.explode("held").alias("out_pos")).select("text_id", "start_word", "out_pos", F.explode("held").alias("in_pos"))
    value = (draw(F.col("text_id"), F.col("start_word"), F.col("out_pos"), F.col("in_pos")) % 1000) / 1000.0 - 0.5
    merged = explain.merged_influence(pairs.withColumns({"head": F.lit(0), "influence": value}), normalise=True)
    return merged.select("text_id", "out_pos", "in_pos", (F.round("influence", 6) + 0.0).alias("influence"))


# --- metrics --------------------------------------------------------------------------------------


def evaluation(spark, sf_dir) -> DataFrame:
    """Labels as two heads of two, and three models that are right more and more often."""
    rows = table(spark, sf_dir, "labels").join(F.broadcast(spark.createDataFrame([(1,), (2,), (3,)], "model_version int")), F.lit(True))
    right = lambda name: draw(F.col("model_version"), F.col("doc_id"), F.lit(name)) % 10 < F.col("model_version") * 2 + 3
    found = {n: F.when(right(n), F.col(n)).otherwise(1 - F.col(n)) for n in ("quality", "toxic")}
    vector = lambda q, t: F.array(1 - q, q, 1 - t, t).cast("array<float>")
    return rows.select(
        "model_version", F.col("doc_id").alias("sample_idx"), vector(F.col("quality"), F.col("toxic")).alias("expected_labels"), vector(found["quality"], found["toxic"]).alias("found_labels")
    )


def right_sql(name: str) -> str:
    key = f"v || '|' || doc_id || '|{name}'"
    return f"CASE WHEN {DRAW.format(key)} % 10 < v * 2 + 3 THEN {name} ELSE 1 - {name} END"


EVAL = f"""e AS (SELECT v AS model_version, doc_id, quality AS q, toxic AS t, {right_sql("quality")} AS fq, {right_sql("toxic")} AS ft
  FROM labels, (SELECT unnest([1, 2, 3])::INTEGER AS v)),
r AS (SELECT model_version, 0 AS label, 1 - q AS x, 1 - fq AS f FROM e UNION ALL SELECT model_version, 1, q, fq FROM e
  UNION ALL SELECT model_version, 2, 1 - t, 1 - ft FROM e UNION ALL SELECT model_version, 3, t, ft FROM e),
k AS (SELECT model_version, label, count(*) FILTER (x = 1 AND f = 1) AS tp, count(*) FILTER (x = 0 AND f = 1) AS fp,
  count(*) FILTER (x = 1 AND f = 0) AS fn, count(*) FILTER (x = 0 AND f = 0) AS tn FROM r GROUP BY ALL),
s AS (SELECT *, list_avg(list_filter([CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) END, CASE WHEN 2*tn+fp+fn > 0 THEN 2.0*tn/(2*tn+fp+fn) END],
  lambda y: y IS NOT NULL)) AS f1 FROM k)"""


@query(f"WITH {EVAL} SELECT model_version, round(sum(f1 * (tp + fn)) / nullif(sum(tp + fn), 0), 6) AS weighted_f1, round(min(f1), 6) AS min_f1, round(max(f1), 6) AS max_f1 FROM s GROUP BY ALL")
def f1_by_version(spark, sf_dir):
    return rounded(metrics.f1_by_version(metrics.label_rows(evaluation(spark, sf_dir))))


@query(f"WITH {EVAL} SELECT model_version, round(avg(f1), 6) AS weighted_f1, round(min(f1), 6) AS min_f1, round(max(f1), 6) AS max_f1 FROM s GROUP BY ALL")
def f1_uniform(spark, sf_dir):
    return rounded(metrics.f1_by_version(metrics.label_rows(evaluation(spark, sf_dir)), weight="uniform"))


@query(f"WITH {EVAL} SELECT model_version, round(sum(f1 * (tp + fn)) / nullif(sum(tp + fn), 0), 6) AS weighted_f1, round(min(f1), 6) AS min_f1, round(max(f1), 6) AS max_f1 FROM s WHERE label IN (1, 3) GROUP BY ALL")
def f1_no_neutral(spark, sf_dir):
    return rounded(metrics.f1_by_version(metrics.label_rows(evaluation(spark, sf_dir)), leave_out=[0, 2]))


@query(f"WITH {EVAL} SELECT label::INTEGER AS label, round(f1, 6) AS f1, (tp + fn)::BIGINT AS support FROM s WHERE model_version = 3")
def f1_per_label(spark, sf_dir):
    rows = metrics.label_rows(evaluation(spark, sf_dir).where("model_version = 3"))
    return metrics.f1_by_label(rows).select("label", F.round("f1", 6).alias("f1"), "support")


@query(f"WITH {EVAL} SELECT model_version, label::INTEGER AS label, tp, fp, fn, tn FROM k")
def confusion_matrix(spark, sf_dir):
    rows = metrics.label_rows(evaluation(spark, sf_dir))
    return rows.groupBy("model_version", "label").agg(*metrics.confusion(F.col("expected"), F.col("found")))


@query(f"""WITH {EVAL}, b AS (SELECT label, tp + fn AS ones, fp + tn AS zeros FROM k WHERE model_version = 1)
SELECT label::INTEGER AS label, (ones > zeros)::INTEGER AS majority, round(greatest(ones, zeros) * 2.0 / (2 * greatest(ones, zeros) + least(ones, zeros))
  / (CASE WHEN least(ones, zeros) > 0 THEN 2 ELSE 1 END), 6) AS f1, ones AS support FROM b""")
def f1_baseline(spark, sf_dir):
    return metrics.f1_baseline(metrics.label_rows(evaluation(spark, sf_dir))).withColumn("f1", F.round("f1", 6))


@query(f"WITH {EVAL} SELECT label::INTEGER AS label, round(avg(1 - x), 6) AS share_0, round(avg(x), 6) AS share_1 FROM r WHERE model_version = 1 GROUP BY label")
def class_balance(spark, sf_dir):
    rows = metrics.label_rows(evaluation(spark, sf_dir)).where("model_version = 1")
    return metrics.class_balance(rows).select("label", F.round("share_0", 6).alias("share_0"), F.round("share_1", 6).alias("share_1"))


@query(f"""WITH {EVAL}, c AS (SELECT label, tp + fn AS n, f1 FROM s WHERE model_version = 2),
i AS (SELECT *, 1 / least(1.0, greatest(0.1, n / (SELECT max(n) FROM c))) AS inv FROM c)
SELECT label::INTEGER AS label, round(coalesce((inv - (SELECT min(inv) FROM i)) / nullif((SELECT max(inv) - min(inv) FROM i), 0), 0) * 4 * (1 - f1) + 1, 6) AS scale FROM i""")
def loss_scaling(spark, sf_dir):
    rows = metrics.f1_by_label(metrics.label_rows(evaluation(spark, sf_dir)).where("model_version = 2"))
    return metrics.loss_scaling(rows.select("label", F.col("support").alias("n"), "f1"), 4.0).select("label", F.round("scale", 6).alias("scale"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select("model_version", *[F.round(c, 6).alias(c) for c in ("weighted_f1", "min_f1", "max_f1")])


# --- folds, orders --------------------------------------------------------------------------------


def labelled_samples(spark, sf_dir) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_idx"), F.array(1 - q, q, 1 - t, t).alias("labels"), F.floor(F.col("doc_id") / 7).alias("enc_id")
    )


COUNTS = """CASE WHEN a + b > n THEN (CASE WHEN a >= b THEN a - 1 ELSE a END) ELSE a END"""


@query(f"""WITH n AS (SELECT unnest(range(0, 200)) AS n), c AS (SELECT n, ceil(0.9::FLOAT * n::FLOAT)::BIGINT AS a, ceil(0.1::FLOAT * n::FLOAT)::BIGINT AS b FROM n)
SELECT n, {COUNTS} AS train, n - {COUNTS} AS test FROM c""")
def fold_counts(spark, sf_dir):
    rows = [(n, *split.fold_counts(n, [0.9, 0.1])) for n in range(200)]
    return spark.createDataFrame(rows, "n long, train long, test long")


QUOTA = f"""c AS (SELECT quality, toxic, count(*) AS n, ceil(0.9::FLOAT * count(*)::FLOAT)::BIGINT AS a, ceil(0.1::FLOAT * count(*)::FLOAT)::BIGINT AS b FROM labels GROUP BY ALL),
f AS (SELECT doc_id, (row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id::VARCHAR), doc_id) > {COUNTS})::INTEGER AS fold FROM labels JOIN c USING (quality, toxic))"""


@query(f"WITH {QUOTA} SELECT doc_id AS sample_idx, fold FROM f")
def stratified_split(spark, sf_dir):
    return split.quota_folds(labelled_samples(spark, sf_dir), [0.9, 0.1])


@query()
def stratified_split_exact(spark, sf_dir):
    return split.exact_folds(labelled_samples(spark, sf_dir), [0.9, 0.1])


@query(f"""WITH {QUOTA}, r AS (SELECT * FROM labels JOIN (SELECT doc_id FROM f WHERE fold = 0) USING (doc_id)),
c2 AS (SELECT quality, toxic, count(*) AS n, ceil(0.9::FLOAT * count(*)::FLOAT)::BIGINT AS a, ceil(0.1::FLOAT * count(*)::FLOAT)::BIGINT AS b FROM r GROUP BY ALL)
SELECT doc_id AS sample_idx, (row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id::VARCHAR), doc_id) > {COUNTS})::INTEGER AS fold
FROM r JOIN c2 USING (quality, toxic) UNION ALL SELECT doc_id, 2 FROM f WHERE fold = 1""")
def two_level_split(spark, sf_dir):
    return split.two_level(labelled_samples(spark, sf_dir))


@query(f"""WITH {QUOTA}, e AS (SELECT fold, doc_id // 7 AS enc_id, min(doc_id) AS first FROM f GROUP BY ALL)
SELECT fold, enc_id, row_number() OVER (PARTITION BY fold ORDER BY first) - 1 AS new_enc_id FROM e""")
def fold_materialise(spark, sf_dir):
    rows = labelled_samples(spark, sf_dir)
    found = split.materialised(rows, split.quota_folds(rows, [0.9, 0.1]))
    return found.select("fold", "enc_id", F.col("new_enc_id").cast("long").alias("new_enc_id")).distinct()


@query("""SELECT doc_id AS sample_idx, row_number() OVER (ORDER BY md5('0|3|' || doc_id), doc_id) - 1 AS perm_pos,
  (row_number() OVER (ORDER BY md5('0|3|' || doc_id), doc_id) - 1) // 4 AS batch_id FROM labels""")
def epoch_permutation(spark, sf_dir):
    return permute.batched(permute.permuted(labelled_samples(spark, sf_dir), 0, 3)).select("sample_idx", "perm_pos", "batch_id")


# --- catalogue, rendering, JSON -------------------------------------------------------------------


def checkpoint_paths(spark) -> DataFrame:
    names = [(v, e, s) for v, e, s in ((0, 9, 100), (1, 4, 50), (1, 9, 110), (2, 0, 7), (10, 3, 20))]
    return spark.createDataFrame([(f"logs/lightning_logs/version_{v}/checkpoints/epoch={e}-step={s}.ckpt",) for v, e, s in names], "path string")


@query("SELECT * FROM (VALUES (0, 9::BIGINT), (1, 19::BIGINT), (2, 20::BIGINT), (10, 24::BIGINT)) t(version, last_epoch)")
def checkpoint_epochs(spark, sf_dir):
    return catalog.cumulative_epochs(catalog.parsed(checkpoint_paths(spark)))


@query("SELECT * FROM (VALUES (0, 9), (1, 4), (1, 9)) t(version, epoch)")
def checkpoint_retention(spark, sf_dir):
    return catalog.expired(catalog.parsed(checkpoint_paths(spark)), 2).select("version", "epoch")


SPAN = """'<span title="st=0,len=' || len || ',lblId=' || label || ',lbl=' || {} || '" style="border:solid 1px;color:' || ['crimson', 'royalblue', 'seagreen',
  'darkorange', 'purple', 'teal', 'sienna', 'deeppink', 'olive', 'slateblue'][label % 10 + 1] || '">' || text || '</span>'"""
LINES = f"""{CHUNKS}, named AS (SELECT s.*, l.text, CASE WHEN label < (SELECT count(DISTINCT mood) FROM levels) THEN 'mood_' || mood ELSE 'topic_' || topic END AS name
  FROM spans s JOIN levels l ON l.row_idx = s.id),
html AS (SELECT id, string_agg({SPAN.format("name")}, '' ORDER BY label) AS html FROM named GROUP BY id)"""


@query(f"WITH {LINES} SELECT a.id, md5(a.html) AS ref_md5, md5(b.html) AS res_md5 FROM html a LEFT JOIN html b USING (id)")
def side_by_side(spark, sf_dir):
    texts, space = chunked(spark, sf_dir)
    found = render.side_by_side(texts, texts, space.names)
    return found.select("id", F.md5("ref_html").alias("ref_md5"), F.md5("res_html").alias("res_md5"))


JSON_TEXT = r"""replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


@query(rf"""WITH {CHUNKS}, sizes AS (SELECT (SELECT count(DISTINCT mood) FROM levels) AS m, (SELECT count(DISTINCT topic) FROM levels) AS t),
defs AS (SELECT 'mood_' || mood AS name, 0 AS h, mood AS v FROM levels GROUP BY mood UNION ALL SELECT 'topic_' || topic, 1, topic FROM levels GROUP BY topic),
numbered AS (SELECT name, row_number() OVER (ORDER BY h, v) - 1 AS label FROM defs),
meta AS (SELECT string_agg('"' || label || '":"' || name || '"', ',' ORDER BY label) AS d FROM numbered),
one AS (SELECT row_idx AS id, '{{"labelDefs":{{' || d || '}},"labelGrps":[' || m || ',' || t || '],"id":' || row_idx || ',"text":"' || {JSON_TEXT} || '","chunks":['
  || (SELECT string_agg('{{"start":' || start || ',"len":' || len || ',"label":' || label || '}}', ',' ORDER BY label) FROM spans s WHERE s.id = row_idx) || ']}}' AS j
  FROM levels, meta, sizes)
SELECT id, md5('const pair = JSON.parse("' || replace(replace('{{"ref":' || j || ',"res":' || j || '}}', '\', '\\'), '"', '\"') || '")') AS js_md5 FROM one""")
def script_side_by_side(spark, sf_dir):
    texts, space = chunked(spark, sf_dir)
    return render.script_rows(texts, texts, space).select("id", F.md5("js").alias("js_md5"))


@query(f"WITH {CHUNKS} SELECT row_idx AS id, md5(text) AS text_md5, 2 AS n_chunks, (SELECT sum(label)::BIGINT FROM spans s WHERE s.id = row_idx) AS labels FROM levels")
def json_round_trip(spark, sf_dir):
    texts, _ = chunked(spark, sf_dir)
    parsed = texts.select(F.from_json(corpus_json.text_json(), "id bigint, text string, chunks array<struct<start:int,len:int,label:int>>").alias("t")).select("t.*")
    labels = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c.label)
    return parsed.select("id", F.md5("text").alias("text_md5"), F.size("chunks").alias("n_chunks"), labels.alias("labels"))


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


TEXT_FACTS = f"""WITH {CHUNKS} SELECT row_idx AS id, md5(text) AS text_md5, 2 AS n_chunks, (SELECT sum(label)::BIGINT FROM spans s WHERE s.id = row_idx) AS labels FROM levels"""


def text_facts(texts: DataFrame) -> DataFrame:
    labels = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c.label)
    return texts.select("id", F.md5("text").alias("text_md5"), F.size("chunks").alias("n_chunks"), labels.alias("labels"))


@query(TEXT_FACTS)
def corpus_lines(spark, sf_dir):
    """The corpus as JSON lines, written and read again."""
    texts, space = chunked(spark, sf_dir)
    home = work_dir(spark, "lines")
    corpus_json.save_lines(texts, space, home)
    return text_facts(corpus_json.load_lines(spark, home)[0])


@query(TEXT_FACTS)
def corpus_document(spark, sf_dir):
    """The corpus as one JSON document, written and read again."""
    texts, space = chunked(spark, sf_dir)
    home = work_dir(spark, "document")
    corpus_json.save_document(texts, space, home)
    return text_facts(corpus_json.load_document(spark, home))


@query(f"""WITH {SCORES.split("c AS (SELECT id, word, s, unnest")[0].rstrip().rstrip(",")}
SELECT id AS text_id, s::INTEGER AS start_word, (word - s)::INTEGER AS target, least(32, n - s)::INTEGER AS n, false AS by_vectors FROM w JOIN n USING (id)""")
def dataset_files(spark, sf_dir):
    """A data set created, appended to, loaded, and its samples joined to their windows."""
    words, _ = talk_words(spark, sf_dir)
    home = work_dir(spark, "dataset")
    corpus_json.create_dataset(spark, home)
    enc_id = (F.col("text_id") * 1_000_000 + F.col("start_word")).alias("enc_id")
    sizes = words.select("text_id", "n_words").distinct()
    windows = tokens.windows(sizes, 32).select(enc_id, "text_id", "start_word", "n", F.array().cast("array<int>").alias("token_ids"))
    placed = tokens.window_words(words, 32)
    rows = placed.select(F.xxhash64("text_id", "word", "start_word").alias("sample_idx"), "text_id", enc_id, F.col("place").alias("target"), F.array(F.lit(1)).alias("labels"))
    corpus_json.append_dataset(windows, rows, home)
    stored, held = corpus_json.load_dataset(spark, home)
    found = permute.loaded(held, stored).join(stored.select("enc_id", "start_word"), "enc_id")
    return found.select("text_id", "start_word", F.col("target").cast("int").alias("target"), "n", "by_vectors")


@query(f"""WITH {EVAL} SELECT model_version, doc_id AS sample_idx, concat_ws(',', 1 - q, q, 1 - t, t) AS expected, concat_ws(',', 1 - fq, fq, 1 - ft, ft) AS found
FROM e WHERE model_version IN (1, 3)""")
def evaluation_files(spark, sf_dir):
    """The evaluation table written by version; two versions read again."""
    home = work_dir(spark, "evaluation")
    corpus_json.save_evaluation(evaluation(spark, sf_dir).withColumn("confidence", F.col("found_labels")), home)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int")), ",")
    found = corpus_json.load_evaluation(spark, home, [1, 3])
    return found.select("model_version", "sample_idx", text("expected_labels").alias("expected"), text("found_labels").alias("found"))
