"""The corpus pipeline over the smallest tables and over planted rows."""

import corpus_pipeline
import public_tokenizers as P

from spanloom.llm import packing, quality_rules, simhash_dedup


def prose(seed: int, n: int = 80) -> str:
    words, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        words.append("".join("bcdfgklmnprst"[(state >> k) % 13] + "aeiou"[(state >> (k + 3)) % 5] for k in (2, 7, 11)))
    return " ".join(words) + "."


def test_stages(spark, tmp_path):
    key = "d8ed425dbdaa383537b4fea24b37ed72645ac62d"
    rows = [(i, prose(i), "en", "s", 1) for i in range(200)]
    rows += [(200 + i, prose(1000 + i, 60) + " you idiot moron, stupid trash.", "en", "s", 1) for i in range(60)]
    rows += [(300, prose(3), "en", "s", 1), (301, prose(500) + f' token = "{key}" x', "en", "s", 1), (302, "too short", "en", "s", 1)]
    rows += [(303, "spam spam spam " * 60, "en", "s", 1), (304, None, None, None, None), (305, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", docs_extra())
    labels = spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i in range(260)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = now.columns
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{number}")
        now = spark.read.parquet(f"{tmp_path}/stage{number}")
        assert now.columns == columns
        kept.append({r.doc_id: r.text for r in now.collect()})
    assert not set(range(200, 260)) & set(kept[0]) and set(range(200)) <= set(kept[0]) and {300, 304, 305} <= set(kept[0])
    assert {302, 303, 304, 305} & set(kept[1]) == set() and set(range(200)) <= set(kept[1])
    assert 300 not in kept[2] and 3 in kept[2]
    assert key not in kept[3][301] and "[SECRET]" in kept[3][301]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    encode = packing.encoder(P.path("byte_bpe_50k.json")).whole
    assert {r.doc_id: r.doc_tokens for r in pieces} == {k: len(encode(t)) + 1 for k, t in kept[3].items()}
    assert sum(r.length for r in pieces) == sum(len(encode(t)) + 1 for t in kept[3].values())


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    allowed = {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    first = {r.doc_id for r in simhash_dedup.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert pieces and {r.doc_id for r in pieces} <= allowed
    assert {r.doc_id for r in pieces} & first


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
