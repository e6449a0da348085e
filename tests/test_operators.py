"""Hand-written cases and restatements of the sequential rules."""

import collections
import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import metrics
from spanloom.operators import components, corpus, encoder, explain, ingest, merge, permute, samples, scoring, split, tokens
from spanloom.schema import LabelSpace, label_space
from spanloom.sources import catalog, corpus_json, render


def test_running_max_conflict(spark):
    rows = spark.createDataFrame([(0, "Aa", 1), (1, "aa", 0), (2, "AA", 2)], "row_idx long, text string, lvl int")
    assert [tuple(r) for r in merge.dedup_merged(rows, ["lvl"]).collect()] == [(0, "Aa", 2)]
    found = merge.conflicts(rows, ["lvl"]).select("survivor_idx", "dupe_idx", "primary_lvl", "dupe_lvl", "text").collect()
    assert [tuple(r) for r in found] == [(0, 2, 1, 2, "Aa")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("aAbBc"), st.integers(0, 4)), max_size=14))
def test_merge_is_the_sequential_rule(spark, rows):
    survivors, log = {}, []
    for i, (text, level) in enumerate(rows):
        key = text.lower()
        if key not in survivors:
            survivors[key] = [i, text, level]
            continue
        s = survivors[key]
        if s[2] and level:
            log.append((s[0], i, s[2], level, s[1]))
        s[2] = max(s[2], level)
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "row_idx long, text string, lvl int")
    merged = merge.dedup_merged(df, ["lvl"]).orderBy("row_idx").collect()
    assert [list(r) for r in merged] == sorted(survivors.values())
    found = merge.conflicts(df, ["lvl"]).select("survivor_idx", "dupe_idx", "primary_lvl", "dupe_lvl", "text").collect()
    assert sorted(map(tuple, found)) == sorted(log)


def test_levels(spark):
    df = spark.createDataFrame([(" LEVEL 3 ",), ("level 1",)], "n string")
    assert [r[0] for r in df.select(ingest.level_of(F.col("n"))).collect()] == [3, 1]
    with pytest.raises(Exception, match="unknown level"):
        spark.createDataFrame([("level 9",)], "n string").select(ingest.level_of(F.col("n"))).collect()
    with pytest.raises(Exception, match="unknown type"):
        row = spark.createDataFrame([("other", 1)], "t string, v int")
        row.select(*ingest.typed_levels(F.col("t"), F.col("v")).values()).collect()


def test_label_space(spark):
    rows = spark.createDataFrame([(0, 3), (2, 0), (2, 3)], "a int, b int")
    space = label_space(rows, ["a", "b"])
    assert (space.sizes, space.offsets, space.neutral) == ([2, 2], [0, 2], [0, 2])
    assert space.names == {0: "a_0", 1: "a_2", 2: "b_0", 3: "b_3"}
    assert [r[0] for r in rows.select(space.label("b", F.col("b"))).collect()] == [3, 2, 3]
    assert rows.select(space.label("b", F.lit(9))).first()[0] is None


def test_word_marks(spark):
    pieces = [("▁a", False), ("b", False), ("<unk>", True), ("d", False), ("▁c", False)]
    df = spark.createDataFrame([(1, i, p, s) for i, (p, s) in enumerate(pieces)], "text_id long, pos int, piece string, special boolean")
    assert [r.word for r in tokens.with_words(df).orderBy("pos").collect()] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("n, starts", [(1, [0]), (1024, [0]), (1025, [0, 683]), (1367, [0, 683, 1366]), (1400, [0, 683, 1366])])
def test_window_starts(spark, n, starts):
    assert spark.range(1).select(tokens.window_starts(F.lit(n), 1024)).first()[0] == starts


def test_overlap_is_checked():
    with pytest.raises(ValueError):
        tokens.checked_overlap(0.95)


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 60), st.integers(2, 9), st.sampled_from([0.0, 1 / 3, 0.5]))
def test_window_words_are_the_slices(spark, n, size, overlap):
    spans = spark.range(n).select(F.lit(1).alias("text_id"), F.col("id").cast("int").alias("word"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    step = size - int(size * overlap)
    starts = [0] if n <= size else range(0, n, step)
    want = sorted((s, i, s + i) for s in starts for i in range(min(size, n - s)))
    got = tokens.window_words(spans, size, overlap).select("start_word", "place", "word").collect()
    assert sorted(map(tuple, got)) == want


def test_zero_length_chunk(spark):
    words = spark.createDataFrame([(3, 7), (5, 9), (0, 4), (6, 9)], "a int, b int")
    got = words.select(corpus.ranges_meet(F.col("a"), F.col("b"), F.lit(5), F.lit(4))).collect()
    assert [r[0] for r in got] == [True, True, True, False]


def test_complement(spark):
    taken = spark.createDataFrame([(1, 2, 3), (1, 8, 5)], "id long, start int, len int")
    lengths = spark.createDataFrame([(1, 10), (2, 4), (3, 0)], "id long, n int")
    got = corpus.complement(taken, lengths).orderBy("id", "start").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2), (1, 5, 3), (2, 0, 4)]


def test_mixed_text(spark):
    chunk = "array<struct<start:int,len:int,label:int>>"
    parts = spark.createDataFrame([(1, 0, "ab", [(0, 2, 0)]), (1, 1, "cde", [(0, 3, 1)]), (2, 0, "", []), (2, 1, "x", [(0, 1, 0)])], f"mix_id long, part int, text string, chunks {chunk}")
    got = {r.mix_id: (r.text, [tuple(c) for c in r.chunks]) for r in corpus.concatenated(parts).collect()}
    assert got == {1: ("ab cde", [(0, 2, 0), (3, 3, 1)]), 2: ("x", [(0, 1, 0)])}


def test_mix_plan_uses_a_pool_up(spark):
    plan = corpus.mix_plan(spark, 5, 3, 20).collect()
    by_mix = {}
    for r in plan:
        by_mix.setdefault(r.mix_id, []).append(r.loaded)
    assert len(by_mix) == 20 and all(len(v) in (3, 4) and 0 < sum(v) < len(v) for v in by_mix.values())
    first = [r.pool_row for r in sorted(plan, key=lambda r: (r.mix_id, r.part)) if r.loaded][:5]
    assert sorted(first) == list(range(5))


def test_exact_mix_plan():
    plan = corpus.exact_mix_plan([1, 2, 3], [4, 5], 10)
    assert {m for m, _, _ in plan} == set(range(10))
    with pytest.raises(ValueError):
        corpus.exact_mix_plan([], [1], 2)


@pytest.mark.parametrize("n, counts", [(1, [0, 1]), (5, [4, 1]), (11, [9, 2]), (101, [90, 11]), (0, [0, 0])])
def test_fold_counts(n, counts):
    assert split.fold_counts(n, [0.9, 0.1]) == counts


def test_fold_checks():
    with pytest.raises(ValueError):
        split.checked_ratios([0.5, 0.4])
    with pytest.raises(ValueError):
        split.checked_ratios([0.9, 0.1], prefixes=3)


def test_stratified_fills_every_fold():
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 2, (97, 4))
    fold = split.stratified(hot, [0.8, 0.1, 0.1])
    assert np.bincount(fold, minlength=3).tolist() == split.fold_counts(97, [0.8, 0.1, 0.1])
    for j in range(4):
        assert abs((hot[fold == 0, j]).sum() - 0.8 * hot[:, j].sum()) <= 4


def test_text_folds_keep_texts_together(spark):
    rows = spark.range(200).select(F.col("id").alias("sample_idx"), (F.col("id") % 40).alias("text_id"))
    got = split.text_folds(rows, [0.5, 0.5]).collect()
    assert len(got) == 40 and {r.fold for r in got} == {0, 1}


def test_orders():
    first, again = permute.exact_order(10, 0, 0), permute.exact_order(10, 0, 0)
    assert (first == again).all() and sorted(permute.exact_order(10, 0, 3)) == list(range(10))


def test_row_index(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    got = ingest.with_row_index(df, ["k"]).collect()
    assert all(r.k == r.row_idx for r in got) and len(got) == 1000


def test_winning_labels(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.3, 0.3, 0.4],), ([0.5, 0.5, 0.2, 0.2, 0.2],)], "c array<double>")
    assert [r[0] for r in df.select(scoring.winning_labels(F.col("c"), [2, 3])).collect()] == [[1, 4], [0, 2]]
    assert df.select(scoring.winning_hot(F.col("c"), [2, 3])).first()[0] == [0, 1, 0, 0, 1]


def test_head_softmax(spark):
    got = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0, 1.0],)], "c array<double>").select(scoring.head_softmax(F.col("c"), [2, 3])).first()[0]
    assert np.allclose(got, [0.5, 0.5, 1 / 3, 1 / 3, 1 / 3])


def test_overlap_merge(spark):
    df = spark.createDataFrame([(1, 0, 3, [0.2]), (1, 2, 1, [0.6])], "text_id long, start_word int, place int, confs array<double>")
    assert scoring.merged_over_windows(df, 1).first().confs == [pytest.approx(0.4)]


def test_f1_cases(spark):
    rows = lambda pairs: spark.createDataFrame([(1, 0, e, f) for e, f in pairs], "model_version int, label int, expected int, found int")
    assert metrics.f1_by_label(rows([(0, 0), (0, 0)])).first().f1 == 1.0
    assert metrics.f1_by_label(rows([(1, 0), (0, 0)])).first().f1 == pytest.approx(1 / 3)
    tie = metrics.f1_baseline(rows([(0, 0), (1, 1)])).first()
    assert tie.majority == 0 and tie.f1 == pytest.approx(1 / 3)
    assert metrics.f1_by_version(rows([(0, 0)])).first().weighted_f1 is None


def test_loss_scaling_without_spread(spark):
    counts = spark.createDataFrame([(0, 5, 0.5), (1, 5, 0.2)], "label int, n long, f1 double")
    assert [r.scale for r in metrics.loss_scaling(counts, 4.0).collect()] == [1.0, 1.0]


def test_encoder_takes_one_word():
    model = encoder.Encoder(8, [2, 3], heads=2)
    for n in (1, 5):
        out = model(np.random.default_rng(n).normal(size=(n, 8)))
        assert out.shape == (n, 5) and np.allclose(out[:, :2].sum(1), 1) and np.allclose(out[:, 2:].sum(1), 1)
    x = np.arange(8.0).reshape(1, 8)
    assert np.allclose(encoder.rotated(x), x)


def test_gradients_add_up():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(3, 4)), rng.normal(size=(4, 2))
    found = explain.integrated_gradients(x, w, [2], 0, 2000).sum(axis=1) * 4
    forward = explain.linear_softmax(w, [2])
    won = forward(x).argmax(axis=1)
    assert np.allclose(found, forward(x)[np.arange(3), won] - 0.5, atol=1e-4)


def test_retention(spark):
    paths = spark.createDataFrame([(f"x/version_{v}/checkpoints/epoch=1-step=2.ckpt",) for v in (1, 2, 10)], "path string")
    found = catalog.parsed(paths)
    assert sorted(r.version for r in catalog.expired(found, 1).collect()) == [1, 2]
    assert catalog.expired(found, 0).count() == 3
    assert catalog.last_version(found).first().version == 10


def test_json_and_html(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Š ą😀", [(0, 2, 1)])], "id long, text string, chunks array<struct<start:int,len:int,label:int>>")
    space = LabelSpace(("h",), ((0, 1),))
    document = corpus_json.corpus_document(rows, space).first().json
    path = tmp_path / "corpus.json"
    path.write_text(document)
    assert corpus_json.load_document(spark, str(path)).collect() == rows.collect()
    html = render.side_by_side(rows, rows.where("false"), space.names).first()
    assert "lbl=h_1" in html.ref_html and ">Š <" in html.ref_html and html.res_html == ""


def test_a_document_is_never_one_row(spark, tmp_path):
    space = LabelSpace(("h",), ((0, 1),))
    odd = ['"]}', "]}", ',{"id":1}', "a\n]}\r\n\u2028\\n", "", None, "Š ą😀", '{"labelDefs":{},"texts":[']
    rows = [(i, t, [(0, 2, i % 2)]) for i, t in enumerate(odd * 20)] + [(3, "again", []), (3, "again", None), (None, "no id", [])]
    for number, some in enumerate((rows, rows[:1], [])):
        texts = spark.createDataFrame(some, "id long, text string, chunks array<struct<start:int,len:int,label:int>>").repartition(5)
        home = tmp_path / str(number)
        corpus_json.save_document(texts, space, str(home))
        (part,) = home.glob("part-*")
        lines = part.read_text(encoding="utf-8").split("\n")[:-1]
        assert len(lines) == len(some) + 2
        assert json.loads("".join(lines)) == json.loads(corpus_json.corpus_document(texts, space).first().json)
        count = lambda df: collections.Counter(map(repr, df.collect()))
        assert count(corpus_json.load_document(spark, str(home))) == count(texts)
        laid = tmp_path / f"{number}.json"
        laid.write_text(json.dumps(json.loads("".join(lines)), indent=1), encoding="utf-8")
        assert count(corpus_json.load_document(spark, str(laid))) == count(texts)


def test_optional_columns_are_all_or_none(spark, tmp_path):
    windows = spark.createDataFrame([(1, [1]), (2, None)], "enc_id long, token_ids array<int>")
    with pytest.raises(ValueError):
        corpus_json.save_dataset(windows, windows, str(tmp_path / "d"))


def test_token_labels_use_neutral(spark):
    space = LabelSpace(("h", "k"), ((0, 1), (0, 1)))
    units = spark.createDataFrame([(1, 0, 0, 2, False), (1, 1, 3, 3, False), (1, 2, 4, 6, True), (1, 3, 9, 11, False)], "text_id long, word int, start int, end int, special boolean")
    spans = spark.createDataFrame([(1, 0, 0, 8, 3), (1, 1, 0, 8, 1)], "text_id long, chunk_no int, c_start int, c_len int, label int")
    got = {r.word: r.labels for r in samples.label_lists(units, spans, ["text_id", "word"], space).collect()}
    assert got == {0: [3, 1], 1: [0, 2], 2: [0, 2], 3: []}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert {k: got.get(k, k) for k in (1, 3, 4, 5, 8, 9)} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components.connected_components(edges.where("false")).count() == 0


def test_stream(spark, tmp_path):
    from spanloom.streaming.scored_stream import merge_stream

    rows = spark.createDataFrame([(1, 0, 0, [0.2, 0.8]), (1, 0, 1, [0.6, 0.4])], "text_id long, start_word int, place int, confs array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    merge_stream(stream, 2, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=700))
def test_running_sums(spark, values):
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    assert df.select(tokens.running(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(len(values))]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["▁a", "b", "▁"]), st.booleans()), min_size=1, max_size=12))
def test_words_in_the_row_are_those_of_rows(spark, pieces):
    made = [(i, None, p, 2 * i, 2 * i + 1, s) for i, (p, s) in enumerate(pieces)]
    df = spark.createDataFrame([(1, made)], f"text_id long, tokens array<{tokens.TOKEN}>")
    numbers = df.select(tokens.word_numbers(F.col("tokens"))).first()[0]
    rows = tokens.with_words(tokens.token_rows(df))
    assert numbers == [r.word for r in rows.orderBy("pos").collect()]
    want = sorted(tuple(r)[1:] for r in tokens.word_spans(rows).collect())
    got = df.select(F.inline(tokens.words_of(F.col("tokens")))).collect()
    assert [(r.word, r.start, r.end, r.n_tokens) for r in got] == want


def test_empty_texts_give_no_samples(spark):
    space = LabelSpace(("h",), ((0, 1),))
    chunk = "array<struct<start:int,len:int,label:int>>"
    texts = spark.createDataFrame([(1, "", [(0, 0, 1)]), (2, None, []), (3, "a  b", [(0, 1, 1)])], f"id long, text string, chunks {chunk}")
    got = samples.word_samples(texts, space, 8).orderBy("target").collect()
    assert [(r.text_id, r.target, r.labels) for r in got] == [(3, 0, [0, 1]), (3, 1, [1, 0]), (3, 2, [0, 0])]
    assert tokens.word_rows(texts.select(F.col("id").alias("text_id"), "text")).where("text_id < 3").count() == 0


def test_window_slices(spark):
    df = spark.createDataFrame([(list(range(7)),), ([],)], "u array<int>")
    got = [[tuple(w) for w in r[0]] for r in df.select(tokens.window_slices(F.col("u"), 4, 0.5)).collect()]
    assert [(s, n, u) for s, n, u, _ in got[0]] == [(0, 4, [0, 1, 2, 3]), (2, 4, [2, 3, 4, 5]), (4, 3, [4, 5, 6]), (6, 1, [6])]
    assert got[0][3][3] == [1] and got[1] == []
    padded = spark.range(1).select(tokens.padded(F.array(F.lit(1), F.lit(2)), 4, F.lit(0))).first()[0]
    assert padded == [1, 2, 0, 0]


TOKENIZER_FILE = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.skipif(not os.path.exists(TOKENIZER_FILE), reason="no tokenizer file here")
def test_file_tokenizer(spark):
    texts = spark.createDataFrame([(1, "hello big world"), (2, ""), (3, "a<|endoftext|>b")], "text_id long, text string")
    made = {r.text_id: r.tokens for r in tokens.FileTokenizer(TOKENIZER_FILE).tokenised(texts).collect()}
    assert "".join("hello big world"[t.start : t.end] for t in made[1]) == "hellobigworld" and made[2] == []
    assert [t.special for t in made[3]] == [False, True, False]
    kept = {r.text_id: r.tokens for r in tokens.FileTokenizer(TOKENIZER_FILE, unk="<|endoftext|>").tokenised(texts).collect()}
    assert [t.special for t in kept[3]] == [False, False, False]
    rows = tokens.token_rows(tokens.FileTokenizer(TOKENIZER_FILE).tokenised(texts))
    vectors = tokens.ContextEmbedder(lambda ids: np.stack([ids, np.full(len(ids), len(ids))], axis=1).astype(float)).embedded(rows)
    assert sorted(r.embedding[1] for r in vectors.where("text_id = 1").collect()) == [3.0, 3.0, 3.0]
    table = rows.select(F.col("id").alias("token_id"), F.array(F.col("id").cast("double")).alias("embedding")).distinct()
    assert tokens.TableEmbedder(table).embedded(rows).where("embedding[0] = id").count() == rows.count()


def test_special_predicate(spark):
    df = spark.createDataFrame([(1, 7, 0, 2), (1, 1, 0, 2), (0, 5, 3, 3), (0, 5, 3, 4)], "m int, id int, s int, e int")
    got = df.select(tokens.is_special(F.col("m"), F.col("id"), 1, F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_any_scorer_is_explained(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(3, 4)), rng.normal(size=(4, 5))
    for head in (0, 1):
        known = explain.integrated_gradients(x, w, [2, 3], head, 20)
        assert np.allclose(explain.gradients_by_difference(x, explain.linear_softmax(w, [2, 3]), [2, 3], head, 20), known, atol=1e-6)
    model = encoder.Encoder(4, [2, 3], layers=1, heads=2)
    windows = spark.createDataFrame([(1, 0, x.tolist())], "text_id long, start_word int, embeds array<array<double>>")
    assert explain.explained(windows, model, [2, 3], 3).count() == 2 * 9


def test_encoder_takes_token_ids():
    table = np.random.default_rng(0).normal(size=(10, 8))
    model = encoder.Encoder(8, [2], heads=2, table=table)
    assert np.allclose(model(np.array([3, 1])), model(table[[3, 1]]))
    with pytest.raises(ValueError):
        encoder.Encoder(8, [2], heads=2)(np.array([1]))


def test_too_long_windows_are_refused(spark):
    scorer = scoring.ArrowScorer(lambda x: x, [1], max_len=1)
    windows = spark.createDataFrame([(1, 0, [[1.0], [2.0]])], "text_id long, start_word int, embeds array<array<double>>")
    with pytest.raises(Exception, match="longer than the model"):
        scorer.score(windows).collect()


def test_model_evaluation_is_the_forward_pass(spark):
    x = np.random.default_rng(5).normal(size=(4, 8))
    windows = spark.createDataFrame([(1, 0, x.tolist())], "text_id long, start_word int, embeds array<array<double>>")
    wanted = spark.createDataFrame([(i, 1, 0, i, [1, 0, 0, 0, 1]) for i in range(4)], "sample_idx long, text_id long, start_word int, target int, labels array<int>")
    models = {v: scoring.ArrowScorer(encoder.Encoder(8, [2, 3], layers=v, heads=2), [2, 3]) for v in (1, 2)}
    for r in scoring.evaluated(models, windows, wanted).collect():
        confs = encoder.Encoder(8, [2, 3], layers=r.model_version, heads=2)(x)[r.sample_idx]
        assert np.allclose(r.confidence, confs, atol=1e-6)
        assert [i for i, f in enumerate(r.found_labels) if f] == [int(confs[:2].argmax()), 2 + int(confs[2:].argmax())]


def test_sheet_keeps_its_order(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Comment,HS Level\n" a ""q""\nb ",level 2\nc,LEVEL 4\n')
    rows = ingest.loaded_rows(ingest.read_sheet(spark, str(tmp_path / "s.csv"), "gender")).orderBy("row_in_file").collect()
    assert [(r.row_in_file, r.text, r.lvl_gender_hate, r.lvl_religion_hate) for r in rows] == [(0, 'a "q"\nb', 2, 0), (1, "c", 4, 0)]


def test_checkpoint_folders(spark, tmp_path):
    for v, e in ((0, 3), (0, 12), (2, 1)):
        folder = tmp_path / f"lightning_logs/version_{v}/checkpoints"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"epoch={e}-step=5.ckpt").write_text("x")
    found = catalog.checkpoints(spark, str(tmp_path))
    assert [(r.version, r.epoch) for r in catalog.versions(found).collect()] == [(0, 12), (2, 1)]
    assert [r.version for r in catalog.with_checkpoints(found).collect()] == [0, 2]
    assert catalog.checkpoint_path(found, 0).endswith("version_0/checkpoints/epoch=12-step=5.ckpt") and catalog.checkpoint_path(found, 1) is None
    bare = spark.createDataFrame([("l/version_0/checkpoints/epoch=4-step=1.ckpt",), ("l/version_1/hparams.yaml",), ("l/version_2/checkpoints/epoch=0-step=1.ckpt",)], "path string")
    assert [r.last_epoch for r in catalog.cumulative_epochs(catalog.parsed(bare), assumed=10).collect()] == [4, 5, 15]
    with pytest.raises(Exception, match="no checkpoint"):
        catalog.cumulative_epochs(catalog.parsed(bare)).collect()


def test_dataset_is_appended_to(spark, tmp_path):
    home = str(tmp_path / "d")
    corpus_json.create_dataset(spark, home)
    windows = spark.createDataFrame([(1, 5, 0, 2, [3, 4])], "enc_id long, text_id long, start_word int, n int, token_ids array<int>")
    rows = spark.createDataFrame([(0, 5, 1, 0, [1]), (1, 5, 1, 1, [0])], "sample_idx long, text_id long, enc_id long, target int, labels array<int>")
    corpus_json.append_dataset(windows, rows, home)
    stored, held = corpus_json.load_dataset(spark, home)
    assert stored.first().token_ids == [3, 4] and permute.loaded(held, stored).where("NOT by_vectors").count() == 2
    with pytest.raises(ValueError):
        corpus_json.append_dataset(windows.withColumn("token_ids", F.lit(None).cast("array<int>")), rows, home)
    assert corpus_json.empty_like(stored).count() == 0 and corpus_json.delete_dataset(spark, home) and not (tmp_path / "d").exists()


def test_quotas_with_one_common_vector(spark):
    rows = spark.range(500).select(F.col("id").alias("sample_idx"), F.array(F.when(F.col("id") < 470, 1).otherwise(0)).alias("labels"))
    got = split.quota_folds(rows, [0.9, 0.1]).join(rows, "sample_idx").groupBy("labels", "fold").count().collect()
    assert {(r.labels[0], r.fold): r["count"] for r in got} == {(1, 0): 423, (1, 1): 47, (0, 0): 27, (0, 1): 3}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30))
def test_exact_folds_are_the_sequential_rule(spark, marks):
    hot = [[int(m == k) for k in range(4)] for m in marks]
    df = spark.createDataFrame(list(enumerate(hot)), "sample_idx long, labels array<int>")
    got = {r.sample_idx: r.fold for r in split.exact_folds(df, [0.75, 0.25], seed=3).collect()}
    assert [got[i] for i in range(len(marks))] == split.stratified(np.array(hot), [0.75, 0.25], 3).tolist()
    assert np.bincount(list(got.values()), minlength=2).tolist() == split.fold_counts(len(marks), [0.75, 0.25])
