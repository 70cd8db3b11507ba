"""Corpus operators do the whole job, however small their tables in memory are."""

import numpy as np
import pytest

from lamella.llm import attention_lm, merge_dropout

SCHEMA = "doc_id long, text string"


def test_frequent_words_reach_the_driver_and_all_others_are_joined(spark, monkeypatch):
    words = "the cat sat on a mat and saw that other dog run far into some deep wood".split()
    docs = spark.createDataFrame([(k, " ".join(words[(k * j + j * j) % len(words)] for j in range(40))) for k in range(60)], SCHEMA)
    base = lambda: {r.doc_id: (r.base_score, r.n_known) for r in attention_lm.score_documents(docs, docs.doc_id % 5 != 1).collect()}
    want = base()
    for head in (0, 5):
        monkeypatch.setattr(attention_lm, "HEAD", head)
        got = base()
        assert all(got[k] == (pytest.approx(want[k][0], rel=1e-9), want[k][1]) for k in want) and got.keys() == want.keys()


def test_attention_beats_the_base_score_on_held_out_documents(spark):
    from lamella.llm import registry

    got = registry.op8_attention_lm(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_least_count_of_the_most_frequent(spark):
    counts = spark.createDataFrame([(k, c) for k, c in enumerate([1] * 50 + [2] * 7 + [5000, 5100, 9000, 10**12])], "key long, c long")
    for most, kept in ((0, 0), (3, 2), (4, 4), (10, 4), (11, 11), (61, 61)):
        assert counts.where(counts.c >= attention_lm._bar(counts, most)).count() == kept, most


def test_every_occurrence_of_a_word_draws_its_own_dropout(spark):
    word = " international"
    docs = spark.createDataFrame([(1, word * 400), (2, word * 400), (1, word * 400)], SCHEMA)
    codec = merge_dropout.PieceCodec(merge_dropout.vocabulary_path("piece_bpe_32k.model"))
    rows = merge_dropout.encode(docs, drop=0.3).collect()
    seen = []
    for r in rows:
        ends = np.cumsum([len(codec.bytes[i]) for i in np.frombuffer(r.ids, "<u4")]) - 1
        inner = [tuple(e % len(word) for e in ends[(ends > k * len(word)) & (ends < (k + 1) * len(word))]) for k in range(1, 400)]
        assert len(set(inner)) > 30  # segmentations of one word inside a line
        seen.append((r.doc_id, r.ids))
    assert len(set(seen)) == 2  # equal rows alike, documents apart


def test_training_steps_on_every_token(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rounds, merge = [], attention_lm.merge

    def spy(model, prior, parts, counts):
        rounds.append(sum(n for n, _ in parts))
        return merge(model, prior, parts, counts)

    monkeypatch.setattr(attention_lm, "merge", spy)
    monkeypatch.setattr(attention_lm, "MOST_PASSES", 1)
    got, train_model = [], attention_lm.train_model
    monkeypatch.setattr(attention_lm, "train_model", lambda scratch, rows, count: got.append(count.sum()) or train_model(scratch, rows, count))
    attention_lm.score_documents(docs, docs.doc_id % 5 != 1)
    assert len(rounds) == 1 + attention_lm.ROUNDS and sum(rounds[1:]) == got[0] > 100_000


def test_a_step_sees_the_block_before_its_first(monkeypatch):
    text = np.arange(1, 1 + 5 * attention_lm.BLOCK)
    tokens = attention_lm.Tokens.of(np.ones(64))
    model = attention_lm.start(tokens, np.ones((attention_lm.NEIGHBOURS + 2, attention_lm.NEIGHBOURS + 1)), steps=1)
    trainer, steps = attention_lm.Trainer(model, 40, 1, run=2), []
    step = trainer._step

    def spy(x, t, begins):
        steps.append((x.ravel().tolist(), t.ravel().tolist()))
        step(x, t, begins)

    monkeypatch.setattr(trainer, "_step", spy)
    trainer.learn([text, text[:3]])
    assert trainer.seen == len(text) + 3 and sorted(t for _, ts in steps for t in ts if t >= 0) == sorted([*text, *text[:3]])
    rows = tokens.row[text].tolist()
    for x, t in steps:
        first = next(t for t in t if t >= 0)
        if first != 1:
            before = rows[first - 1 - attention_lm.BLOCK : first - 1]
            assert x[x.index(rows[first - 2]) - attention_lm.BLOCK + 1 :][: attention_lm.BLOCK] == before


def test_the_pipeline_holds_texts_once_a_stage(spark, monkeypatch):
    import corpus_pipeline
    from lamella.llm import _scratch, language_id, toxicity

    sf = "/root/testdata/sf0.01"
    docs, written, write = spark.read.parquet(f"{sf}/documents.parquet"), {}, _scratch.Scratch.write

    def spy(self, df, name):
        written[name] = df.columns
        return write(self, df, name)

    monkeypatch.setattr(_scratch.Scratch, "write", spy)
    clear = language_id.identify(docs, language_id.train(docs)).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_LANGUAGE_SCORE}")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.language_id(spark, docs, sf)) == ids(clear)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = toxicity.score(docs, toxicity.train(docs, labels)).where(f"score < {corpus_pipeline.TOXIC_SCORE}")
    assert ids(corpus_pipeline.toxicity(spark, docs, sf)) == ids(clean)
    assert not written
    corpus_pipeline.minhash_near_dedup(spark, docs, sf)
    assert {"text", "t"} & {*written["rows"]} and not {"text", "t"} & {*written["sketch"]}
