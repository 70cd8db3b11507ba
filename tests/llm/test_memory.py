"""Workers that Spark keeps for the next task hold little of the last one."""

import os

import pyarrow as pa

from lamella.llm._memory import tidy


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20


def test_freed_memory_goes_back_after_the_last_batch():
    def run(batches):
        held = {b"%d" % k: os.urandom(300) for k in range(300_000)}
        for b in batches:
            yield b, len(held), _resident()

    before = _resident()
    ((_, n, most),) = tidy(run)(iter([1]))
    assert n == 300_000 and most > before + 80 and _resident() < before + 40


def _powers_held(spark) -> set[int]:
    def held(batches):
        from lamella.llm import _words

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_words._powers[0])])], names=["n"])

    return {r.n for r in spark.range(64).mapInArrow(held, "n long").collect()}


def test_an_idle_worker_of_the_pipeline_holds_no_powers(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    assert corpus_pipeline.language_id(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
    assert _powers_held(spark) == {1}


def test_an_idle_worker_of_the_attention_model_holds_no_powers(spark):
    from lamella.llm import attention_lm

    docs = spark.createDataFrame([(k, f"the cat number {k} sat on mat {k % 7}") for k in range(40)], "doc_id long, text string")
    assert attention_lm.score_documents(docs, docs.doc_id % 5 != 1).count() == 40
    assert _powers_held(spark) == {1}
