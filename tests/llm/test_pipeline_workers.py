"""Python workers of the pipeline: an executor keeps them, so they count for its memory in all stages."""

import zlib

import corpus_pipeline
from lodestone.llm import quality


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    """A task takes a worker for each Python step, so between two of them there must be an exchange."""
    plans, frame = [], type(spark.range(0))

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
        return df

    collect, write = frame.collect, frame.write.fget
    monkeypatch.setattr(frame, "collect", lambda df: collect(seen(df)))
    monkeypatch.setattr(frame, "write", property(lambda df: write(seen(df))))
    rows = [(i, f"text number {i} of a few words and line {i % 7}" + " again" * (i % 5)) for i in range(60)]
    corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").count()
    assert sum("MapInArrow" in p for p in plans) >= 3
    assert all(part.count("MapInArrow") <= 1 for p in plans for part in p.split("Exchange"))


def test_a_worker_remembers_few_tokens():
    codes = quality.Codes()
    for i in range(250_000):
        assert codes[b"%d" % i] == zlib.crc32(b"%d" % i) | 1 << 32
    assert len(codes) <= 100_000
