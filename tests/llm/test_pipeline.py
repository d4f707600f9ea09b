import random

import corpus_pipeline
from lodestone.llm import quality
from tests_llm_plain import plain_contaminated, plain_normal, plain_survivors


def tables(spark, path):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    bench = [(i, " ".join(r.choice(vocab) for _ in range(14))) for i in range(5)]
    docs = [(0, None), (1, ""), (2, "  ")]
    for i in range(3, 240):
        words = [r.choice(vocab) for _ in range(r.randint(40, 120))]
        if i % 9 == 0:
            words = [w.upper() + "$$$" for w in words]
        elif i % 10 == 1:
            words = docs[r.randrange(3, len(docs))][1].split(" ") if len(docs) > 4 else words
        elif i % 10 == 2:
            words = list(docs[r.randrange(3, len(docs))][1].split(" ")) if len(docs) > 4 else words
            words[len(words) // 2] = "edited"
        elif i % 10 == 3:
            words[5:5] = bench[i % 5][1].split()[:12]
        docs.append((i, " ".join(words)))
    docs.append((77, "repeated row with an id that occurs twice"))
    docs.append((77, "repeated row with an id that occurs twice"))
    full = [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", "clash", "clash") for i, t in docs]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, keep_id string, text_key string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("$$$" not in (t or ""))) for i, t in docs[3:-2]], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return full, bench


def test_stages_match_plain_versions(spark, tmp_path):
    full, bench = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [tuple(x)[:-2] for x in quality.score(docs, model, keep=tuple(docs.columns), names=("s", "p")).collect() if x.s >= 0.7]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == 1:
            first = {}
            for x in sorted(want, key=lambda x: x[0]):
                first.setdefault(plain_normal(x[1]), x)
            want = list(first.values())
        elif k == 2:
            stay = plain_survivors(want)
            want = [x for x in want if x[0] in stay]
        elif k == 3:
            want = [x for x in want if not plain_contaminated(x[1], [t for _, t in bench])]
        if k < 4:
            assert out.columns == docs.columns
            assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
            kept.append(len(want))
            docs = out
        else:
            assert sorted({x.doc_id for x in out.collect()}) == sorted({x[0] for x in want})
    assert kept == sorted(kept, reverse=True) and len(set(kept)) == 4


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "bucket", "batch", "slot"] and got.count() > 50
