import random
import re

from lodestone.llm import decontaminate as D


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for k, it in items:
            v = split(it)
            if k is None or not v:
                continue
            n = min(10, len(v))
            windows = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found.add(str(k))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def sample():
    r = random.Random(3)
    vocab = ["the", "of", "É", "été", "x1", "Rare"] + [f"v{i}" for i in range(30)]
    items = [(None, "the of the"), (7, None), (8, "..."), (9, "Of the"), (9, "Of the"), (10, "the " * 12), (11, "x1\x0bété! rare")]
    items += [(100 + i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 30)))) for i in range(12)]
    docs = [(None, None), (1, ""), (2, "the, OF the"), (2, "the, OF the"), (2, "other text"), (None, "of the"), (3, "the " * 40), (4, "the " * 3000)]
    for i in range(60):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if i % 2:
            w = r.choice(items[7:])[1].split()
            a = r.randrange(len(w))
            t[len(t) // 2 : len(t) // 2] = [x.upper() for x in w[a : a + r.randint(1, 20)]]
        docs.append((10 + i // 2, ", ".join(t)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = sample()
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], "doc_id bigint, text string, item_id string, window string")
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, doc_id string")
    got = [(x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in D.contamination(d, b).collect()]
    assert sorted(got, key=str) == plain(docs, items)
    clean = D.clean(d, b)
    assert clean.columns == d.columns and clean.count() == sum(not x[2] for x in plain(docs, items))


def test_shuffled_index_gives_the_same(spark):
    docs, items = sample()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        places, _ = D.occurrences(d, b, most=0)
        places.count()
        plan = places._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        got = [(x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in D.contamination(d, b, most=0).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted(got, key=str) == plain(docs, items)


def test_empty_tables(spark):
    d, b = (spark.createDataFrame(x, s) for x, s in (([(1, "a b")], "doc_id bigint, text string"), ([(5, "a b")], "item_id bigint, text string")))
    assert D.contamination(d.limit(0), b).collect() == []
    assert [x.n_hit for x in D.contamination(d, b.limit(0)).collect()] == [0]


def test_no_python_in_the_plan(spark):
    docs, items = sample()
    plan = D.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert not re.search("Python|Pandas|ArrowEval|BatchEval", plan._jdf.queryExecution().toString())
