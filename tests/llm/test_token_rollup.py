import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_rollup as T

FOLDER = "/opt/tokenizers"
TOK = T.Tokenizer(FOLDER, "byte_bpe_50k")
CHANGES = "doc_id bigint, op string, source string, lang string, text string, old_source string, old_lang string, old_text string, n_tokens string"


@pytest.fixture
def path(tmp_path):
    yield str(tmp_path / "ledger")
    shutil.rmtree(tmp_path, ignore_errors=True)


def plain(docs):
    encode = T.encoder(TOK.read()).encode_ordinary
    out = {}
    for source, lang, text in docs:
        row = out.setdefault((source, lang, TOK.version), [0, 0, 0])
        for k, v in enumerate((1, len(text or ""), len(encode(text or "")))):
            row[k] += v
    return Counter((*k, *v) for k, v in out.items())


def test_totals_follow_any_changes(spark, path):
    r = random.Random(6)
    text = lambda: r.choice([None, "", "ß ünï 𝔘 text", "a" * 5000, " ".join(r.choice(["one", "two", "thre3", "!?"]) for _ in range(r.randint(1, 50)))])
    ledger, live = T.Ledger(spark, path), {}
    for n in range(3):
        rows = []
        for i in range(40):
            key, new = r.randint(0, 60), (r.choice(["s0", "s0", "s1", None]), r.choice(["en", None]), text())
            if any(x[0] == key for x in rows):
                continue
            old = live.get(key, (None, None, None))
            op = "insert" if key not in live else r.choice(["delete", "revise"])
            rows.append((key, op, *(new if op != "delete" else (None, None, None)), *old, "clash"))
            live.pop(key) if op == "delete" else live.update({key: new})
        batch = T.deltas(T.signed_rows(spark.createDataFrame(rows, CHANGES)), TOK)
        assert ledger.commit(f"b{n}", batch) and not ledger.commit(f"b{n}", batch)
        assert Counter(map(tuple, ledger.totals().collect())) == plain(live.values())
        if n == 1:
            ledger.compact()
            assert not ledger.commit("b0", batch)
    ledger.compact()
    ledger.compact()
    assert Counter(map(tuple, ledger.totals().collect())) == plain(live.values())


def test_a_half_written_batch_does_not_count(spark, path):
    ledger = T.Ledger(spark, path)
    rows = T.deltas(spark.createDataFrame([(1, "s", "en", "some text")], "sign int, source string, lang string, text string"), TOK)
    rows.write.parquet(f"{path}/batch-x")
    T.remove(spark, f"{path}/batch-x/_SUCCESS")
    assert ledger.totals().collect() == [] and ledger.commit("x", rows) and ledger.totals().count() == 1


def test_empty_batch_and_unknown_change(spark, path):
    ledger = T.Ledger(spark, path)
    none = spark.createDataFrame([], CHANGES)
    assert ledger.commit("none", T.deltas(T.signed_rows(none), TOK)) and ledger.totals().collect() == []
    with pytest.raises(Exception, match="unknown change"):
        T.signed_rows(spark.createDataFrame([(1, "replace", *[None] * 7)], CHANGES)).collect()
    with pytest.raises(ValueError):
        ledger.commit("../x", T.deltas(T.signed_rows(none), TOK))


def test_long_runs_are_counted_as_the_pattern_would(monkeypatch):
    r = random.Random(3)
    parts = ["a", "b ", " ", "\n", "\t", ".", "'s", "1", "\x1c", "\x85", "\u2003", "ü"]
    monkeypatch.setattr(T, "LONG_RUN", 3)
    short = T.Counter(TOK.read())
    for _ in range(500):
        text = "".join(r.choice(parts) * r.choice([1, 1, 2, 9]) for _ in range(r.randint(0, 9)))
        assert short.count(text) == len(short.encode(text)), repr(text)
    monkeypatch.undo()
    whole = T.Counter(TOK.read())
    for c in (" ", "\n", "\u2003", "a", "^", "\u0301"):
        assert whole.count("x" + c * 2_000_000 + "y") > 100_000


def test_recount_moves_totals_between_versions(spark, path):
    other = T.Tokenizer(FOLDER, "byte_bpe_multi_50k")
    rows = [("s", "en", "some words, 12 ñandú"), ("s", None, None), (None, "de", "Straße"), ("s", "en", "some words, 12 ñandú")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "source string, lang string, text string, n_tokens string")
    ledger = T.Ledger(spark, path)
    ledger.commit("a", T.deltas(docs.withColumn("sign", F.lit(1)), other))
    assert {x.tokenizer for x in ledger.totals().collect()} == {other.version}
    ledger.compact()
    for _ in range(2):
        ledger.commit("b", T.recounted(docs, other, TOK))
    ledger.compact()
    assert not ledger.commit("b", T.recounted(docs, other, TOK))
    assert Counter(map(tuple, ledger.totals().collect())) == plain(rows)


def test_versions_are_counted_in_one_pass(spark):
    old, new = (T.Tokenizer("/opt/tokenizers", v) for v in ("byte_bpe_multi_50k", "byte_bpe_50k"))
    rows = spark.createDataFrame([(1, "s", "en", "some text here"), (1, "s", "en", None), (-1, None, "de", "ein Text, ein Wort")], "sign int, source string, lang string, text string")
    both = T.count_versions(rows, [old, new], ["sign"])
    for at, t in enumerate((old, new)):
        one = T.count_tokens(rows, t, ["sign"])
        assert sorted((r.n_chars, r.n_tokens) for r in one.collect()) == sorted((r.n_chars, r.n_tokens[at]) for r in both.collect())
    counted = T.count_versions(rows, [old, new], ["sign", "source", "lang"])
    assert sorted(map(str, T.summed(counted, {old.version: F.lit(1), new.version: F.lit(0)}).collect())) == sorted(map(str, T.deltas(rows, old).collect()))


def test_the_query_ends_with_the_second_version_alone(spark, tmp_path):
    from lodestone.llm.queries import op1_token_counts

    docs = [(i, None if i == 3 else f"text number {i} " * (i % 5), ["en", "de", None][i % 3], ["a", "b", None][i % 4 % 3]) for i in range(40)]
    spark.createDataFrame([(*d, 7) for d in docs], "doc_id bigint, text string, lang string, source string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang): (r.tokenizer, r.n_docs, r.n_chars, r.n_tokens) for r in op1_token_counts(spark, str(tmp_path)).collect()}
    count = T.Counter(T.Tokenizer("/opt/tokenizers", "byte_bpe_50k").read()).count
    want = {}
    for _, text, lang, source in docs:
        _, n, c, t = want.get((source, lang), ("", 0, 0, 0))
        want[source, lang] = ("byte_bpe_50k", n + 1, c + len(text or ""), t + count(text or ""))
    assert got == want
