import random

from lodestone.llm import langid


def language(seed, letters):
    """Texts of 20,000 invented words with the letters' frequencies."""
    r = random.Random(seed)
    words = ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(20_000)]
    return lambda chars: " ".join(r.choices(words, k=chars // 6))


def languages():
    common, rest = "etaoinshr", "dlcumwfgypbvkjxqzäöüéèñß"
    return {f"l{i}": language(i, common * 6 + rest + common[i::4] * 12 + rest[i::4] * 6) for i in range(4)}


def test_pieces_hold_every_ngram_of_the_text():
    text = "".join(random.Random(2).choices("abcdefgh ", k=10_000))
    for n in langid.ORDERS:
        whole = {text[i : i + n] for i in range(len(text) - n + 1)}
        assert {p[i : i + n] for p in langid.pieces(text) for i in range(len(p) - n + 1)} == whole
    assert langid.pieces(None) == [""] and langid.pieces("Ab") == ["ab"]


def test_long_texts_keep_their_language(spark):
    made = languages()
    rows = [(i, f(1500), lang) for i, (lang, f) in enumerate((n, f) for n, f in made.items() for _ in range(100))]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    sizes = [1500, 200_000, 4_000_000]
    long = [(1000 + i, f(k), lang) for i, (k, lang, f) in enumerate((k, n, f) for k in sizes for n, f in made.items())]
    got = langid.predict(spark.createDataFrame(long, "doc_id bigint, text string, lang string"), model, keep=("doc_id", "lang")).collect()
    assert len(got) == len(long) and all(x.lang_pred == x.lang and x.score > 0.55 for x in got), got
