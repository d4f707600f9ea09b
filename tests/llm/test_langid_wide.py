import random

import numpy as np

from lodestone.llm import langid


def test_every_language_has_landmarks_and_can_be_predicted(spark):
    r = random.Random(4)
    words = {f"l{i:03d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(530)}
    rows = [(i, " ".join(r.choices(v, k=40)), lang) for i, (lang, v) in enumerate((n, v) for n, v in words.items() for _ in range(8))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(d)
    assert model[2] == sorted(words) and len(model[0]) > 3 * len(words)
    got = langid.predict(d, model, keep=("doc_id", "lang")).collect()
    right = np.array([x.lang == x.lang_pred for x in got])
    assert len(got) == len(rows) and right.mean() > 0.98
    assert all(x.lang == x.lang_pred for x in got if x.doc_id % 8 == 0 and x.lang > "l512")
