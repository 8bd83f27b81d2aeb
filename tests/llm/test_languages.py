"""Language ID over more languages than a byte can count."""

import random

import numpy as np

from siltgauge.llm import langid


def test_every_language_of_a_large_table_is_learned(spark):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(230):
        words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(6)]  # words that only this language has
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(12)), f"l{k:03}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 230
    got = langid.label(docs, model).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == r["lang"] for r in got)


def test_labels_hold_any_number_of_languages():
    scores = np.full((4, 300), -9.0, np.float32)
    scores[:, 299] = 0
    assert langid.viterbi([scores], 1.0)[0].tolist() == [299] * 4


def plain_viterbi(scores, penalty):
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        jump = value.max() - penalty
        back.append(np.where(jump > value, value.argmax(), np.arange(len(value))))
        value = np.maximum(value, jump) + row
    label = [int(value.argmax())]
    for b in reversed(back):
        label.append(int(b[label[-1]]))
    return label[::-1]


def test_cuts_change_no_label():
    rng = np.random.default_rng(5)
    seen = 0
    for k in range(2, 7):
        for _ in range(25):
            n = int(rng.integers(100, 1500))
            lead = np.repeat(rng.integers(0, k, n), rng.integers(1, 60, n))[:n]
            scores = -rng.exponential(3, (n, k)) * (rng.random((n, k)) < 0.9)
            scores[np.arange(n), lead] = 0
            scores -= scores.max(1, keepdims=True)
            seen += len(langid.cuts(scores.astype(np.float32), 6.0))
            assert langid.viterbi([scores], 6.0)[0].tolist() == plain_viterbi(scores, 6.0)
    assert seen > 200


def test_number_signs_are_no_letters_and_scripts_without_spaces_have_spans(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the house is small", "en"), ("日本語のテキストです", "ja"), ("это небольшой дом", "ru")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "² ½ ①"), (2, "the house 日本語のテキストです это небольшой дом"), (3, None), (4, "the house " * 3 + "日本語のテキストです" * 200)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.label(odd, model, penalty=2.0, spans=True).collect()}
    assert got[1]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert [s["lang"] for s in got[2]["spans"]] == ["en", "ja", "ru"]
    assert got[4]["lang_pred"] == "ja" and got[4]["spans"][1]["end"] > 500


def test_clashing_columns_and_hot_languages(spark):
    text = {"en": "the house is small", "fr": "la maison est petite"}
    rows = [(k, text[g], g, 1, "x", 0.5) for k in range(4000) for g in ["fr" if k % 40 == 0 else "en"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, pick int, lang_pred string, score double")
    few = langid.smallest(docs.select("lang", "doc_id"), "lang", "doc_id", 100).collect()
    assert sum(r["lang"] == "en" for r in few) == 100 == sum(r["lang"] == "fr" for r in few)
    got = langid.identify(docs).collect()
    assert len(got) == 4000 and {(r["lang_pred"] == ("fr" if r["doc_id"] % 40 == 0 else "en")) for r in got} == {True}
    same = spark.createDataFrame([(7, text["en"], "en")] * 50 + [(8, text["fr"], "fr")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(same).collect()} <= {"en", "fr", "und"}
