"""The recurrent network: gradients, windows, context across words, letters, the labelled sample, held-out accuracy."""

import random

import numpy as np
import pytest

from brinewood.llm import langid, learned
from brinewood.llm.queries import QUERIES


def made_up(rng, endings, n):
    return " ".join(rng.choice("bdfgklmn") + rng.choice("aeiou") + rng.choice(endings) for _ in range(n))


def test_gradients():
    model = langid.BiGru(["a", "b", "c"], hidden=3, seed=2)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = langid.padded([b"abca", b"b", b"cab"])
    y = np.array([0, 1, 2])
    _, grads = model.gradients(x, y)
    rng = np.random.default_rng(0)
    for name in model.w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in model.w[name].shape)
            if name.startswith("in_"):
                at = (at[0], int(x[0, 0]))
            old = model.w[name][at]
            losses = []
            for d in (1e-2, -1e-2):
                model.w[name][at] = old + d
                losses.append(model.gradients(x, y)[0])
            model.w[name][at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


def test_windows_label_like_the_whole_text():
    """With as much context as the text has, windows give the labels of one run over all of it; padding changes nothing."""
    model = langid.BiGru(["a", "b"], seed=1)
    texts = [b"one two three four", b"x", "aé ".encode() * 60]
    for t, row in zip(texts, model.label(texts, window=7, context=1000), strict=True):
        p, _ = model.forward(langid.padded([t]))
        assert row == pytest.approx(p[:, :, 0].mean(0), rel=1e-4)
        assert row == pytest.approx(model.label([t])[0], rel=1e-4)
    assert model.label([]).shape == (0, 2) and (model.label([b""]) == 0).all()


def test_context_across_words_decides():
    """Both languages use the same words, one in pairs that alternate, the other in pairs of equal ones."""
    rng = random.Random(3)

    def text(k, n):
        out = []
        for _ in range(n):
            w = rng.choice(["ab", "cd"])
            out += [w, w if k else "cd" if w == "ab" else "ab", "-"]
        return " ".join(out).encode()

    train = [(text(k, 40), k) for k in (0, 1) for _ in range(60)]
    model = langid.BiGru(["0", "1"], seed=1)
    model.fit([t for t, _ in train], np.array([k for _, k in train]), epochs=10, batch=16)
    test = [(text(k, 12), k) for k in (0, 1) for _ in range(60)]
    assert np.mean(model.label([t for t, _ in test]).argmax(1) == [k for _, k in test]) >= 0.95


def test_letters(spark):
    texts = ["½", "Ⅷ", "²①", "_", "12", "", None, "é", "字", "a1", "\U00010400"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = [False] * 7 + [True] * 4
    assert [langid.has_letter(t) for t in texts] == expected
    assert [r[0] for r in df.select(langid.letters(df["text"])).collect()] == expected
    model = langid.BiGru(["a", "b"])
    assert [r.lang_pred != "und" for r in langid.predict(df, model).collect()] == expected


def test_copies_do_not_flood_the_sample(spark):
    rows = [(i, "same text" if i % 10 == 0 else f"text {i}", "en") for i in range(5000)] + [(9000, "seul", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("text", "lang AS label", "xxhash64(doc_id, text) AS draw")
    sample = learned.labelled_sample(df, "label", 100)
    assert sample["label"].value_counts().to_dict() == {"en": 100, "fr": 1}
    assert 2 <= (sample["text"] == "same text").sum() <= 25
    assert sample.equals(learned.labelled_sample(df.repartition(7), "label", 100))


def test_languages_held_out(spark):
    rng = random.Random(11)
    kinds = {"xx": ["tion", "ing", "th"], "yy": ["eaux", "oux", "ée"], "zz": ["ung", "heit", "sch"]}
    rows = [(i, made_up(rng, e, rng.randint(5, 60)), k) for i in range(80) for k, e in kinds.items()]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(made_up(rng, e, 12), k) for k, e in kinds.items() for _ in range(40)] + [("123", "und"), (None, "und")]
    out = langid.predict(spark.createDataFrame(test, "text string, lang string"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def test_accuracy_on_the_table(spark):
    """Held-out documents of the given table whose language is known."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").where("held_out AND lang_pred != 'und'").join(docs.where("lang IS NOT NULL"), "doc_id").collect()
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.98
