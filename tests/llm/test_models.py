import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from factloom.llm import language_id, quality
from factloom.llm import text_kernels as tk

WORDS = {"en": "the of and with that there house water never think", "de": "der und nicht für über schön Haus Wasser niemals auch", "fr": "été avec être pour où maison eau jamais aussi les"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)) + "."


def documents(n=240):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        lang, good = rng.choice(list(WORDS)), rng.random() < 0.7
        text = sentence(rng, lang, rng.randint(5, 60))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), lang, "s", 1))
        labels.append((i, int(good)))
    edge = [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "12 34 !!", None, "s", 1), (None, sentence(rng, "de", 9), "de", "s", 1), (5, rows[5][1], rows[5][2], "s", 1), (1003, sentence(rng, "fr", 30000), "fr", "s", 1)]
    return rows + edge, labels + [(5, labels[5][1]), (7, None), (None, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = documents()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, features int"), spark.createDataFrame(labels, "doc_id long, quality int"), rows, dict(labels)


def held(key):
    return key is None or zlib.crc32(str(key).encode()) % 3 == 1


def test_quality_separates_held_out_rows(tables):
    docs, labels, rows, marks = tables
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    test = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == marks[r.doc_id] for r in test]) > 0.95
    assert len({r.score for r in found if r.doc_id == 5}) == 1


def test_rows_pass_through_with_a_score(tables):
    docs, labels, rows, _ = tables
    scored = quality.score_rows(docs, quality.train(docs, labels), "text")
    assert scored.columns == ["doc_id", "text", "lang", "features", "score"]
    assert sorted(((r.doc_id, r.text) for r in scored.collect()), key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)


def test_quality_without_labels_or_rows(spark, tables):
    docs, labels, _, _ = tables
    assert {r.predicted for r in quality.classify(docs, labels.limit(0)).collect()} == {1}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    ratio = quality.log_count_ratio(rows, y)
    assert ratio[0] > 0 > ratio[1] and abs(ratio[2]) < 1e-9
    weight, bias = quality.dual_coordinate_descent(rows, ratio, y, cost=10, epochs=50)
    margins = [(ratio[r] / np.sqrt((ratio[r] ** 2).sum())) @ weight[r] + bias for r in rows]
    assert min(margins[:2]) > 0.9 and max(margins[2:]) < -0.9


def test_language_of_held_out_rows(tables):
    docs, _, rows, _ = tables
    truth = {r[0]: r[2] for r in rows}
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (1000, 1001, 1002)} == {"und"}
    test = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.97
    assert next(r.lang_pred for r in found if r.doc_id == 1003) == "fr"


def test_language_without_rows_to_learn_from(spark, tables):
    docs = tables[0]
    assert language_id.identify(docs.limit(0)).count() == 0
    blind = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.identify(blind).collect()} == {"und"}


def test_counts_and_weights():
    (chunk,) = tk.text_chunks(pa.array(["aa b", "", "AA b", "1"]))
    counts, lettered = language_id.term_counts(chunk)
    assert lettered.tolist() == [True, False, True, False]
    assert (counts[0] == counts[2]).all() and counts[1].sum() == 0
    x = language_id.tf_idf(counts, np.ones(language_id.BUCKETS))
    assert np.allclose((x[0] ** 2).sum(), 1)


def test_temperature_lowers_the_loss():
    logits, labels = np.array([[4.0, 0.0], [4.0, 0.0], [0.0, 4.0], [4.0, 0.0]]), np.array([0, 0, 1, 1])
    assert language_id._temperature(logits, labels) > 1.5


def test_elastic_net_leaves_zero_weights():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))] * 20
    weight, _ = language_id.follow_the_regularised_leader(rows, np.array([0, 1] * 20), 2, lasso=0.5)
    assert np.count_nonzero(weight[2:]) == 0 and weight[0, 0] > 0 > weight[0, 1]


def test_three_hundred_languages_share_the_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 1500)
    names = [f"l{k:03d}" for k in range(300)]
    rows = [(i, f"{chr(0x4E00 + 3 * (i % 300))}{chr(0x4E01 + 3 * (i % 300))} " * 5, names[i % 300]) for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == names
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs.where("doc_id < 300"), model).collect()}
    assert sum(found[i] == names[i] for i in range(300)) > 270


def test_long_labelled_texts_are_learned_from_whole_but_fewer(spark, monkeypatch):
    rng = random.Random(6)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(130_000)) for _ in range(6)]
    docs = spark.createDataFrame([(i, long[i % 6] if i < 24 else sentence(rng, "en", 12)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 24)) for i in range(120)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda rows, marks: seen.update(rows=rows, marks=marks))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 4 << 20)
    quality.train(docs, labels)
    assert all(len(r) > 100_000 for r, m in zip(seen["rows"], seen["marks"], strict=True) if m == 0)
    assert 0 < (seen["marks"] == 0).sum() < 13 and (seen["marks"] == 1).sum() > 40


def brute_indicators(text):
    """The n-gram indicators of one text in plain Python, without hashing: what must be told apart."""
    words = [w.lower() for w in text.split()]
    return set(words) | set(zip(words, words[1:], strict=False))


def test_word_indicators_are_those_of_a_plain_count():
    texts = ["one two two three", "", "Three one TWO one two"]
    (chunk,) = tk.text_chunks(pa.array(texts))
    dense, of, feature = quality.indicators(chunk)
    sets = [set(feature[of == i].tolist()) for i in range(3)]
    plain = [brute_indicators(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    assert len(sets[0] & sets[2]) == len(plain[0] & plain[2])
    assert dense[1].sum() == 0
