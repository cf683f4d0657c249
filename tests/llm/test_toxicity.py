"""Restoring of disguised words, learning, held-out accuracy, and edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tessella.llm import toxicity

CLEAN = "the of and that house river stone green walking table people morning little water country garden window paper reader answer".split()
BAD = ["idiot", "moron", "worthless"]


def _corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    disguises = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w.replace("o", "ooo"), str.upper, lambda w: w + "!!"]
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(disguises)(rng.choice(BAD)))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, make_docs):
    rows, labels = _corpus()
    docs = make_docs(rows)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labelled, toxicity.fit(docs, labelled)


def test_disguised_words_are_restored(fitted):
    channel = fitted[2][0]
    for disguised, word in {"1d1ot": "idiot", "m0r0n": "moron", "i.d.i.o.t": "idiot", "w0rthless": "worthless", "mooooron!!": "moron", "(IDIOT)": "idiot", "river": "river", "g@rden": "garden"}.items():
        assert " ".join(channel.word(t) for t in toxicity.tokens(channel, disguised)) == word
    assert channel.restored("the i d i o t walking") == "the idiot walking"
    assert channel.restored("see https://a.b/1d1ot and 2024-01-02") .split()[1].startswith("https")


def test_disguises_at_edges_by_digits_doubling_look_alikes_and_length_are_restored(fitted):
    channel = fitted[2][0]
    for disguised, word in {"1d10t": "idiot", "m0r0n": "moron", "w0r7hl355": "worthless", "w0rthle$$": "worthless", "w0rthle$$!!": "worthless", "(m0r0n)": "moron", "iiddiiott": "idiot", "idi\u043et": "idiot", "m\u043er\u043en": "moron", "!d1ot,": "idiot", "mo" + "r" * 60 + "on": "moron", "m.........o.........r.........o.........n": "moron"}.items():
        assert " ".join(channel.word(t) for t in toxicity.tokens(channel, disguised)) == word
    assert channel.restored("the m 0 r 0 n, walking") == "the moron walking"
    assert channel.restored('a "! d ! o t" walking').split()[1] == "idiot"
    assert channel.restored("455 and 2024 green water!") == "455 and 2024 green water"


def test_lattice_paths_are_those_of_brute_force(fitted):
    channel = fitted[2][0]

    def cost(text, start=0.0):
        a = b = 0
        total = start
        for k in [*toxicity._CLASS[list(text.encode())].tolist(), 0]:
            total += channel.cost[(a * 40 + b) * 40 + k]
            a, b = b, k
        return total

    def readings(word):
        out = [("", 0.0)]
        run, last = 0, ""
        for i, c in enumerate(word):
            run = run + 1 if c == last else 1
            last = c
            options = [(c, 0.0 if c.isalpha() else channel.keep_symbol), *((x, channel.substitute) for x in toxicity.LEET.get(c, ""))]
            if run > 1:
                options.append(("", channel.drop_second if run == 2 and not (i + 1 < len(word) and word[i + 1] == c) else channel.drop_repeat))
            if c in toxicity._SEPARATORS:
                options.append(("", channel.drop_separator))
            out = [(t + x, p + q) for t, p in out for x, q in options]
        return out

    for word in ("1d1ot", "m0oor0n", "w.0-r", "aa1!", "st*ne", "ggg"):
        best = min(cost(t, p) for t, p in readings(word))
        assert min(p for t, p in ((t, cost(t, p)) for t, p in readings(word)) if t == channel.restore(word)) == pytest.approx(best)


def test_held_out_texts_are_told_apart(fitted):
    docs, labelled, (channel, model) = fitted
    truth = {r.doc_id: r.toxic for r in labelled.collect()}
    held = {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    found = toxicity.score(docs, channel, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert {r.doc_id for r in found if r.held} == held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    wrong = [r.doc_id for r in found if r.doc_id in held and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.02 * len(held)
    assert {r.doc_id for r in toxicity.clean(docs, channel, model).collect()} == {r.doc_id for r in found if not r.predicted}


def test_labels_of_held_out_rows_do_not_enter(spark, fitted):
    docs, labelled, (_, model) = fitted
    rows = [(r.doc_id, 0, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.toxic) for r in labelled.collect()]
    _, again = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    assert (again.lexicon, again.base, again.slope) == (model.lexicon, model.base, model.slope)


def test_null_empty_and_repeated_rows_and_repeated_lines(fitted, make_docs):
    channel, model = fitted[2]
    line = "the moron house river stone\n"
    rows = [(1, None), (2, ""), (None, "an idiot, a worthless moron"), (4, "the river"), (4, "the river"), (5, line), (6, line * 50), (7, "x " * 30000)]
    found = toxicity.score(make_docs(rows), channel, model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert by[1].score == by[2].score and by[1].words == 0
    assert by[None].predicted == 1
    assert abs(by[5].words - by[6].words) <= 1 and by[6].hits <= 2
    assert toxicity.score(make_docs([]), channel, model).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, None), (None, 0, 1)], [(k, 0, 1) for k in range(50)]])
def test_labels_of_one_class_or_none_give_one_score(spark, fitted, labels):
    docs = fitted[0]
    channel, model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len({round(r.score, 12) for r in toxicity.score(docs, channel, model).collect()}) == 1


def test_trigrams_are_counted_over_all_texts(make_docs):
    texts = ["abc", "Abd", None, "é", "ab"]
    total = toxicity.trigram_counts(make_docs(texts).repartition(3)).reshape(40, 40, 40)
    assert total[0, 1, 2] == 3 and total[1, 2, 3] == 1 and total[1, 2, 4] == 1
    assert np.array_equal(toxicity.trigram_counts(make_docs([])), np.zeros(64000))
