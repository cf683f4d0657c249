"""Benchmark windows against brute force."""

from __future__ import annotations

import pickle
import random
import re

import pytest

from tessella.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(raw)


def plain(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, item_text in items:
        own = plain_words(item_text)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if own else ():
            for i in range(len(words) - n + 1):
                if words[i:i + n] == own[k:k + n]:
                    found.add(item)
                    hit |= set(range(i, i + n))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (7, "The quick brown fox jumps over the lazy dog again and again"), (12, "alpha BETA gamma"), (3, "alpha beta gamma"), (4, None), (5, ""), (6, "-- ..!"), (8, "Éa ßb 12 x y z one two three four five"),
    (9, "one two three four five six seven eight nine ten"), (11, "ten"), (10, "a a a a a a a a a a a a"),
]
TEXTS = [
    None, "", "nothing here", "before the QUICK, brown; fox-jumps over THE lazy dog again and again after", "the quick brown fox jumps over the lazy dog", "alpha, beta... gamma delta alpha beta", "ÉA! ßb 12 x y z one two three four five six",
    "a " * 30, "one two three four five six seven eight nine ten eleven", "brown fox jumps over the lazy dog again and again brown fox", "x" * 3000 + " ten", "gamma alpha beta gamma alpha beta gamma",
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, doc_id int, digest int")


@pytest.mark.parametrize("block_bytes", [64 << 20, 60])
def test_hits_are_those_of_brute_force(make_docs, benchmark, block_bytes):
    rows = decontam.scan(make_docs(TEXTS), benchmark, block_bytes=block_bytes).collect()
    found = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in rows}
    assert found == {i: plain(t, ITEMS) for i, t in enumerate(TEXTS)}


def test_cut_text_holds_no_window_and_clean_texts_stay(make_docs, benchmark):
    docs = make_docs(TEXTS)
    cut = {r.doc_id: r.text for r in decontam.clean(docs, benchmark, remove="spans").collect()}
    assert len(cut) == len(TEXTS)
    assert cut[2] == TEXTS[2]
    assert cut[3] == "before  after"
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if not plain(t, ITEMS)[1]}


def test_empty_tables_and_repeated_rows(spark, make_docs, benchmark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontam.scan(make_docs(TEXTS), none).collect())
    assert decontam.scan(make_docs([]), benchmark).collect() == []
    assert [r.n_hit for r in decontam.scan(make_docs([(1, "ten"), (1, "ten"), (None, "ten")]), benchmark).collect()] == [1, 1, 1]
    with pytest.raises(ValueError, match="remove"):
        decontam.clean(make_docs([]), benchmark, remove="words")


def test_benchmarks_of_several_blocks_clean_as_one_block_does(make_docs, benchmark):
    docs = make_docs([*enumerate(TEXTS), (1, TEXTS[5]), (None, TEXTS[3])])
    for remove in ("documents", "spans"):
        one, many = (sorted((str(r.doc_id), r.text or "") for r in decontam.clean(docs, benchmark, remove=remove, block_bytes=b).collect()) for b in (1 << 20, 60))
        assert one == many


def test_string_keys_and_ids_and_clashing_names(spark, benchmark):
    docs = spark.createDataFrame([("a", TEXTS[5], "x"), ("b", TEXTS[2], "y")], "digest string, text string, items string")
    items = spark.createDataFrame([("i-1", ITEMS[1][1]), (None, "delta")], "item_id string, text string")
    found = {r["digest"]: (r.n_hit, r["items"]) for r in decontam.scan(docs, items, key="digest").collect()}
    assert found == {"a": (4, ["i-1"]), "b": (0, [])}
    assert decontam.clean(docs, items).columns == docs.columns
    assert {r["digest"]: r["items"] for r in decontam.scan(docs, benchmark, key="digest").collect()} == {"a": [3, 12], "b": []}


def test_very_long_texts_and_words_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["z" * 5000, "z" * 5001, "é" * 3000]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (200, 900, 3000)]
    items = [(i, " ".join(t.split()[k:k + n])) for i, (t, k, n) in enumerate([(texts[0], 5, 30), (texts[2], 2500, 11), (texts[1], 3, 4), (texts[1], 700, 10)])] + [(9, "z" * 5001)]
    index = decontam.NGramIndex(items, 10)
    for t in texts:
        found, spans = index.hits(decontam.Words(t.encode()))
        assert (len(plain_words(t)), sum(b - a for a, b in spans), sorted(found)) == plain(t, items)
    big = decontam.Words(("many words " * 200_000 + texts[0]).encode())
    assert len(big) == 400_200 and index.hits(big)[0] >= {0}


def test_an_index_is_a_few_times_its_text():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(2, 9) + str(rng.randint(0, 99)) for _ in range(300))) for i in range(1000)]
    assert len(pickle.dumps(decontam.NGramIndex(items, 10))) < 8 * sum(len(t) for _, t in items) + (1 << 20)
