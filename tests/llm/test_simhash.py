"""SimHash fingerprints, trie joins and components against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tessella.llm import simhash
from tessella.llm.store import shared_dir


def plain_print(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def close(fps, budget):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= budget]


def test_components_are_those_of_all_pairs(make_docs, corpus):
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.components(make_docs(corpus).repartition(3)).collect()}
    prints = {i: plain_print(t) for i, t in enumerate(corpus)}
    assert {k: v[0] for k, v in found.items()} == prints
    pairs = [(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4]
    assert {k: v[1] for k, v in found.items()} == plain_components(pairs, list(prints))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.sets(st.integers(0, 63), max_size=7)), max_size=40), st.integers(0, 6))
def test_tries_find_every_connection(bases, edits, budget):
    fps = sorted({*bases, *(bases[i % len(bases)] ^ sum(1 << b for b in bits) for i, bits in edits)})
    sets = simhash._Sets(len(fps))
    simhash.join_tries(np.array(fps, np.uint64), [(0, len(fps), 0, len(fps))], budget, sets)
    expected = plain_components([(fps.index(a), fps.index(b)) for a, b in close(fps, budget)], range(len(fps)))
    assert sets.label.tolist() == [expected[i] for i in range(len(fps))]
    spanning = np.concatenate(sets.spanning).tolist() if sets.spanning else []
    assert len(spanning) == len(fps) - len(set(expected.values()))
    assert all(bin(fps[a] ^ fps[b]).count("1") <= budget for a, b in spanning)


@pytest.mark.parametrize("tree_rows", [1 << 15, 7])
def test_large_trees_are_cut_and_lose_nothing(spark, tree_rows):
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 63))
    fps = {center ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 63, 50)}
    rows = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    for spanning in (False, True):
        found = [tuple(r) for r in simhash.links(rows, budget=4, spanning=spanning, tree_mean=4, tree_rows=tree_rows).collect()]
        assert plain_components(found, fps) == plain_components(close(sorted(fps), 4), fps)
        assert len(found) < 6 * 20 * len(fps)


def test_star_steps_label_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (-5, 3)]
    found = {r.node: r.label for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert found == plain_components([e for e in edges if e[0] != e[1]], nodes)


def test_empty_table_null_keys_and_repeated_rows(make_docs):
    assert simhash.components(make_docs([])).collect() == []
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, None), (3, "")]
    found = sorted(((r.doc_id, r.component) for r in simhash.components(make_docs(rows)).collect()), key=str)
    assert found == sorted([(None, 4), (4, 4), (4, 4), (2, 2), (3, 2)], key=str)


def test_near_duplicates_are_verified_by_whole_shingle_sets(make_docs, corpus):
    found = {r.doc_id: r.component for r in simhash.near_duplicates(make_docs(corpus)).collect()}
    grams = {}
    for i, t in enumerate(corpus):
        words = (t or "").encode().lower().split()
        n = min(5, len(words))
        grams[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()
    for i in grams:
        for j in grams:
            if i < j and grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                assert found[i] == found[j]
            elif i < j and corpus[i] != corpus[j] and len(grams[i] & grams[j]) < 0.5 * max(1, len(grams[i] | grams[j])) and (grams[i] or grams[j]):
                assert found.get(i, -1) != found.get(j, -2)


def test_representatives_keep_columns_and_rows_with_null_keys(make_docs, corpus):
    docs = make_docs([*enumerate(corpus), (None, corpus[5])])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 5 in ids and not {6, 7, 19} & set(ids)


def _similar_components(texts):
    grams = []
    for t in texts:
        words = t.encode().lower().split()
        grams.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))})
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    return near, plain_components(near, range(len(texts)))


def test_near_copies_that_met_through_a_third_text_are_joined(make_docs):
    rng = random.Random(3)
    texts = []
    for _ in range(12):  # all pairs of few words in many orders: all fingerprints are equal, and most neighbours in the chain are unlike
        words = rng.choices("abcde", k=400)
        texts += [" ".join(words), " ".join([*words[:200], *words[203:]])]
    rng.shuffle(texts)
    near, expected = _similar_components(texts)
    found = {r.doc_id: r.component for r in simhash.near_duplicates(make_docs(texts)).collect()}
    assert len(near) >= 12
    assert {i: found.get(i, i) for i in range(len(texts))} == {i: expected[i] for i in range(len(texts))}


BLOCK_EDITS = {
    "appended": lambda words, new: [*words, *new],
    "removed in front": lambda words, new: words[len(new):],
    "replaced": lambda words, new: [*words[:60], *new[:16], *words[76:]],
    "short": lambda words, new: [*words[:30], *new[:6]],
}


@pytest.mark.parametrize("kind", BLOCK_EDITS)
def test_block_edits_of_just_similar_texts_are_found(make_docs, kind):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        words = [f"{rng.randrange(10**6)}w" for _ in range(30 if kind == "short" else 200)]
        texts += [" ".join(words), " ".join(BLOCK_EDITS[kind](words, [f"n{i}x{k}" for k in range(38)]))]
    near, expected = _similar_components(texts)
    found = {r.doc_id: r.component for r in simhash.near_duplicates(make_docs(texts)).collect()}
    assert len(near) == 60
    assert sum(a in found and found[a] == found.get(b) for a, b in near) == 60
    assert {i: found.get(i, i) for i in range(len(texts))} == {i: expected[i] for i in range(len(texts))}


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_parity_fields_never_call_sets_further_apart_than_they_are(both, one, two):
    one, two = one | both, two | both
    fields = [simhash._parity(np.array(sorted(s), np.uint64)) for s in (one, two)]
    assert simhash._apart(*fields) <= len(one ^ two) and simhash._apart(fields[0], fields[0]) == 0


def test_near_duplicates_leave_no_shuffle_files_and_few_tables(spark, make_docs, corpus):
    rng = random.Random(3)
    texts = [*corpus, *(" ".join(rng.choices("abcdefgh", k=60)) for _ in range(200))]
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = Path(shared_dir(spark)) / "tessella"

    def there():
        files = shuffles.getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size())), len(list(folder.glob("simhash-[0-9a-f]*")))

    docs = make_docs(texts).cache()
    docs.count()
    before = there()
    found = simhash.near_duplicates(docs)
    after = there()
    assert found.count() > 1
    assert after[0] - before[0] < 30 and after[1] - before[1] <= 8
