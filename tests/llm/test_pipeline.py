"""The pipeline's stages and its registered queries on a small folder, against brute force."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from tessella.llm import bpe
from tests.llm.test_decontam import plain

WORDS = [a + b for a in ("th", "er", "on", "in", "re", "st") for b in ("an", "ing", "ea", "or", "ly", "ou", "es")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, toxic texts and leaked benchmark items."""
    rng = random.Random(4)

    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    items = [(i, text(25)) for i in range(5)]
    docs, labels, kinds = [], [], {}
    for i in range(160):
        own = text(150)
        kind = "clean"
        if i % 8 == 1:
            words = own.split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "m0ron", "s.c.u.m", "worthless"]))
            own, kind = " ".join(words), "toxic"
        elif i % 16 == 2 and i > 16:
            own, kind = docs[i - 16 + 0][1] if kinds[i - 16] != "toxic" else own, "copy"
        elif i % 16 == 4 and i > 16:
            words = docs[i - 1][1].split()
            words[70] = "edited"
            own, kind = " ".join(words), "near"
        elif i % 16 == 6:
            own, kind = f"{own} {items[i % 5][1]} {text(20)}", "leak"
        docs.append((i, own, "en", "s", len(own)))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, kinds, items


def test_stages_drop_what_they_should_and_keep_clean_documents(spark, folder):
    at, docs, kinds, items = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "bpe"]
    rows = spark.read.parquet(f"{at}/documents.parquet")
    left = {d[0] for d in docs}
    for (name, stage), drops in zip(corpus_pipeline.STAGES[:-1], (("toxic",), ("copy", "near"), ("leak",)), strict=True):
        rows = stage(spark, rows, at)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id for r in rows.collect()}
        gone = left - kept
        expected = {i for i in left if kinds.get(i) in drops}
        if name == "near_duplicates":
            expected.add(901)  # an empty text is a copy of a null one
        assert gone == expected, name
        left = kept
    assert left >= {i for i, k in kinds.items() if k == "clean"}


def test_run_encodes_what_is_left(spark, folder):
    at, docs, kinds, items = folder
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert set(found) == {i for i, k in kinds.items() if k == "clean"} | {900}
    texts = {d[0]: d[1] or "" for d in docs}
    for i, r in found.items():
        assert r.ids == library.encode_ordinary(texts[i]) and r.n_tokens == len(r.ids)
        assert not plain(texts[i], items)[1]


def test_queries_are_registered_once_for_each_operator():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert set(__spark_entry__.oracle_sql()) <= set(names)
