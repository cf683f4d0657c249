"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken

from tessella.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("block_bytes", [64, 32 << 20])
def test_ids_are_those_of_the_library_and_decode_to_the_text(make_docs, corpus, library, block_bytes):
    found = bpe.encode(make_docs(corpus).repartition(3), PATH, public_tokenizers.PATTERN, block_bytes=block_bytes, decoded=True).collect()
    assert len(found) == len(corpus)
    for r in found:
        text = corpus[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_decode_joins_the_token_table_and_keeps_columns(make_docs, corpus):
    ids = bpe.encode(make_docs(corpus), PATH, public_tokenizers.PATTERN)
    found = bpe.decode(ids, PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    assert {r.doc_id: bytes(r.decoded).decode() for r in found.collect()} == {i: t or "" for i, t in enumerate(corpus)}


def test_every_character_class_is_cut_as_the_library_cuts_it(make_docs, library):
    characters = [chr(c) for c in (*range(0x0, 0x250), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x2160, 0xB2, 0x300, 0x1F600)]
    texts = ["".join(f"a{c}b {c}{c} {c}" for c in characters[i:i + 60]) for i in range(0, len(characters), 60)]
    for r in bpe.encode(make_docs(texts), PATH, public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id])


def test_repeated_and_null_keys_and_empty_tables(make_docs, library):
    rows = [(None, "a b"), (3, "a b"), (3, "c"), (None, None)]
    found = sorted((r.doc_id is None, len(r.ids)) for r in bpe.encode(make_docs(rows), PATH, public_tokenizers.PATTERN).collect())
    assert found == sorted((k is None, len(library.encode_ordinary(t or ""))) for k, t in rows)
    assert bpe.encode(make_docs([]), PATH, public_tokenizers.PATTERN, decoded=True).collect() == []
