"""Rollups against recomputed totals; quotations against hand-made threads."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessella.llm import queries, quotes, rollup
from tessella.llm.bpe import load_ranks
from tessella.llm.store import fresh_path

ROWS = "source string, lang string, tokenizer string, n_tokens long"


def test_batches_add_up_and_commit_once(spark):
    rng = random.Random(2)
    totals = rollup.Rollup(spark, fresh_path(spark, "test"))
    expected = defaultdict(lambda: [0, 0])
    alive = []
    for batch in range(4):
        new = [(rng.choice(["a", "b", None]), rng.choice(["en", None]), "v1", rng.choice([0, 5, 900, None])) for _ in range(30)]
        gone = [alive.pop(rng.randrange(len(alive))) for _ in range(min(10, len(alive)))]
        old = [alive.pop(rng.randrange(len(alive))) for _ in range(min(5, len(alive)))]
        fresh = [(s, lang, "v2", (n or 0) * 2) for s, lang, _, n in old]
        frames = [spark.createDataFrame(x, ROWS) for x in (new, gone, old, fresh)]
        changes = rollup.inserted(frames[0]).unionByName(rollup.deleted(frames[1])).unionByName(rollup.revised(frames[2], frames[3]))
        assert totals.apply(f"b{batch}", changes) is True
        assert totals.apply(f"b{batch}", changes) is False
        alive += [*new, *fresh]
        if batch == 2:
            assert totals.compact() is True
    for s, lang, v, n in alive:
        expected[s, lang, v][0] += 1
        expected[s, lang, v][1] += n or 0
    assert totals.apply("b1", changes) is False
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in totals.totals().collect()} == dict(expected)
    assert totals.batches() == {"b0", "b1", "b2", "b3"}


def test_empty_rollups_and_batches_and_groups_that_vanish(spark):
    totals = rollup.Rollup(spark, fresh_path(spark, "test"))
    assert totals.totals().collect() == [] and totals.compact() is False
    one = spark.createDataFrame([("a", "en", "v", 4)], ROWS)
    assert totals.apply("empty", rollup.inserted(one.limit(0)))
    assert totals.apply("in", rollup.inserted(one)) and totals.apply("out", rollup.deleted(one))
    assert totals.totals().collect() == []


def test_a_batch_without_a_log_entry_does_not_count(spark):
    path = fresh_path(spark, "test")
    totals = rollup.Rollup(spark, path)
    spark.createDataFrame([("a", "en", "v", 1, 4)], rollup.SCHEMA).write.parquet(f"{path}/data/lost-1")
    totals.apply("in", rollup.inserted(spark.createDataFrame([("a", "en", "v", 4)], ROWS)))
    assert [(r.n_docs, r.n_tokens) for r in totals.totals().collect()] == [(1, 4)]


THREAD = [
    (1, 0, "user", "How do I sort a list? I tried it with a loop. It was slow."),
    (1, 1, "assistant", "> I tried it with a loop.\n\nUse sorted instead. It is fast."),
    (1, 2, "user", "On Monday, Bot <b@x.y> wrote:\n> Use sorted instead. It is\n> fast.\n\nThanks a lot!\n\n>> I tried it with a loop.\nbye"),
    (1, 3, "user", "Another question: what is a set?"),
    (1, 4, "assistant", "> > I tried it with a loop.\n> Thanks a lot!\nYou are welcome."),
    (1, 5, "assistant", "> Another question: what is a set?\nA set has no order."),
    (1, 6, "user", "> Something that nobody said.\nHm."),
    (2, 0, "user", "Thanks a lot!"),
    (2, 1, "user", "> Use sorted instead.\nnot in this conversation"),
    (3, 0, "user", None), (3, 1, "user", ""), (3, 2, None, "> > >"), (None, 4, "user", "> x"), (4, None, "user", "y"),
    (5, 0, "user", "Same line."), (5, 1, "user", "Same line."), (5, 2, "user", "> Same line.\nok"), (5, 2, "user", "twice"),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in THREAD], "conv_id long, turn long, role string, text string, path string, number int")


def test_messages_link_to_what_they_quote(messages):
    rows = quotes.linked(messages).collect()
    assert len(rows) == len(THREAD)
    found = {(r.conv_id, r.turn): r for r in rows if r.number == 1}
    assert {k: r.parent for k, r in found.items() if r.parent is not None} == {(1, 1): 0, (1, 2): 1, (1, 4): 2, (1, 5): 3, (5, 2): 1}
    assert (found[1, 4].thread, found[1, 4].reply, found[1, 4].depth) == (0, 3, 3)
    assert (found[1, 3].thread, found[1, 3].reply, found[1, 5].reply) == (3, 0, 1) and found[1, 6].parent is None and found[1, 6].quoted_passages == 1
    assert found[1, 2].own == "Thanks a lot!\n\nbye"
    assert found[1, 4].own == "You are welcome."
    assert found[3, 0].own == "" and found[3, 2].own == ""
    order = [r.turn for r in quotes.ordered(quotes.linked(messages)).collect() if r.conv_id == 1]
    assert order == [0, 1, 2, 4, 3, 5, 6]


def test_quote_levels():
    text = "a\n> b\n>> c\n> > d\nOn Tue, X wrote:\n> e\nOn time we wrote: it\nf"
    assert quotes.levels(text) == [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (1, "e"), (0, "On time we wrote: it"), (0, "f")]


def test_long_chains_and_empty_tables(spark, messages):
    rows = [(1, i, "user", f"> message number {i - 1} here.\nmessage number {i} here." if i else "message number 0 here.") for i in range(40)]
    found = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.thread, r.reply, r.depth) == (0, r.turn, r.turn) for r in found)
    assert quotes.linked(messages.limit(0)).collect() == []


def plain_links(messages):
    """Parent, linked characters, thread, reply and depth of messages (conversation, turn) -> text, by plain loops."""

    def said(text, level):
        lines = [(re.match(r"(?:> )*", line)[0], line) for line in text.split("\n")]
        parts, last = [], None
        for i, (marks, line) in enumerate(lines):
            if line == "On that day, someone wrote:" or line.endswith("> On that day, someone wrote:"):
                last = None
                continue
            if marks.count(">") == level:
                if last == level:
                    parts[-1] += " " + line[len(marks):]
                else:
                    parts.append(line[len(marks):])
            last = marks.count(">")
        out = []
        for p in parts:
            for sentence in re.split(r"(?<=[.!?\u2026])\s+", " ".join(p.split())):
                plain = " ".join(re.findall(r"[^\W_]+", sentence.lower()))
                if plain:
                    out.append(plain)
        return out

    own = {k: set(said(t, 0)) for k, t in messages.items()}
    found = {}
    for (c, t), text in messages.items():
        votes = defaultdict(int)
        for sentence in said(text, 1):
            earlier = [u for u in range(t) if sentence in own.get((c, u), ())]
            if earlier:
                votes[max(earlier)] += len(sentence)
        size, parent = max(((n, u) for u, n in votes.items()), default=(0, None))
        found[c, t] = [parent, size]
    children = defaultdict(list)
    for c, t in sorted(found):
        children[c, found[c, t][0]].append(t)

    def walk(c, t, thread, depth, at):
        found[c, t] += [thread, at, depth]
        for u in children[c, t]:
            at = walk(c, u, thread, depth + 1, at + 1)
        return at

    for c, t in list(found):
        if found[c, t][0] is None:
            walk(c, t, t, 0, 0)
    return {k: tuple(v) for k, v in found.items()}


def test_quoting_messages_link_as_plain_loops_link_them(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(c, t, "user", ". ".join(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 4))) + rng.choice([".", "", "?\nNew line here."])) for c in range(12) for t in range(rng.choice([1, 3, 17]))]
    composed = quotes.quoting(spark.createDataFrame([*rows, (77, 0, None, None), (None, 1, "x", "y")], "conv_id long, turn long, role string, text string")).collect()
    texts = {(r.conv_id, r.turn): r.text for r in composed}
    assert len(texts) == len(rows) + 1
    assert texts[0, 0] == next(r[3] for r in rows if r[:2] == (0, 0))
    found = quotes.linked(spark.createDataFrame(composed, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent, r.linked, r.thread, r.reply, r.depth) for r in found} == plain_links(texts)
    assert sum(r.parent is not None for r in found) > 50 and max(r.depth for r in found) > 2


def test_many_rows_of_one_turn_and_many_replies_to_one_message(spark):
    rows = [(1, 0, "user", "The one question.")] + [(1, 1 + i % 300, "user", f"> The one question.\nAnswer number {i}.") for i in range(600)]
    found = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    order = sorted((r.reply, r.turn, r.number, r.parent, r.depth) for r in found)
    assert order == [(0, 0, 1, None, 0)] + [(i + 1, 1 + i // 2, 1 + i % 2, 0, 1) for i in range(600)]
    assert len({r.own for r in found}) == 601


def test_counts_are_those_of_the_libraries(spark, make_docs, corpus):
    paths = {"a": public_tokenizers.path("byte_bpe_50k.json"), "key": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    found = rollup.counted(make_docs(corpus), paths, public_tokenizers.PATTERN)
    library = Tokenizer.from_file(paths["a"])
    ranks = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(paths["key"]), special_tokens={})
    assert {r.doc_id: (r.a, r.key) for r in found.collect()} == {i: (len(library.encode(t or "", add_special_tokens=False).ids), len(ranks.encode_ordinary(t or ""))) for i, t in enumerate(corpus)}
    assert rollup.counted(make_docs([]), paths, public_tokenizers.PATTERN).collect() == []


def test_every_row_of_conversations_is_a_message(spark, tmp_path):
    rows = [(1, 0, "user", "The question."), (1, 1, "a", "First answer."), (1, 1, "b", "Other answer."), (1, 1, "b", "Other answer."), (1, 2, "user", "Thanks."), (1, 2, "user", None), (None, 0, "x", "Lost."), (None, 1, "x", "Lost."), (1, None, "x", "Late."), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op8_quotes(spark, str(tmp_path)).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in found) == Counter((c, t, role, text or "") for c, t, role, text in rows)
    assert sorted((r.turn, r.text, r.parent, r.depth) for r in found if r.conv_id == 1 and r.turn is not None) == [(0, "The question.", None, 0), (1, "First answer.", 0, 1), (1, "Other answer.", 0, 1), (1, "Other answer.", 0, 1), (2, "", 1, 2), (2, "Thanks.", 1, 2)]
    assert all(r.parent is None for r in found if r.conv_id is None or r.turn is None)
