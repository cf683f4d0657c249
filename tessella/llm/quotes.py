"""Conversations linked by what their messages quote.

A line that begins with ``>`` marks is quoted, at the level that the marks
count; a line that only introduces a quotation is dropped. Sentences of quoted
and of own text are normalised and hashed, so a quotation that was wrapped anew
is still found. A quoted sentence belongs to the latest earlier message of its
conversation with that sentence among its own; the message that most quoted
characters of the outermost level belong to is the parent, the later one on a
tie. Messages without such a parent begin a thread. The replies of a thread are
in depth-first order, those to one message by turn: the walk that enters and
leaves every message is a list, whose places are found by doubling steps, so a
row stays as small as it was however long a chain of replies gets.

A sentence is looked up by a join on (conversation, hash) after the turns that
have it are reduced to distinct rows, and the latest earlier one is found by a
sort of those, so that neither a long conversation nor a sentence that
everybody writes meets in all pairs. Rows of one turn and replies to one message
are numbered over a sort by ranges, which splits a group however large it is.

Defined cases: null and empty texts have no sentences and quote nothing; a
message whose text is all quotation has empty text; rows of one conversation and
turn are told apart by number in their text's order, and a link goes to the
first; null conversations or turns are kept, without links.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.store import written

_MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
_INTRODUCES = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}\bécrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió|.{0,120}<[^<>\s]+@[^<>\s]+>\s*wrote|-{2,}\s*original message\s*-{2,})\s*:?\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_OTHER = re.compile(r"[\W_]+")


def levels(text: str | None) -> list[tuple[int, str]]:
    """The lines of a text with their quote level, introductions of quotations left out."""
    lines = []
    for line in (text or "").splitlines():
        m = _MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end():]) if m else (0, line))
    # A line introduces a quotation if a deeper line follows it, blank lines or not.
    following: list[int] = []
    deeper = 0
    for level, line in reversed(lines):
        following.append(deeper)
        deeper = level if line.strip() else max(deeper, level)
    following.reverse()
    return [(level, line) for (level, line), after in zip(lines, following, strict=True) if not (after > level and _INTRODUCES.match(line))]


def passages(text: str | None) -> list[tuple[int, str]]:
    """Runs of lines of one level, joined by newlines."""
    out: list[tuple[int, list[str]]] = []
    for level, line in levels(text):
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(lines)) for level, lines in out]


def sentences(passage: str) -> list[str]:
    """The normalised sentences of a passage: lower case, letters and digits with one space between."""
    found = (_OTHER.sub(" ", s.lower()).strip() for s in _SENTENCE.split(" ".join(passage.split())))
    return [s for s in found if s]


def own_text(text: str | None) -> str:
    """A text without quotations, blank lines at its ends and more than one blank line in a row."""
    kept: list[str] = []
    for level, passage in passages(text):
        if not level:
            kept += [line.rstrip() for line in passage.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def _hash(sentence: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(sentence.encode()), "big", signed=True)


_SENTENCES = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))


def parsed(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, number, role, own, quoted_passages, sentences) of every message; number tells rows of one turn apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, quoted, found = [], [], []
            for t in batch.column(4):
                value = t.as_py()
                parts = passages(value)
                own.append(own_text(value))
                quoted.append(sum(1 for level, p in parts if level and p.strip()))
                found.append([{"level": level, "hash": _hash(s), "size": len(s)} for level, p in parts for s in sentences(p)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.string()), pa.array(quoted, pa.int32()), pa.array(found, _SENTENCES)], names=["conversation", "turn", "number", "role", "own", "quoted_passages", "sentences"])

    rows = messages.select(F.col(conversation).cast("long").alias("conversation"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = numbered(rows, ["conversation", "turn"], ["text", "role"])
    return rows.select("conversation", "turn", "number", "role", "text").mapInArrow(parse, "conversation long, turn long, number long, role string, own string, quoted_passages int, sentences array<struct<level:int,hash:long,size:int>>")


def parents(rows: DataFrame) -> DataFrame:
    """(conversation, turn, number, parent, linked): the turn that each quoting message answers, and the characters found there."""
    each = rows.where("conversation is not null and turn is not null").select("conversation", "turn", "number", F.explode("sentences").alias("s"))
    own = each.where("s.level = 0").select("conversation", F.col("s.hash").alias("hash"), "turn").distinct()
    outer = each.where("s.level = 1").groupBy("conversation", "turn", "number", F.col("s.hash").alias("hash")).agg(F.sum(F.col("s.size").cast("long")).alias("size"))
    marks = own.select("conversation", "hash", "turn", F.col("turn").alias("origin"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("size"))
    asks = outer.select("conversation", "hash", "turn", F.lit(None).cast("long").alias("origin"), "number", "size")
    # Quotations come before own sentences of the same turn, so that only earlier turns are seen.
    asked = asks.select("conversation", "hash").distinct()
    marks = marks.join(asked, ["conversation", "hash"], "left_semi")
    latest = Window.partitionBy("conversation", "hash").orderBy("turn", F.col("origin").isNotNull(), "number")
    found = marks.unionByName(asks).withColumn("from", F.last("origin", ignorenulls=True).over(latest.rowsBetween(Window.unboundedPreceding, -1)))
    votes = found.where("number is not null and from is not null").groupBy("conversation", "turn", "number", "from").agg(F.sum("size").alias("size"))
    best = votes.groupBy("conversation", "turn", "number").agg(F.max(F.struct("size", "from")).alias("best"))
    return best.select("conversation", "turn", "number", F.col("best.from").alias("parent"), F.col("best.size").alias("linked"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``number``, from 1 within each group in the given order. Rows are sorted by ranges, so a large group is dealt to many tasks; ties of a whole key stay together."""
    schema = rows.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = uuid.uuid4().int >> 65, None, 0
        for batch in batches:
            numbers = []
            for own in zip(*(batch.column(g).to_pylist() for g in group), strict=True):
                n = n + 1 if own == last else 1
                last = own
                numbers.append(n)
            yield batch.append_column("_part", pa.array([part] * len(numbers), pa.int64())).append_column("number", pa.array(numbers, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = written(dealt.mapInArrow(count, f"{kinds}, _part long, number long"), "quotes")
    # A group in several parts: each part starts after the rows of those before it, in the order of their first rows.
    ends = placed.groupBy(*group, "_part").agg(F.max("number").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    before = Window.partitionBy(*group).orderBy("_first", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0")
    starts = starts.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_part").alias("_of"), "_before")
    on = [placed[g].eqNullSafe(starts[f"_{g}"]) for g in group] + [placed["_part"] == starts["_of"]]
    whole = placed.join(starts, on, "left").withColumn("number", F.col("number") + F.coalesce("_before", F.lit(0)))
    return whole.select(*schema.names, "number")


def threads(links: DataFrame) -> DataFrame:
    """(conversation, turn, number, thread, thread_number, reply, depth) of the messages in threads of two or more. links: rows (conversation, turn, number, parent).

    A walk enters and leaves each message. After "enter" comes the entry of the
    first reply or else the own leaving, and after "leave" the entry of the next
    reply to the same message or else the leaving of that message.
    """
    kids = links.select("conversation", F.col("parent").alias("up"), F.lit(1).cast("long").alias("up_number"), "turn", F.col("number").alias("n"))
    kids = written(numbered(kids, ["conversation", "up"], ["turn", "n"]).withColumnRenamed("number", "place"), "quotes")
    tops = kids.select("conversation", F.col("up").alias("turn"), F.lit(1).cast("long").alias("n")).distinct()
    known = kids.select(F.col("conversation").alias("c"), F.col("turn").alias("t"), F.col("n").alias("m"), "up", "place")
    nodes = tops.union(kids.select("conversation", "turn", "n")).distinct()
    nodes = written(nodes.join(known, (F.col("conversation") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("n") == F.col("m")), "left").select("conversation", "turn", "n", "up", "place"), "quotes")

    def replies(shift: int) -> DataFrame:
        return kids.select(F.col("conversation").alias("c"), F.col("up").alias("u"), (F.col("place") - shift).alias("k"), F.struct("turn", "n", F.lit(0).alias("side")).alias("then"))

    def step(turn: str, n: str, side: int) -> Column:
        return F.struct(F.col(turn).alias("turn"), F.col(n).cast("long").alias("n"), F.lit(side).alias("side"))

    first = replies(0).where("k = 1")
    enters = nodes.join(first, (F.col("conversation") == F.col("c")) & (F.col("turn") == F.col("u")) & (F.col("n") == 1), "left")
    enters = enters.select("conversation", step("turn", "n", 0).alias("at"), F.coalesce("then", step("turn", "n", 1)).alias("then"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("open"))
    later = replies(1)
    leaves = nodes.join(later, (F.col("conversation") == F.col("c")) & (F.col("up") == F.col("u")) & (F.col("place") == F.col("k")), "left")
    above = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("turn"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("side")))
    leaves = leaves.select("conversation", step("turn", "n", 1).alias("at"), F.coalesce("then", above).alias("then"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("open"))
    # entered and open: sums over the walk from here up to the step before ``then``; end: the last step known.
    walk = written(enters.union(leaves).withColumn("end", F.col("at")), "quotes")
    while not walk.where("then is not null").isEmpty():
        ahead = walk.select(F.col("conversation").alias("c"), F.col("at").alias("a"), F.col("then").alias("then2"), F.col("entered").alias("e2"), F.col("open").alias("o2"), F.col("end").alias("end2"))
        joined = walk.join(ahead, (F.col("conversation") == F.col("c")) & (F.col("then") == F.col("a")), "left")
        walk = written(joined.select("conversation", "at", F.col("then2").alias("then"), (F.col("entered") + F.coalesce("e2", F.lit(0))).alias("entered"), (F.col("open") + F.coalesce("o2", F.lit(0))).alias("open"), F.coalesce("end2", "end").alias("end")), "quotes")
    found = walk.where("at.side = 0").select("conversation", "at.turn", F.col("at.n").alias("number"), "entered", (-F.col("open")).cast("int").alias("depth"), F.col("end.turn").alias("thread"), F.col("end.n").alias("thread_number"))
    whole = found.where("turn = thread and number = thread_number").select(F.col("conversation").alias("c"), F.col("thread").alias("t"), F.col("thread_number").alias("m"), F.col("entered").alias("size"))
    return found.join(whole, (F.col("conversation") == F.col("c")) & (F.col("thread") == F.col("t")) & (F.col("thread_number") == F.col("m"))).select("conversation", "turn", "number", "thread", "thread_number", (F.col("size") - F.col("entered")).alias("reply"), "depth")


def linked(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, number, role, own, quoted_passages, parent, linked, thread, thread_number, reply, depth): messages without quotations.

    A conversation in the order of its replies is its rows by (thread,
    thread_number, reply): a thread is named by its first message, whose reply
    is 0. There is a row a message, as one conversation may hold a large part of
    all; ``ordered`` sorts them over many tasks.
    """
    rows = written(parsed(messages, conversation=conversation, turn=turn, role=role, text=text), "quotes")
    found = written(parents(rows), "quotes")
    places = threads(found)

    def by(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        keys = ["conversation", "turn", "number"]
        renamed = b.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = [a[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
        return a.join(renamed, on, how).drop(*(f"_{k}" for k in keys))

    whole = by(by(rows.drop("sentences"), found, "left"), places, "left")
    whole = whole.withColumns({"thread": F.coalesce("thread", "turn"), "thread_number": F.coalesce("thread_number", "number"), "reply": F.coalesce("reply", F.lit(0)).cast("long"), "depth": F.coalesce("depth", F.lit(0))})
    return whole.select(F.col("conversation").alias(conversation), F.col("turn").alias(turn), "number", "role", "own", "quoted_passages", "parent", F.coalesce("linked", F.lit(0)).alias("linked"), "thread", "thread_number", "reply", "depth")


def ordered(linked: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """The messages of ``linked`` by conversation and reply, sorted by ranges."""
    return linked.orderBy(conversation, "thread", "thread_number", "reply")


def quoting(messages: DataFrame, *, every: bool = False) -> DataFrame:
    """Messages (conv_id, turn, role, text) as a mail thread would hold them: turn t > 0 quotes the message of turn t / 2, if it has text, which quotes the one before it in turn.

    The first message of a turn, by text, is the one that is quoted. There is a
    message for each turn, or with ``every`` for each row: further rows of a turn
    quote as the first does, and rows without a conversation or turn quote nothing.
    """
    first = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("role"))).alias("m")).select("conv_id", "turn", "m.text", "m.role")
    first = written(first, "quotes")

    def quoted(rows: DataFrame, of: DataFrame) -> DataFrame:
        above = of.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("above"))
        lines = F.regexp_replace("above", "(?m)^", "> ")
        text = F.when((F.col("turn") > 0) & (F.length("above") > 0), F.concat(F.lit("On that day, someone wrote:\n"), lines, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
        return rows.join(above, (F.col("conv_id") == F.col("c")) & (F.expr("turn div 2") == F.col("t")), "left").select("conv_id", "turn", "role", text.alias("text"))

    rows = messages.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role") if every else first
    return quoted(rows, written(quoted(first, first), "quotes"))
