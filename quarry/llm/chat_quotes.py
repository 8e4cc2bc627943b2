"""Chat formatting by quotation linking: conversations in reply order, without quotes.

A message's lines carry quote levels, the number of ``>`` marks they begin with. Lines of one level
in a row make a passage; level 0 is the message's own text. A passage is normalised (marks and
extra blanks gone, lower case) and hashed, and so is what each message can be quoted by: any of its
own lines in a row. The whole, paragraphs and single lines are hashed at once; other runs of lines
where they have as many words as a quote of the conversation, so few lengths are tried.
A passage links to the earliest message of its conversation that holds it and comes before; the
deepest-nested quotes are older, so the parent of a message is the origin of its first linked
passage of the lowest level. A message that quotes nothing known starts a thread. A conversation in
reply order is sorted by (root_turn, turn): thread by thread, every reply after what it answers.

Origins of a passage are reduced to one row before the join, so passages that many messages hold
don't multiply, and threads' roots are found by pointer doubling over one row a turn, so neither a
task nor a row holds a conversation or a chain of replies.

Defined cases: a null text has no own text and no quotes; texts of any length are parsed whole; ids
of conversations may have any type; a turn that is no whole number, or null, or whose conversation is
null, starts a thread of its own; messages that repeat a conversation's turn are each linked and
answer as the one whose text's hash is least; of equal passages the earliest message is the origin;
a quote of a later message is no link; extra columns are passed through but for those named like
results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.shared import cut

_MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)")
#: A line of any length that introduces a quote, ``... wrote:`` in the languages served; a parameter, as it is a choice.
INTRO = r"\b(wrote|writes|schrieb|écrit|escribió)\s?:\s*$"


def parse(text: str | None, intro: str = INTRO) -> list[tuple[int, str]]:
    """(level, passage) of a message in order; own text has level 0. A line that introduces a quote is part of it and left out."""
    introduces = re.compile(intro, re.IGNORECASE)
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        found = _MARKS.match(line)
        level = found.group(1).count(">") if found else 0
        body = line[found.end() :] if found else line
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            if level and out and out[-1][0] < level and out[-1][1] and introduces.search(out[-1][1][-1].strip()):
                out[-1][1].pop()
            out.append((level, [body]))
    return [(level, "\n".join(lines)) for level, lines in out]


def normalised(passage: str) -> str:
    return " ".join(passage.split()).lower()


def own_text(passages: list[tuple[int, str]]) -> str:
    return "\n".join(x for x in (p.strip("\n") for level, p in passages if level == 0) if x.strip())


def digest(passage: str) -> dict[str, int]:
    """128 bits of a normalised passage."""
    data = hashlib.blake2b(passage.encode(), digest_size=16).digest()
    return {"h1": int.from_bytes(data[:8], "little", signed=True), "h2": int.from_bytes(data[8:], "little", signed=True)}


_DIGEST = [("h1", pa.int64()), ("h2", pa.int64())]
_QUOTE = [("level", pa.int32()), ("place", pa.int32()), ("words", pa.int32()), *_DIGEST]
_FIELDS = "own_text string, __quotes array<struct<level:int,place:int,words:int,h1:bigint,h2:bigint>>, __held array<struct<h1:bigint,h2:bigint>>"


def _parsed(messages: DataFrame, text: str, intro: str) -> DataFrame:
    """``messages`` with own_text, the digests of its quotes by level and place, and of what it can be quoted by."""
    place = messages.columns.index(text)
    names = [*messages.columns, "own_text", "__quotes", "__held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, quotes, held = [], [], []
            for value in batch.column(place).to_pylist():
                passages = parse(value, intro)
                mine = own_text(passages)
                own.append(None if value is None else mine)
                plain = [(n, i, normalised(p)) for i, (n, p) in enumerate(passages) if n]
                quotes.append([{"level": n, "place": i, "words": len(p.split(" ")), **digest(p)} for n, i, p in plain if p])
                parts = {normalised(x) for x in (mine, *re.split(r"\n\s*\n", mine), *mine.split("\n"))}
                held.append([digest(x) for x in sorted(parts) if x])
            made = [pa.array(own, pa.string()), pa.array(quotes, pa.list_(pa.struct(_QUOTE))), pa.array(held, pa.list_(pa.struct(_DIGEST)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    more = StructType.fromDDL(_FIELDS)
    return messages.mapInArrow(run, StructType([*messages.schema.fields, *more.fields]))


def runs(own: str, words: set[int]) -> set[str]:
    """Normalised lines in a row of a message's own text, of as many words as ``words`` has."""
    lines = [x for x in map(normalised, own.split("\n")) if x]
    total = list(accumulate((len(x.split(" ")) for x in lines), initial=0))
    place = {n: i for i, n in enumerate(total)}
    lengths = sorted(words)
    found = set()
    for i, n in enumerate(total[:-1]):
        for w in lengths[: bisect_right(lengths, total[-1] - n)]:
            if n + w in place:
                found.add(" ".join(lines[i : place[n + w]]))
    return found


def _runs(messages: DataFrame) -> DataFrame:
    """(c, n, h1, h2) of the runs of lines of ``messages`` (c, n, own_text, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (own, words) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                found = [digest(x) for x in sorted(runs(own, set(words)))]
                at = pa.array([row] * len(found), pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array([x[h] for x in found], pa.int64()) for h in ("h1", "h2"))]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "h1", "h2"])

    return messages.mapInArrow(run, f"c {messages.schema['c'].dataType.simpleString()}, n bigint, h1 bigint, h2 bigint")


def threads(nodes: DataFrame) -> DataFrame:
    """(c, n, root, depth) of nodes (c, n, up), whose pointers go to earlier nodes: pointers double until all are at a root."""
    begun = nodes.select("c", "n", F.coalesce("up", "n").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    state = cut(begun.withColumn("open", F.col("depth") > 0))
    while not state.filter("open").isEmpty():
        above = state.select("c", F.col("n").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        state = cut(
            state.join(above, ["c", "root"]).select(
                "c", "n", F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("depth2") > 0).alias("open")
            )
        )
    return state.drop("open")


#: What linking adds to a message.
MADE = ["n_quotes", "n_linked", "parent_turn", "root_turn", "depth"]


def link_quotes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", intro: str = INTRO) -> DataFrame:
    """Every message with own_text, n_quotes, n_linked, parent_turn, root_turn and depth in its thread."""
    base = conversations.drop(*[c for c in ("own_text", *MADE) if c not in (conv, turn, text)])
    parsed = cut(_parsed(base, text, intro).withColumn("__m", F.monotonically_increasing_id()))
    number = F.expr(f"try_cast(`{turn}` as bigint)")
    # Only digests and keys are brought together; texts move once, when the places are joined back.
    narrow = parsed.select(F.col("__m").alias("m"), F.col(conv).alias("c"), number.alias("n"), F.xxhash64("own_text").alias("own"), "__quotes", "__held")
    named = narrow.filter("c is not null and n is not null")
    quotes = named.select("m", "c", "n", F.explode("__quotes").alias("q")).select("m", "c", "n", "q.level", "q.place", "q.words", "q.h1", "q.h2")
    # A message of two lines is held whole and by its lines; of longer ones of conversations with quotes, the texts move too.
    lengths = quotes.groupBy("c").agg(F.collect_set("words").alias("words"))
    longer = parsed.select(F.col(conv).alias("c"), number.alias("n"), "own_text").filter("n is not null and size(split(own_text, '\\n')) > 2")
    held = named.select("c", "n", F.explode("__held").alias("p")).select("c", "n", "p.h1", "p.h2").unionByName(_runs(longer.join(lengths, "c")))
    origins = held.groupBy("c", "h1", "h2").agg(F.min("n").alias("origin"))
    linked = quotes.join(origins, ["c", "h1", "h2"]).filter("origin < n")
    parents = linked.groupBy("m").agg(F.min_by("origin", F.struct("level", "place")).alias("parent_turn"), F.count("*").alias("n_linked"))
    messages = narrow.select("m", "c", "n", "own", F.size("__quotes").cast("bigint").alias("n_quotes")).join(parents, "m", "left")
    nodes = messages.filter("c is not null and n is not null").groupBy("c", "n").agg(F.min_by("parent_turn", F.struct("own", "m")).alias("up"))
    up = threads(nodes).select(F.col("c").alias("pc"), F.col("n").alias("pn"), "root", F.col("depth").alias("above"))
    placed = messages.join(up, (F.col("c") == F.col("pc")) & (F.col("parent_turn") == F.col("pn")), "left")
    links = F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked")
    depth = F.coalesce(F.col("above") + 1, F.lit(0)).cast("int").alias("depth")
    result = placed.select(F.col("m").alias("__m"), "n_quotes", links, "parent_turn", F.coalesce("root", "n").alias("root_turn"), depth)
    return parsed.select("__m", *base.columns, "own_text").join(result, "__m").drop("__m")


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", intro: str = INTRO) -> DataFrame:
    """Messages without quotes, with their place in the conversation; sorted by (root_turn, turn), a conversation is in reply order."""
    linked = link_quotes(conversations, conv, turn, text, intro)
    own = [c for c in linked.columns if c not in (text, "own_text", *MADE)]
    return linked.select(*own, *MADE, F.col("own_text").alias(text))
