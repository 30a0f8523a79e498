"""Quotation linking: replies find the message they quote, and conversations are put in reply order without the quotes.

A line's level is its number of leading `>`. Runs of lines of one level are passages. Of every passage the whole, its paragraphs
and its lines are hashed after normalisation; a quoted hash is joined to the last earlier message of the conversation that
holds it as its own text. The message that accounts for most of the first-level quotes is the parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import written

#: Turns that one group of the search for the last earlier message spans.
SPAN = 1_024
#: Messages in one piece of a formatted conversation.
PIECE = 256
_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_WROTE = re.compile(r"\bwrote:\s*$", re.IGNORECASE)


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of each run of lines of one level; a line that only introduces the quote after it (`... wrote:`) is dropped."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level, rest = (marks[0].count(">"), line[marks.end():]) if marks else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
            continue
        if level and out and out[-1][0] == 0:
            own = out[-1][1]
            while own and not own[-1].strip():
                own.pop()
            if own and _WROTE.search(own[-1]):
                own.pop()
        out.append((level, [rest]))
    return [(level, lines) for level, lines in out if any(x.strip() for x in lines)]


def without_quotes(text: str) -> str:
    """The message's own passages, joined by newlines, trimmed."""
    return "\n".join("\n".join(lines).strip() for level, lines in passages(text) if level == 0).strip()


def _normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def keys(lines: list[str]) -> dict[int, int]:
    """Hash -> weight of a passage's whole, paragraphs and lines: characters, times four, two and one."""
    units, paragraph = [(4, _normal(lines))], []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
            units.append((1, _normal([line])))
        elif paragraph:
            units.append((2, _normal(paragraph)))
            paragraph = []
    found: dict[int, int] = {}
    for weight, unit in units:
        h = xxhash.xxh3_64_intdigest(unit.encode()) - (1 << 63)
        found[h] = max(found.get(h, 0), weight * len(unit))
    return found


def parsed(messages: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` (without quotes), `own` (hashes), `quoted` (level, hash, weight), one row a row."""
    quote = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64()), ("weight", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own, quoted = [], [], []
            for text in batch.column(3).to_pylist():
                mine, theirs = set(), []
                for level, lines in passages(text or ""):
                    if level:
                        theirs += [{"level": level, "key": k, "weight": w} for k, w in keys(lines).items()]
                    else:
                        mine.update(keys(lines))
                texts.append(without_quotes(text or ""))
                own.append(sorted(mine))
                quoted.append(theirs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), batch.column(2), pa.array(texts), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, quote)],
                ["conv_id", "turn", "role", "text", "own", "quoted"],
            )

    schema = "conv_id bigint, turn bigint, role string, text string, own array<bigint>, quoted array<struct<level:int,key:bigint,weight:bigint>>"
    return messages.select("conv_id", "turn", F.col("role").cast("string"), "text").mapInArrow(run, schema)


def links(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, level, source, weight` from `parsed` rows: messages quoted, by level.

    The source is the last earlier turn that holds the hash as its own text. It is looked for in spans of SPAN turns, with the last
    one before each span carried over, so a passage that fills a long conversation is no single group.
    """
    known = rows.where("conv_id is not null and turn is not null")
    quoted = known.select("conv_id", "turn", F.explode("quoted").alias("x")).select("conv_id", "turn", "x.*").groupBy("conv_id", "turn", "level", "key").agg(F.max("weight").alias("weight"))
    wanted = quoted.select("conv_id", "key").distinct()
    own = known.select("conv_id", F.col("turn").alias("at"), F.explode("own").alias("key")).join(wanted, ["conv_id", "key"], "left_semi").distinct()
    span = lambda t: F.floor(F.col(t) / SPAN)
    own, quoted = own.withColumn("span", span("at")), quoted.withColumn("span", span("turn"))
    ends = own.groupBy("conv_id", "key", "span").agg(F.max("at").alias("last"))
    spans = ends.unionByName(quoted.select("conv_id", "key", "span", F.lit(None).cast("bigint").alias("last"))).groupBy("conv_id", "key", "span").agg(F.max("last").alias("last"))
    before = Window.partitionBy("conv_id", "key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("conv_id", "key", "span", F.max("last").over(before).alias("carried"))
    both = quoted.select("conv_id", "key", "span", "turn", "level", "weight", F.lit(None).cast("bigint").alias("at")).unionByName(
        own.select("conv_id", "key", "span", F.col("at").alias("turn"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("weight"), "at")
    )
    earlier = Window.partitionBy("conv_id", "key", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("at").over(earlier)).where("level is not null")
    found = near.join(carried, ["conv_id", "key", "span"]).withColumn("source", F.coalesce("near", "carried")).where("source is not null")
    return found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("weight").alias("weight"))


def parents(found: DataFrame) -> DataFrame:
    """`conv_id, turn, parent` from links: most weight among first-level quotes, ties to the later message."""
    return found.where("level = 1").groupBy("conv_id", "turn").agg(F.max_by("source", F.struct("weight", "source")).alias("parent"))


def rooted(tree: DataFrame) -> DataFrame:
    """`conv_id, turn, thread, depth` for every message with a parent, by doubling the steps upwards; parents are earlier turns."""
    state = written(tree.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).cast("bigint").alias("depth")), "steps")
    while not state.isEmpty():
        above = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = state.join(above, ["conv_id", "thread"], "left")
        state = written(step.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "steps")
        if state.where("moved").isEmpty():
            break
    return state.select("conv_id", "turn", "thread", "depth")


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with `position` from 0 within `group` by `order`: sorted by ranges, so a group may span many tasks."""
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = written(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    parts = kept.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(group).alias("g"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return kept.join(offsets, kept[group].eqNullSafe(offsets["g"]) & (kept["part"] == offsets["p"])).withColumn("position", F.col("at") + F.col("shift")).drop("part", "at", "g", "p", "shift")


def linked(messages: DataFrame) -> DataFrame:
    """`conv_id, position, turn, role, text, parent, thread, depth, n_quoted` for every row of `messages(conv_id, turn, role, text)`.

    `text` is the message without quotes, `parent` the turn it quotes most (null without one), `thread` the first message of its
    chain of parents (itself without one), `depth` the steps to it. Positions go by thread, depth, turn, so a message stands after the one
    it answers. Null text counts as empty. A null conversation or turn has no links; null conversations are one group of positions. Rows
    that repeat a conversation and turn share their links and stand beside each other. Other columns are not looked at; an empty table gives an
    empty one.
    """
    rows = written(parsed(messages), "messages")
    tree = written(parents(links(rows)), "parents")
    out = rows.select("conv_id", "turn", "role", "text", F.size("quoted").alias("n_quoted")).join(tree, ["conv_id", "turn"], "left").join(rooted(tree), ["conv_id", "turn"], "left")
    out = out.withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    return positions(out, "conv_id", ["thread", "depth", "turn", "role", "text"]).select("conv_id", "position", "turn", "role", "text", "parent", "thread", "depth", "n_quoted")


def formatted(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """`conv_id, piece, messages`: reply-ordered conversations, in pieces of at most `piece` messages (role, text, turn, parent)."""
    message = F.struct("position", "role", "text", "turn", "parent")
    return rows.groupBy("conv_id", F.floor(F.col("position") / piece).alias("piece")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
