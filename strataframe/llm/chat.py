"""Quotation linking: conversations in reply order, without the quotes.

A message's lines are parsed into quote levels (`>`, `> >`, ...); neighbouring lines of one level are a passage, and
a line that only announces a quote ("... wrote:") goes with it. Passages are normalised (case, white space, edge
punctuation) and hashed, and with them their paragraphs and lines; so are the bodies, paragraphs and lines that messages
hold unquoted, and their runs of as many lines as some passage or paragraph of a quote has. A quote
of level k points at the earliest message that holds its passage itself: in the same conversation if there is one, else
anywhere; if none holds all of it, its longest paragraph or line that the conversation holds counts, else the
longest held anywhere. Part of a line is found only where it is all that the line has. The parent of a message is the latest earlier message that its outermost quotes point at; without one,
the turn before it in its conversation. So a parent always comes before its child in the order of
(conversation, turn), links make trees, and each tree is a conversation: root and depth follow from
pointer jumping, whose rounds grow with the logarithm of the longest chain.

Passages held by many messages are reduced to their earliest holder before they meet quotes; a quote that a third of all rows
hold joins that one row. Masses of replies to one message are rows of the side that Spark may split.

Defined results: null text is empty; messages whose conversation or turn is null are roots that nothing
points at; of rows with equal conversation and turn the first stands for all as a parent; a turn missing
before a message makes it a root, unless it quotes; passages under SHORTEST characters after normalising
link within their conversation only, those of no characters nowhere; repeated rows stay; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import materialize, slices

SHORTEST = 12
QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
ANNOUNCES = re.compile(r"(?:on\b.{0,200}\bwrote|.{1,200}\bwrote|.{1,200}\bsaid):\s*", re.IGNORECASE)
SPACE = re.compile(r"\s+")
EDGE = " \t\r\n.,;:!?\"'()[]{}*_-"


def normal(passage: str) -> str:
    return SPACE.sub(" ", passage).strip(EDGE).lower()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages as (level, passage) in order."""
    own, quotes, level = [], [], 0
    for line in (text or "").split("\n"):
        m = QUOTE.match(line)
        k = m[1].count(">") if m else 0
        body = line[m.end() :] if m else line
        if not k:
            own.append(line)
        else:
            if level == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and ANNOUNCES.fullmatch(own[-1].strip()):
                    own.pop()
            if not body.strip():
                k = level or k  # an empty quoted line parts no passage from itself
            if k == level and quotes:
                quotes[-1][1].append(body)
            else:
                quotes.append((k, [body]))
        level = k
    return "\n".join(own).strip("\n"), [(k, "\n".join(x).strip("\n")) for k, x in quotes if any(map(str.strip, x))]


def lines(passage: str) -> list[str]:
    return [x for x in passage.split("\n") if x.strip()]


def holds(own: str, sizes: Iterable[int] = (), least: int = SHORTEST) -> set[str]:
    """What a quote of this text may repeat, normalised: all of it, its paragraphs, its lines, runs of so many lines."""
    each = lines(own)
    some = ("\n".join(each[i : i + n]) for n in sizes for i in range(len(each) - n + 1))
    found = {normal(x) for x in (own, *re.split(r"\n\s*\n", own), *own.split("\n"), *some)}
    return {x for x in found if len(x) >= least}


def units(passage: str) -> dict[str, tuple[bool, int]]:
    """What is looked up of a quote, normalised: all of it, its paragraphs, its lines; whether it is all, and of how many lines."""
    parts = [passage, *re.split(r"\n\s*\n", passage), *passage.split("\n")]
    whole = normal(passage)
    return {u: (u == whole, len(lines(x))) for x in reversed(parts) if (u := normal(x))}


def key(passage: str) -> bytes:
    return xxhash.xxh3_128_digest(passage.encode())


def parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Written: row, conv, turn, own text and quotes (level and units: hash, whether it is all, characters, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, quotes = [], []
            for t in batch.column(2).to_pylist():
                body, passages = parse(t)
                own.append(body)
                quotes.append([{"level": k, "units": [{"hash": key(u), "whole": w, "size": len(u), "lines": n} for u, (w, n) in units(p).items()]} for k, p in passages if normal(p)])
            unit = pa.struct([("hash", pa.binary()), ("whole", pa.bool_()), ("size", pa.int32()), ("lines", pa.int32())])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("units", pa.list_(unit))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(own, pa.string()), pa.array(quotes, kind)], ["conv", "turn", "role", "own", "quotes"])

    rows = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"), F.col("role").cast("string").alias("role") if "role" in messages.columns else F.lit(None).cast("string").alias("role"))
    made = rows.mapInArrow(run, "conv long, turn long, role string, own string, quotes array<struct<level:int,units:array<struct<hash:binary,whole:boolean,size:int,lines:int>>>>")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "chat-parsed")


def held_by(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """conv, turn, row and the hash of each thing that a message holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[key(x) for x in holds(t or "", sizes, 1)] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.binary()))], ["conv", "turn", "row", "held"])

    own = rows.where("conv is not null and turn is not null").select("conv", "turn", "row", "own")
    return own.mapInArrow(run, "conv long, turn long, row long, held array<binary>").select("conv", "turn", "row", F.explode("held").alias("hash"))


def parents(rows: DataFrame) -> DataFrame:
    """row and up (conv, turn, row of the parent) of each message that has one."""
    quotes = rows.where("conv is not null and turn is not null").select("row", "conv", "turn", F.posexplode("quotes").alias("place", "q"))
    quotes = materialize(quotes.select("row", "conv", "turn", "place", "q.level", F.explode("q.units").alias("u")).select("row", "conv", "turn", "place", "level", "u.*"), "chat-quotes")
    sizes = sorted(r.lines for r in quotes.where("lines > 1").select("lines").distinct().collect())
    me = F.struct("conv", "turn", "row")
    held = held_by(rows, sizes).join(quotes.select("hash").distinct(), "hash", "left_semi")
    inside = held.groupBy("hash", "conv").agg(F.min(me).alias("inside"))
    inside = materialize(inside, "chat-held")
    anywhere = inside.groupBy("hash").agg(F.min("inside").alias("anywhere"))
    met = quotes.join(inside, ["hash", "conv"], "left").join(anywhere, "hash", "left")
    before = lambda c: F.when(F.struct(F.col(f"{c}.conv"), F.col(f"{c}.turn")) < F.struct("conv", "turn"), F.col(c))
    near, far = before("inside"), F.when(F.col("size") >= SHORTEST, before("anywhere"))
    rank = F.when(F.col("whole"), 2).when(near.isNotNull(), 1).otherwise(0)
    met = met.select("row", "place", "level", F.struct(rank.alias("rank"), "size", F.coalesce(near, far).alias("up")).alias("best")).where("best.up is not null")
    met = met.groupBy("row", "place", "level").agg(F.max("best").alias("best")).select("row", "level", "best.up")
    quoted = met.groupBy("row").agg(F.max(F.struct((-F.col("level")).alias("near"), "up")).alias("best")).select("row", F.col("best.up").alias("quoted"))
    firsts = rows.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min("row").alias("row"))
    last = firsts.select("conv", (F.col("turn") + 1).alias("turn"), F.struct("conv", "turn", "row").alias("last"))
    known = rows.select("row", "conv", "turn").join(last, ["conv", "turn"], "left").join(quoted, "row", "left")
    return known.select("row", "conv", "turn", F.coalesce("quoted", "last").alias("up"), F.col("quoted").isNotNull().alias("by_quote"))


def threads(links: DataFrame) -> DataFrame:
    """links: row, up, ... with up.row or null. Adds root (conv, turn, row) and depth by pointer jumping; a message whose
    root is found leaves the rounds."""
    first = links.withColumn("root", F.coalesce("up", F.struct("conv", "turn", "row"))).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    first = materialize(first, "chat-threads")
    done, left = first.where("depth = 0"), first.where("depth > 0")
    while not left.isEmpty():
        above = done.unionByName(left).where("depth > 0").select(F.col("row").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more"))
        out = left.join(above, F.col("root.row") == F.col("at"), "left")
        out = materialize(out.select(*(c for c in first.columns if c not in ("root", "depth")), F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "chat-threads")
        done, left = done.unionByName(out.where("not moved").drop("moved")), out.where("moved").drop("moved")
    return done


def ordered(rows: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """Adds position, a row's place from 0 in its group by `order`, which begins with `group`. Rows are sorted over range
    partitions, and a place is the rank over all less the group's least, so no task holds a group; a count per task reaches the
    driver."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    cut = materialize(cut, "chat-ordered").withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dict(map(tuple, cut.groupBy("_part").count().collect()))
    before, total = [], 0
    for part, n in sorted(sizes.items()):
        before.append((part, total))
        total += n
    ranks = cut.join(F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long")), "_part").withColumn("_rank", F.col("_before") + F.col("_in"))
    first = ranks.groupBy(*group).agg(F.min("_rank").alias("_first")).select(*(F.col(c).alias(f"_{c}") for c in group), "_first")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group))
    return ranks.join(first, same).withColumn("position", F.col("_rank") - F.col("_first")).select(*rows.columns, "position")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, n_quotes, parent_conv, parent_turn, by_quote, root_conv,
    root_turn, root_row (which tells apart roots of equal conversation and turn), depth and position. The rows of one root are a built
    conversation, its turns in the order of position: every message comes after the one it answers."""
    rows = parsed(messages, conv, turn, text)
    tree = threads(parents(rows)).select("row", "up", "by_quote", "root", "depth")
    out = rows.select("row", "conv", "turn", "role", "own", F.size("quotes").cast("long").alias("n_quotes")).join(tree, "row")
    out = out.select("row", F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("text"), "n_quotes", F.col("up.conv").alias("parent_conv"), F.col("up.turn").alias("parent_turn"), "by_quote", F.col("root.conv").alias("root_conv"), F.col("root.turn").alias("root_turn"), F.col("root.row").alias("root_row"), "depth")
    root = ["root_conv", "root_turn", "root_row"]
    return ordered(out, [*root, "depth", "conv_id", "turn", "row"], root).drop("row")


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
