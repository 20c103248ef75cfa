"""Quotation linking of conversations (operator 4)."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, flat_map_rows, map_rows, read

#: Quoted passages shorter than this many words link nothing.
MIN_WORDS = 3
_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"^(?:On|Am|Le|El)\b.{0,200}(?:wrote|schrieb|a écrit|escribió)\s*:\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and (level, text) of its quoted passages; a passage is a run of lines of one level."""
    own, quotes, level_before = [], [], 0
    for line in (text or "").split("\n"):
        mark = _MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if not level:
            own.append(line)
        elif level == level_before:
            quotes[-1] = (level, quotes[-1][1] + "\n" + line[mark.end() :])
        else:
            if own and not level_before and _INTRO.match(own[-1]):
                own.pop()
            quotes.append((level, line[mark.end() :]))
        level_before = level
    return "\n".join(own).strip(), quotes


def passages(text: str) -> list[int]:
    """Digests of the normalised sentences and of the whole of a passage."""
    normal = [" ".join(re.findall(r"\w+", s.lower())) for s in _SENTENCE.split(" ".join(text.split()))]
    normal = [s for s in [*normal, " ".join(normal)] if s.count(" ") + 1 >= MIN_WORDS]
    return [xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63) for s in dict.fromkeys(normal)]


def thread(
    frame: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each message: its text without quotes, the turn it replies to and its place in reply order.

    A passage quoted at level n stands one level lower in the message that is answered: at level 1
    in its own text, deeper as a quotation.  ``reply_to`` is the latest earlier turn that is the
    first to hold, a level lower, one of the passages of the shallowest level that any turn holds;
    without such a turn it is the turn before.  ``sources`` are the turns that first said a quoted passage of any
    level in their own words, ascending.  ``position`` is the message's place, from 0, when each
    message is followed by its replies, earlier ones first, each with its own replies.

    Passages meet by group-by on (conversation, digest, level), turns by ranks within ranges and reply
    order by doubling along the tour around the tree, so a conversation that holds a third of all
    rows is spread over many tasks; without quotations reply order is turn order and no tour is made.
    A null text is empty; rows without conversation or turn keep their text, reply to nothing and
    have no position; repeated rows share a position, and of several texts of one turn all lend
    passages.  An empty table gives no rows.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark)
    rows = frame.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def make_rows():
        def row(conv, turn, role, text):
            own, quotes = split_quotes(text)
            return conv, turn, role, own, len(quotes), max((level for level, _ in quotes), default=0)

        return row

    def make_passages():
        def row(conv, turn, text):
            if conv is None or turn is None:
                return []
            own, quotes = split_quotes(text)
            return list({(conv, turn, level, d) for level, q in [(0, own), *quotes] for d in passages(q)})

        return row

    plain = map_rows(
        rows, ["conv_id", "turn", "role", "text"],
        f"conv_id {kind}, turn long, role string, text string, n_quotes int, depth int", make_rows,
    )
    messages = scratch.write(plain, "messages")
    found = scratch.write(
        flat_map_rows(rows, ["conv_id", "turn", "text"], f"conv_id {kind}, turn long, level int, digest long", make_passages), "passages"
    )
    # The first to say a passage, or to quote it at a level, is its origin there.
    holders = found.groupBy("conv_id", "digest", "level").agg(F.min("turn").alias("turn"))
    quoted = found.filter("level > 0").select("conv_id", F.col("turn").alias("by"), "level", "digest")
    answered = quoted.join(holders.withColumn("level", F.col("level") + 1), ["conv_id", "digest", "level"])
    said = quoted.filter("level > 1").join(holders.filter("level = 0").drop("level"), ["conv_id", "digest"])
    links = (
        answered.select("conv_id", "by", "turn", F.struct(-F.col("level"), "turn").alias("reply"), (F.col("level") == 1).alias("source"))
        .unionByName(said.select("conv_id", "by", "turn", F.lit(True).alias("source")), allowMissingColumns=True)
        .filter("turn < by")
        .groupBy("conv_id", "by")
        .agg(F.max("reply").getField("turn").alias("quotes_turn"), F.sort_array(F.collect_set(F.when(F.col("source"), F.col("turn")))).alias("sources"))
    )
    turns = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    known = _numbered(scratch, turns, ["conv_id"], "turns").join(links.withColumnRenamed("by", "turn"), ["conv_id", "turn"], "left")
    known = known.withColumns({"reply_to": F.coalesce("quotes_turn", "before"), "by_quote": F.col("quotes_turn").isNotNull()})
    known = scratch.write(known.drop("quotes_turn"), "known")
    order = _reply_order(scratch, known)
    if order is not None:
        known = known.join(order, ["conv_id", "turn"], "left").withColumn("position", F.coalesce("tour", "position"))
    known = known.select(
        F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), "position", "reply_to", "by_quote", F.col("sources").alias("found"),
    )
    return messages.join(
        known, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left"
    ).select(
        "conv_id", "turn", "position", "role", "text", "reply_to", F.coalesce("by_quote", F.lit(False)).alias("by_quote"),
        F.coalesce("found", F.array().cast("array<long>")).alias("sources"), "n_quotes", "depth",
    )


def _numbered(scratch: Scratch, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys``, turn, position and the turn before within the keys, without gathering a key in one task.

    Rows are dealt into ranges of (keys, turn); a range's share of a key is counted, and the counts
    and last turns of the ranges before are added (a row for each range and key).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = scratch.write(rows.repartitionByRange(parts, *keys, "turn").withColumn("part", F.spark_partition_id()), name)
    here = Window.partitionBy(*keys, "part").orderBy("turn")
    shares = spread.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        *keys, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"), F.max("last").over(earlier).alias("last")
    )
    ranked = spread.select(*keys, "turn", "part", F.row_number().over(here).alias("at"), F.lag("turn").over(here).alias("own_before"))
    return ranked.join(shares, [*keys, "part"]).select(
        *keys, "turn", (F.col("shift") + F.col("at") - 1).alias("position"), F.coalesce("own_before", "last").alias("before")
    )


def _reply_order(scratch: Scratch, known: DataFrame) -> DataFrame | None:
    """(conv_id, turn, tour) of conversations in which a quotation links further back than the turn before; None if none does.

    The tour goes down to each message and up again; how many messages lie ahead of a step comes from
    doubling: each round adds what the step pointed to knows and takes over its pointer.
    """
    branched = known.filter("by_quote AND reply_to <> before").select("conv_id").distinct()
    tree = scratch.write(known.join(branched, "conv_id", "left_semi").select("conv_id", "turn", "reply_to"), "tree")
    if tree.isEmpty():
        return None
    replies = tree.filter("reply_to IS NOT NULL").withColumnRenamed("reply_to", "parent")
    replies = scratch.write(_numbered(scratch, replies, ["conv_id", "parent"], "siblings"), "replies")
    first = replies.filter("before IS NULL").select("conv_id", F.col("parent").alias("turn"), F.col("turn").alias("first"))
    then = replies.filter("before IS NOT NULL").select("conv_id", F.col("before").alias("turn"), F.col("turn").alias("then"))
    joined = tree.join(first, ["conv_id", "turn"], "left").join(then, ["conv_id", "turn"], "left")
    down = joined.select(
        "conv_id", "turn", F.lit(True).alias("down"), F.coalesce("first", "turn").alias("to"), F.col("first").isNotNull().alias("to_down"), F.lit(1).cast("long").alias("ahead")
    )
    up = joined.select(
        "conv_id", "turn", F.lit(False).alias("down"), F.coalesce("then", "reply_to").alias("to"), F.col("then").isNotNull().alias("to_down"), F.lit(0).cast("long").alias("ahead")
    )
    steps, turn = scratch.write(down.union(up), "tour-0"), 0
    while not steps.filter("to IS NOT NULL").isEmpty():
        over = steps.select(
            "conv_id", F.col("turn").alias("to"), F.col("down").alias("to_down"), F.col("to").alias("next"), F.col("to_down").alias("next_down"), F.col("ahead").alias("more")
        )
        going = steps.filter("to IS NOT NULL").join(over, ["conv_id", "to", "to_down"])
        going = going.select("conv_id", "turn", "down", F.col("next").alias("to"), F.col("next_down").alias("to_down"), (F.col("ahead") + F.col("more")).alias("ahead"))
        turn += 1
        steps = scratch.write(going.unionByName(steps.filter("to IS NULL")), f"tour-{turn}")
        scratch.drop(f"tour-{turn - 1}")
    ahead = steps.filter("down").select("conv_id", "turn", "ahead")
    whole = ahead.groupBy("conv_id").agg(F.max("ahead").alias("n"))
    return ahead.join(whole, "conv_id").select("conv_id", "turn", (F.col("n") - F.col("ahead")).alias("tour"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread(read(spark, sf_dir, "conversations"))
