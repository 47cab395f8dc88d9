"""Multi-party perspective rotation of dialogues.

For each participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant; the others are users who carry their names. The loss mask covers what the assistant
says, with its end mark, and nothing else. Turns of the narrator role ``system`` belong to nobody:
they are rendered as system turns and nobody takes their perspective.

A conversation is rendered in one piece up to PIECE_TURNS turns and PIECE_CHARS characters. A larger
one is put in order by a range sort over all its turns and rendered in pieces of neighbouring turns, so
that no task holds it whole; pieces carry their place, and in order they make up the dialogue.

Defined cases: a null text is an empty turn; a null role speaks as ``unknown``; a null conv_id is a
conversation of its own; turns are in order of (turn, role, text), null turns first; repeated rows
are separate turns; control marks inside a text are broken up; names keep letters, digits, _ and -,
and names that would then be the same get # and a number, which no name has of itself; a conversation of system turns alone gives no
rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side
from .mixing import prefix

PIECE_TURNS, PIECE_CHARS = 1024, 1 << 20
#: Neighbouring turns of a large conversation in a piece, at most.
SHIFT = 6
NARRATOR = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(?=im_(?:start|end)\|>)", "< |")


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls and control marks replaced."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), _clean(F.coalesce("text", F.lit(""))).alias("text"))


def participants(turns: DataFrame) -> DataFrame:
    """conv_id, role, name, n (turns) and chars of every speaker."""
    by_role = turns.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    name = F.regexp_replace("role", r"[^\p{L}\p{N}_-]", "_")
    same = Window.partitionBy("conv_id", "name").orderBy("role")
    named = by_role.withColumn("name", name).withColumn("k", F.row_number().over(same))
    return named.withColumn("name", F.when(F.col("k") > 1, F.concat("name", F.lit("#"), F.col("k"))).otherwise(F.col("name"))).drop("k")


def conversations_of(people: DataFrame) -> DataFrame:
    """conv_id, n, chars, speakers: array<struct<role, name>> in order of role."""
    return people.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("role", "name"))).alias("speakers"))


def _heads(turns: Column, me: Column) -> Column:
    """Of every turn its head line and body, and whether the assistant says it."""

    def one(t: Column) -> Column:
        said = t["role"] == me["role"]
        head = F.when(said, F.lit("assistant")).when(t["role"] == NARRATOR, F.lit(NARRATOR)).otherwise(F.concat(F.lit("user name="), t["name"]))
        return F.struct(F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(CLOSE + "\n")).alias("body"), said.alias("said"))

    return F.transform(turns, one)


def _spans(parts: Column, start: Column) -> Column:
    """Character spans [start, end) of what the assistant says; the last line feed is outside."""
    state = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["head"])
        end = body + F.length(p["body"])
        span = F.array(F.struct(body.cast("long").alias("start"), (end - 1).cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(p["said"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, state, step, lambda acc: acc["spans"])


def _rendered(pieces: DataFrame) -> DataFrame:
    """pieces (conv_id, piece, start, turns, me) to rows of the result."""
    rows = pieces.withColumn("parts", _heads(F.col("turns"), F.col("me")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "")
    rows = rows.select("conv_id", F.col("me.role").alias("participant"), "piece", "start", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), _spans(F.col("parts"), F.col("start")).alias("spans"))
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.withColumn("masked_chars", masked)


def _speakers(column: str = "speakers") -> Column:
    return F.explode(F.filter(column, lambda s: s["role"] != NARRATOR)).alias("me")


def rotate(conversations: DataFrame, piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS, shift: int = SHIFT) -> DataFrame:
    """conv_id, participant, piece (from 0), start (place of the piece in the whole rendering, in
    characters), n_turns, text, spans (in the whole rendering), masked_chars."""
    turns = turns_of(conversations)
    named = cut(participants(turns), "participants")
    people = cut(conversations_of(named), "conversations")
    large = cut(people.where((F.col("n") > piece_turns) | (F.col("chars") > piece_chars)), "large-conversations")
    big = small_side(large.select(F.col("conv_id").alias("__big")), 24)
    same = F.col("conv_id").eqNullSafe(F.col("__big"))
    one = F.struct("turn", "role", "text")
    whole = turns.join(big, same, "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    # the speakers of a whole conversation are in its turns; names are looked up in the table
    small = people.join(big, same, "left_anti").select(F.col("conv_id").alias("__c"), "speakers")
    whole = whole.join(small, F.col("conv_id").eqNullSafe(F.col("__c")))
    lookup = F.map_from_entries(F.transform("speakers", lambda s: F.struct(s["role"], s["name"])))
    whole = whole.withColumn("names", lookup).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.col("names")[t["role"]].alias("name"))))
    out = _rendered(whole.select("conv_id", "turns", _speakers()).select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), "turns", "me"))
    if large.isEmpty():
        return out
    return out.unionByName(_pieces(turns.join(big, same, "left_semi"), large, named.join(big, same, "left_semi"), shift))


def _pieces(turns: DataFrame, people: DataFrame, named: DataFrame, shift: int) -> DataFrame:
    """Large conversations: neighbours in the sort order of all turns, which is that of whole
    conversations, share a piece."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartitionByRange(n, *keys, F.rand(1)).sortWithinPartitions(*keys)  # equal turns may part
    ordered = cut(ordered.withColumn("ord", F.monotonically_increasing_id()), "ordered-turns")
    names = named.select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), "name")
    ordered = ordered.join(names, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r"))).withColumn("seg", F.shiftright("ord", shift))
    one = F.struct("ord", "role", "text", "name")
    segs = ordered.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    all_ = people.select(F.col("conv_id").alias("__c"), "speakers")
    segs = segs.join(all_, F.col("conv_id").eqNullSafe(F.col("__c")))
    segs = cut(segs.select("conv_id", "seg", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["name"].alias("name"))).alias("turns"), _speakers()), "segments")
    chars = F.aggregate(_heads(F.col("turns"), F.col("me")), F.lit(0).cast("long"), lambda a, p: a + F.length(p["head"]) + F.length(p["body"]))
    own = F.sha2(F.to_json(F.struct("conv_id", F.col("me.role").alias("role"))), 256)
    lengths = cut(segs.select(own.alias("own"), "seg", chars.alias("chars"), F.shiftright("seg", 12).alias("chunk")), "segment-lengths")
    starts = prefix(lengths, "own", "chunk", F.col("chars"), ["seg"]).select("own", "seg", F.col("before").alias("start"))
    ranks = prefix(lengths, "own", "chunk", F.lit(1).cast("long"), ["seg"]).select("own", "seg", F.col("before").alias("piece"))
    places = cut(starts.join(ranks, ["own", "seg"]), "segment-places")
    placed = segs.withColumn("own", own).join(small_side(places, 120), ["own", "seg"])
    return _rendered(placed.select("conv_id", "piece", "start", "turns", "me"))
