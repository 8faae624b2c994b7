"""Chat formatting by rotating the perspective over all participants.

For each participant a dialogue is rendered whole, with that speaker as the assistant and
everyone else as named users; masks mark what the assistant says. Only DataFrame functions are used.

The work goes by pieces: a stretch of turns is gathered, sorted and rendered, and only the
finished pieces of a dialogue meet, whose masks are then shifted by the lengths before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of turns of a piece.
PIECE_TURNS = 256
#: Rows beyond which a piece (of many rows with one turn, or with none) is cut by turn and by the start of the hash that orders equal turns.
PIECE_ROWS = 1024
SYSTEM = "system"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def _safe(text: Column) -> Column:
    """Text in which no marker of the format can occur."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def _running(lengths: Column) -> Column:
    """What stands before each entry, summed."""
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("before"))
    return F.aggregate(lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")), lambda acc: acc["before"])


def rotated(conversations: DataFrame, piece_turns: int = PIECE_TURNS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, speaker, n_turns, n_spoken, messages, text, masks: one row for each speaker of each dialogue.

    messages: structs of role, name, content, learn. text: the messages as `<|assistant|>`,
    `<|user:NAME|>` or `<|system|>`, a line feed, the content, `<|end|>` and a line feed. masks: [start, end)
    in characters of text, for each message of the assistant from its content to its `<|end|>`.

    Turns are in the order of turn (null first); equal turns in that of md5(role|text). Rows that repeat wholly count
    once. A null role is the user `unknown`, a null text empty; rows without conv_id are left out. System turns
    are nobody's perspective: a dialogue of them alone gives no row. Other columns are ignored. Results don't depend on
    ``piece_turns`` and ``piece_rows``.
    """
    said = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), _safe(F.col("text")).alias("text")).distinct()
    speakers = said.select("conv_id", F.col("role").alias("speaker")).filter(F.col("speaker") != SYSTEM).distinct()
    piece = F.coalesce(F.floor(F.col("turn") / piece_turns).cast("long"), F.lit(-(1 << 63)))  # null turns stand first
    placed = said.withColumn("piece", piece).withColumn("tie", F.md5(F.concat_ws("|", "role", "text").cast("binary")))
    crowded = said.groupBy("conv_id", piece.alias("piece")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > piece_rows).select("conv_id", "piece", F.lit(True).alias("crowded"))
    placed = placed.join(crowded, ["conv_id", "piece"], "left")
    keys = ["conv_id", "piece", F.when(F.col("crowded"), F.col("turn")).alias("own_turn"), F.when(F.col("crowded"), F.substring("tie", 1, 2)).alias("own_tie")]
    pieces = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("turns"))

    def message(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        kind = F.when(own, F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
        return F.struct(kind.alias("role"), F.when(kind == "user", _safe(t["role"])).alias("name"), t["text"].alias("content"), own.alias("learn"))

    head = lambda m: F.concat(F.lit(OPEN), m["role"], F.when(m["name"].isNotNull(), F.concat(F.lit(":"), m["name"])).otherwise(F.lit("")), F.lit(CLOSE + "\n"))
    body = lambda m: F.concat(m["content"], F.lit(END))
    rows = pieces.join(speakers, "conv_id").select("conv_id", "speaker", "piece", "own_turn", "own_tie", F.transform("turns", message).alias("messages"))
    rows = rows.withColumn("before", _running(F.transform("messages", lambda m: F.length(head(m)) + F.length(body(m)) + 1)))
    spans = F.transform("messages", lambda m, i: F.struct(m["learn"].alias("learn"), (F.get("before", i) + F.length(head(m))).alias("start"), (F.get("before", i) + F.length(head(m)) + F.length(body(m))).alias("end")))
    rows = rows.select(
        "conv_id", "speaker",
        F.struct("piece", "own_turn", "own_tie", F.array_join(F.transform("messages", lambda m: F.concat(head(m), body(m), F.lit("\n"))), "").alias("text"), "messages",
                 F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"])).alias("masks")).alias("rendered"),
    )
    whole = rows.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list("rendered")).alias("pieces"))
    whole = whole.withColumn("before", _running(F.transform("pieces", lambda p: F.length(p["text"]))))
    shifted = F.transform("pieces", lambda p, i: F.transform(p["masks"], lambda m: F.struct((m["start"] + F.get("before", i)).alias("start"), (m["end"] + F.get("before", i)).alias("end"))))
    whole = whole.select("conv_id", "speaker", F.flatten(F.transform("pieces", lambda p: p["messages"])).alias("messages"), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), F.flatten(shifted).alias("masks"))
    return whole.select("conv_id", "speaker", F.size("messages").cast("long").alias("n_turns"), F.size(F.filter("messages", lambda m: m["learn"])).cast("long").alias("n_spoken"), "messages", "text", "masks")
