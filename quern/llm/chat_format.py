"""Chat formatting from event logs: fold each message's events, render, mask; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256_hex, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings with a meaning to some chat template: they get a backslash inside, and those with backslashes one more.
_PLAIN = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
#: Events that begin the text of a message anew.
_RESETS = ("start", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _fold(events: Column) -> Column:
    """One message's events, sorted, from its start on: its role, and its text after edits, regenerations and deltas; null if it ends deleted."""
    last = F.array_max(F.transform(events, lambda e, i: F.when(e["op"].isin(*_RESETS), i + 1).otherwise(F.lit(1))))
    text = F.array_join(F.transform(F.slice(events, last, F.size(events)), lambda e: F.when(e["op"] == "delete", F.lit("")).otherwise(e["text"])), "")
    return F.when(F.element_at(events, -1)["op"] != "delete", F.struct(F.element_at(events, 1)["seq"].alias("seq"), F.element_at(events, 1)["role"].alias("role"), text.alias("text")))


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of final messages from events (conv_id, seq, op, msg, role, text).

    Events of a message (conv_id, msg) go by seq, ties by op, role and text. ``start`` opens a message (a second
    ``start`` of the same msg opens another one), ``delta`` appends, ``edit`` replaces the text, ``regenerate``
    empties it, ``delete`` drops the message unless later events follow. Events before the first start are dropped.
    """
    rank = F.when(F.col("op") == "start", 0).otherwise(1)
    item = F.struct("seq", rank.alias("rank"), "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(item)).alias("log"))
    begun = logs.withColumn("at", F.filter(F.transform("log", lambda e, i: F.when(e["op"] == "start", i + 1)), lambda i: i.isNotNull())).where(F.size("at") > 0)
    cut = F.transform("at", lambda s, k: F.slice("log", s, F.coalesce(F.get("at", k + 1), F.size("log") + 1) - s))
    return begun.select("conv_id", "msg", F.posexplode(F.transform(cut, _fold)).alias("nth", "m")).where("m is not null").select("conv_id", "msg", "nth", "m.seq", "m.role", "m.text")


def format_chats(events: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, mask (for each turn: characters before, under and after the loss), n_turns.

    Messages are folded from the events, ordered by the seq they start at (null first; ties by role and text), and
    rendered; only assistant texts are under the loss. Texts and roles are escaped reversibly, so that no control
    string in them is one in the output. Null texts and roles are empty; a null conv_id is a conversation of its own;
    repeated starts are repeated turns; further columns are ignored; no events give no rows. All events of a message,
    then all rendered turns of a conversation, meet in one aggregate that makes one value of them; partial lists are
    built map-side, and no step is more than linear in their length.
    """
    turns = fold_messages(events).select(
        "conv_id",
        F.struct("seq", "msg", "role", "text", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    loss = lambda t: t["role"] == "assistant"
    mask = F.transform("turns", lambda t: F.struct((F.length(t["head"]) + F.when(loss(t), 0).otherwise(F.length(t["body"]))).alias("before"), F.when(loss(t), F.length(t["body"])).otherwise(0).alias("under"), F.lit(len(END)).alias("after")))
    return chats.select("conv_id", formatted.alias("formatted"), mask.alias("mask"), F.size("turns").cast("long").alias("n_turns"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (text under the mask of each turn, unescaped), from the formatted text and the mask alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    rows = chats.withColumn("piece", F.slice(pieces, 1, F.size(pieces) - 1))
    head = lambda p: F.substring(p, F.lit(len(START) + 1), F.instr(p, F.lit("\n")) - len(START) - 1)
    body = lambda p: F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))
    turns = F.transform("piece", lambda p: F.struct(_unescape_role(head(p)).alias("role"), unescape(body(p)).alias("text")))
    loss = F.transform("piece", lambda p, i: unescape(F.substring(p, F.get("mask", i)["before"] + 1, F.get("mask", i)["under"])))
    return rows.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.lit("start").alias("op"), F.col("turn").alias("msg"), "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "start", 0, "user", both), (-1, 1, "start", 1, "assistant", both)], "conv_id long, seq long, op string, msg long, role string, text string")
    read = read_back(format_chats(logs.unionByName(extra)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(spoken).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        sha256_hex(lost).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The formatted length, in SQL: each turn's frame, and a backslash for each control string in a text.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\])')) + 11)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
