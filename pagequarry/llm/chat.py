"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are
context, and only the text of that reply is trainable. Turns that follow the
last reply, or a conversation without any, give one example without a target,
so that no turn is lost. A turn is written as

    <|turn|>ROLE\\nTEXT<|end|>\\n

Control strings inside roles and texts are escaped by a backslash after their
first character, after backslashes are doubled, and so come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that a text must not be able to write as they are.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a single backslash before n is written by escape_role alone: others come in pairs
    pairs = F.split(role, r"\\\\", -1)
    return unescape(F.array_join(F.transform(pairs, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\\\"))


def examples(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_length, last.

    ``text`` is the whole example, ``loss_start`` counts its characters before
    the trainable ones (an example without a target has length null).
    ``turns`` needs conv_id, turn, role and text; other columns are ignored.
    Turns go by turn, then role and text, so repeated rows and ties have one
    order; null turns come first. Null roles and texts are empty. Rows with a
    null conv_id form one conversation. An empty table gives no example.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    body = escape(text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("raw"), F.char_length(head).alias("head"), F.char_length(body).alias("length"), F.concat(head, body, F.lit(CLOSE)).alias("text"))
    # where each turn starts, by a running sum over the order that the turns are joined in
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    stop = F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.char_length("text") + F.col("head"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stop", "role", "start", "length", "text"))).alias("t"))
    spans = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["start"].alias("start"), x["length"].alias("length"), x["stop"].alias("stop")))
    whole = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("all"), spans.alias("spans"))
    last = F.element_at("spans", -1)
    goals = F.filter("spans", lambda s: s["role"] == trained)
    rest = F.array(F.struct(last["role"].alias("role"), last["stop"].alias("start"), F.lit(None).cast("int").alias("length"), last["stop"].alias("stop")))
    goals = F.when(last["role"] == trained, goals).otherwise(F.concat(goals, rest))
    out = whole.select("conv_id", "all", F.size(goals).alias("n"), F.posexplode(goals).alias("example", "g"))
    # an example's text ends with its reply, so contexts are made a row at a time
    return out.select("conv_id", "example", F.substring("all", F.lit(1), F.col("g.stop")).alias("text"), F.col("g.start").alias("loss_start"), F.col("g.length").alias("loss_length"), (F.col("example") == F.col("n") - 1).alias("last"))


def read_back(made: DataFrame) -> DataFrame:
    """Turns and trainable texts of each conversation, from the examples' texts alone."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    turns = F.slice(F.split("text", r"<\|turn\|>", -1), 2, 1 << 30)
    part = lambda x: F.concat(unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substr(x, F.instr(x, "\n") + 1, F.char_length(x) - F.instr(x, "\n") - len(CLOSE))), F.lit("\n"))
    rows = made.select("conv_id", "example", loss.alias("loss"), F.char_length("text").alias("chars"), F.when(F.col("last"), F.size(turns)).alias("n"), F.when(F.col("last"), F.sha2(F.array_join(F.transform(turns, part), ""), 256)).alias("sha"))
    kept = F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))))
    out = rows.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.array_join(F.transform(kept, lambda x: x["loss"]), "").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(examples(turns.unionByName(probe)))
