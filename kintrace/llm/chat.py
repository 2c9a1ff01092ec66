"""2. Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose where a window ends, always between turns.
Each further window repeats the system turn and a limited stretch of history,
outside the loss mask, so every assistant text is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template. ``<`` and ``[`` never stand unescaped in a role or text.
TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens of a window, and of repeated history in it; a turn counts its words and a few for its marks.
BUDGET, HISTORY, OVERHEAD = 512, 96, 4


def escape(c: Column) -> Column:
    """Backslash, ``<`` and ``[`` become a backslash and a letter; so does a line end in a role."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\s"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window, context_turns, formatted, loss_spans.

    ``context_turns`` leading turns of a window are repeats (system turn and
    history). ``loss_spans`` are the (first, length) code points of the window's
    own assistant texts in ``formatted``, first counted from 1. Turns are ordered
    by number, ties by role and text; repeated rows count each. Null roles and
    texts are empty; rows without a conversation id form one conversation; a turn
    above the budget has a window of its own and is never cut. A conversation is
    one row while it is formatted, so its length is bounded by a task's memory.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(r"\S+")) + OVERHEAD).cast("long"))
    up_to = F.sum(F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", up_to)
    part = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    rows = rows.withColumn("part", part).withColumn("body", F.length(escape(F.col("text"))))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "system", "role", "tokens", "upto", "part", "body"))).alias("t"))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("t")[0]["system"], F.col("t")[0]["tokens"]).otherwise(F.lit(0)))
    # windows as (first turn, last turn): a new one where the prefix sum leaves the room
    start = F.struct(F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prev"), F.array().cast("array<int>").alias("firsts"))

    def step(acc: Column, t: Column) -> Column:
        fresh = (F.size(acc["firsts"]) == 0) | ((t["upto"] - acc["base"] > F.col("room")) & (t["upto"] > acc["prev"]) & (acc["prev"] > acc["base"]))
        return F.struct(F.when(fresh, acc["prev"]).otherwise(acc["base"]).alias("base"), t["upto"].alias("prev"), F.when(fresh, F.array_append(acc["firsts"], t["at"])).otherwise(acc["firsts"]).alias("firsts"))

    turns = turns.withColumn("room", room.cast("long")).withColumn("firsts", F.aggregate("t", start, step)["firsts"])
    each = turns.select("conv_id", "t", "firsts", F.posexplode("firsts").alias("window", "first"))
    last = F.coalesce(F.get("firsts", F.col("window") + 1) - 1, F.size("t"))
    base = F.when(F.col("first") > 1, F.get("t", F.col("first") - 2)["upto"]).otherwise(F.lit(0))
    each = each.withColumn("last", last).withColumn("base", base)
    old = F.filter("t", lambda t: (t["at"] < F.col("first")) & (t["system"] | (F.col("base") - t["upto"] + t["tokens"] <= history)))
    each = each.withColumn("old", old).withColumn("own", F.filter("t", lambda t: (t["at"] >= F.col("first")) & (t["at"] <= F.col("last"))))
    shown = F.concat("old", "own")
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<first:int,length:int>>").alias("spans"))

    def mark(acc: Column, t: Column) -> Column:
        end = acc["pos"] + F.length(t["part"])
        span = F.struct((end - len(END) - t["body"] + 1).cast("int").alias("first"), t["body"].cast("int").alias("length"))
        mine = (t["at"] >= F.col("first")) & (t["role"] == "assistant")
        return F.struct(end.alias("pos"), F.when(mine, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return each.select(
        "conv_id", "window", F.size("old").alias("context_turns"),
        F.array_join(F.transform(shown, lambda t: t["part"]), "").alias("formatted"),
        F.aggregate(shown, zero, mark)["spans"].alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read formatted windows back: conv_id, n_turns, turns_text, loss_text, formatted_chars per conversation."""
    parts = F.split("formatted", r"<\|turn\|>")
    own = F.slice(parts, F.col("context_turns") + 2, F.size(parts))

    def turn(p: Column) -> Column:
        line = F.locate("\n", p)
        role, text = F.substring(p, F.lit(1), line - 1), F.substring(p, line + 1, F.length(p) - line - len(END))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    read = windows.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.size(own).alias("n"),
        F.array_join(F.transform(own, turn), "").alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["first"], s["length"]))), "").alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("w", lambda w: w["turns"]), "").alias("turns_text"), F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"), "formatted_chars")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    read = read_windows(format_windows(rows.unionByName(more)))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", digest("turns_text").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest("loss_text").alias("loss_sha256"), "formatted_chars")
