"""Preference formatting: a shared prompt, rendered once, and two masked completions.

DataFrame functions only. The prompt of a pair is the longest run of first turns that the
chosen and the rejected conversation have in common, role and text alike. The rest of each
is its completion, with the character spans of the assistant's words, on which alone a
model is to be trained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, key: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    """One row a conversation: its turns in order. A conversation is one output row, so its turns meet."""
    clean = lambda c, other: F.replace(F.coalesce(F.col(c), F.lit(other)), F.lit(OPEN), F.lit("< |"))
    one = F.struct(F.col(turn).isNull().alias("no_turn"), F.col(turn).alias("turn"), clean(role, "user").alias("role"), clean(text, "").alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(listed.alias(name))


def _rendered(turns):
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END)))
    return F.array_join(parts, "")


def _spans(turns):
    """Character spans (from, to) of the assistant's texts with their end marks in the rendered turns."""
    head, end = len(OPEN) + len(CLOSE), len(END)
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def step(state, t):
        start = state["at"] + head + F.length(t["role"])
        stop = start + F.length(t["text"]) + end
        span = F.array(F.struct(start.alias("a"), stop.alias("b")))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans, usable).

    Turns are ordered by number, null numbers last, then role and text. A null role is a
    user's, a null text is empty, turns without a key take no part, repeated turns count as
    often as they come; other columns are ignored. Marks inside a text are broken up, so
    that no text can forge a turn. A pair of which one side is missing or empty after the
    prompt, or both are equal, is returned with ``usable`` false.
    """
    both = _turns(chosen, key, turn, role, text, "c").join(_turns(rejected, key, turn, role, text, "r"), "pair_id", "full_outer")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = both.select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    # the count grows only while every turn so far was the same on both sides
    zipped = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(zipped, False).cast("int")
    both = both.withColumn("n", F.when(first == 0, F.size("c")).otherwise(first - 1))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.withColumn("prompt_turns", F.slice("c", F.lit(1), F.col("n"))).withColumn("c", rest("c")).withColumn("r", rest("r"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered("prompt_turns").alias("prompt"),
        _rendered("c").alias("chosen"), _spans("c").alias("chosen_spans"), _rendered("r").alias("rejected"), _spans("r").alias("rejected_spans"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("usable"),
    )
