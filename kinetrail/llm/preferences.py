"""Preference formatting: one prompt, two completions, and what of them bears loss.

``format_preferences`` takes a chosen and a rejected conversation per row,
finds the longest prefix of equal turns, renders it once as the prompt, and
renders what follows on either side as completions.  A completion's mask lists
the character spans that bear loss: the text and end mark of assistant turns,
without their headers.  Everything is DataFrame expressions.

``self_pairs`` makes pairs from plain conversations: the chosen side ends with
the last assistant turn; the rejected side puts the previous assistant turn's
text (nothing, if there is none) in its place.

Defined cases: a null role counts as user, a null text or turn list as empty;
equal conversations give empty completions; a conversation without an
assistant turn has a prompt only and null completions; repeated turn numbers
are ordered by role and text; other columns are ignored.  A conversation is
rendered as one string and so has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = "struct<role:string,text:string>"
END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_header(turn["role"]), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def loss_spans(turns: Column) -> Column:
    """``start-end`` of each assistant turn's text and end mark within the rendered turns, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        text = acc["at"] + F.length(_header(turn["role"]))
        end = acc["at"] + F.length(_rendered(turn))
        span = F.concat_ws("-", text.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two lists share at their front."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.coalesce(F.array_min(unlike) - 1, n)


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """id, prompt_turns, prompt, chosen, rejected and their masks. A null rejected list means that there is no pair."""
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{_TURN}>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.select(F.col(id_col).alias("id"), clean(chosen).alias("a"), clean(rejected).alias("b"), F.col(rejected).isNotNull().alias("paired"))
    rows = rows.withColumn("p", F.when(F.col("paired"), common_prefix(F.col("a"), F.col("b"))).otherwise(F.size("a")))
    tail = lambda c: F.slice(F.col(c), F.col("p") + 1, F.greatest(F.size(c) - F.col("p"), F.lit(0)))
    rows = rows.select("id", "p", "paired", F.slice("a", F.lit(1), F.col("p")).alias("head"), tail("a").alias("a"), tail("b").alias("b"))
    if_pair = lambda c: F.when(F.col("paired"), c)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("p").cast("long").alias("prompt_turns"),
        render(F.col("head")).alias("prompt"),
        if_pair(render(F.col("a"))).alias("chosen"),
        if_pair(render(F.col("b"))).alias("rejected"),
        if_pair(loss_spans(F.col("a"))).alias("chosen_mask"),
        if_pair(loss_spans(F.col("b"))).alias("rejected_mask"),
    )


def self_pairs(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, chosen, rejected) of each conversation in a table of turns."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # 1-based places of assistant turns
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at(F.col("turns"), i)["role"] == "assistant")
    rows = grouped.withColumn("places", places).withColumn("last", F.array_max("places"))
    bare = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    earlier = F.when(F.size("places") > 1, F.element_at(F.col("turns"), F.element_at(F.col("places"), -2))["text"]).otherwise(F.lit(""))
    reply = F.array(F.struct(F.lit("assistant").alias("role"), earlier.alias("text")))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("last").isNull(), bare(F.col("turns"))).otherwise(bare(F.slice("turns", F.lit(1), F.col("last")))).alias("chosen"),
        F.when(F.col("last").isNotNull(), F.concat(bare(F.slice("turns", F.lit(1), F.col("last") - 1)), reply)).alias("rejected"),
    )
