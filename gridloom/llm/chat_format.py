"""Preference formatting of paired conversations.

A pair has a chosen and a rejected conversation. Their longest common run of first turns is rendered once, as the
prompt; what is left of either is rendered as its completion, with a mask of the parts that are learned from (the
assistant's words). Pairs are given, or mined from one table: two conversations that begin with the same turn are a
pair, and any other is paired with itself as it would be with another's last answer.

Everything is DataFrame operations; a conversation is one row, and pairs meet in equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import durable, fresh, global_rank

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order (turn, role, text).

    Null roles and texts count as empty. Repeated turns stay, in order of turn (null first), role and text.
    """
    clean = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(clean)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _answer_at(turns: Column) -> Column:
    """The place (from 1) of the last answer, 0 without one."""
    places = F.transform(turns, lambda t, i: F.when(t["role"] == LEARNED, i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0)).cast("int")


def mined_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: pair_id, chosen_id, rejected_id, kind, and the turns of both sides.

    Conversations are ordered by the md5 of their first turn (role, line feed, text) and their id; pair_id is the place
    in this order, from 0. Each is the chosen side, and the next one in order is its counterpart:

    * `sibling`: both begin with the same turn; the rejected side is the next conversation.
    * `swapped`: else, if both have an answer (a turn of the assistant); the rejected side is the conversation up to its
      last answer, with the next conversation's last answer in its place.
    * `alone`: else, and for the last in order; the rejected side has no turns and rejected_id is null.
    """
    first = F.col("turns")[0]
    made = conversations(turns).select("conv_id", "turns", F.md5(F.encode(F.concat(first["role"], F.lit("\n"), first["text"]), "UTF-8")).alias("first"))
    ranked = global_rank(durable(made), ["first", "conv_id"])
    # Each conversation goes to its own pair, and what the pair before may need of it to that one.
    own = ranked.select(F.col("rank").alias("pair_id"), "conv_id", "turns", "first")
    asked = ranked.where("rank > 0").select((F.col("rank") - 1).alias("pair_id"), F.col("conv_id").alias("next_id"), F.col("turns").alias("next"), F.col("first").alias("next_first"))
    both = own.join(asked, "pair_id", "left")
    at, other = _answer_at(F.col("turns")), _answer_at(F.col("next"))
    kind = F.when(F.col("first") == F.col("next_first"), "sibling").when((at > 0) & (other > 0), "swapped").otherwise("alone")
    none = F.array().cast("array<struct<role:string,text:string>>")
    swapped = F.concat(F.slice("turns", F.lit(1), at - 1), F.slice("next", other, F.lit(1)))
    both = both.withColumn("kind", kind)
    rejected = F.when(F.col("kind") == "sibling", F.col("next")).when(F.col("kind") == "swapped", swapped).otherwise(none)
    return both.select("pair_id", F.col("conv_id").alias("chosen_id"), F.when(F.col("kind") != "alone", F.col("next_id")).alias("rejected_id"), "kind", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def render(turns: Column) -> Column:
    """The turns' text: each as <|im_start|>role, line feed, text, <|im_end|>, line feed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """What is learned from a completion: begin and end, in characters of its text, of each assistant turn's words and
    closing mark."""
    head = lambda t: F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
    whole = lambda t: head(t) + F.length(t["text"]) + len(CLOSE)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + head(t)).alias("begin"), (state["at"] + whole(t) - 1).alias("end"))
        spans = F.when(t["role"] == LEARNED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + whole(t)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda state: state["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompts and masked completions of pairs with the turns of both sides (chosen, rejected).

    All other columns stay; prompt_turns (how many), prompt, chosen, rejected, chosen_mask and rejected_mask follow.
    The common prefix compares role and text of the turns. It may be all of one or both conversations: the completion
    is then empty, and so is its mask. A side that is null has no turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    names = ("chosen", "rejected", "prompt_turns", "prompt", "chosen_mask", "rejected_mask")
    rest = [F.col(f"`{c}`") for c in pairs.columns if c not in names]
    (given,) = fresh(pairs, "_pair")
    both = pairs.select(*rest, F.struct(F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r")).alias(given))
    c, r = F.col(given)["c"], F.col(given)["r"]
    differs = F.array_position(F.transform(F.arrays_zip(c.alias("c"), r.alias("r")), lambda z: ~z["c"].eqNullSafe(z["r"])), True)
    both = both.withColumn(given, F.struct(c.alias("c"), r.alias("r"), F.when(differs > 0, differs - 1).otherwise(F.size(c)).cast("int").alias("n")))
    n = F.col(given)["n"]
    left = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    return both.select(
        *rest, n.alias("prompt_turns"), render(F.slice(c, F.lit(1), n)).alias("prompt"), render(left(c)).alias("chosen"),
        render(left(r)).alias("rejected"), mask(left(c)).alias("chosen_mask"), mask(left(r)).alias("rejected_mask"),
    )


def preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Prompts and masked completions of paired conversations.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id; without them they are mined (see
    `mined_pairs`), which adds kind. Returns pair_id, chosen_id, rejected_id and the columns of `format_pairs`.

    All turns with a null conv_id are one conversation, which can be mined; as a given id, null or an unknown one means
    a side without turns. An empty table gives an empty result; other columns are ignored.
    """
    if pairs is None:
        return format_pairs(mined_pairs(turns))
    convs = durable(conversations(turns))
    side = lambda s: convs.select(F.col("conv_id").alias(f"{s}_id"), F.col("turns").alias(s))
    return format_pairs(pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left").select("pair_id", "chosen_id", "rejected_id", "chosen", "rejected"))
