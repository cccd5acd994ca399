"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<|im_start|>", "<|im_end|>", "\n"
TRAINED_ROLE = "assistant"


def plain(text: Column) -> Column:
    """A text that can't be taken for template marks: "<|" gets a space inside. Null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def turn(role: Column, text: Column) -> Column:
    """A turn as the struct (role, text) with its marks made plain; a null role is "unknown"."""
    return F.struct(plain(F.coalesce(role, F.lit("unknown"))).alias("role"), plain(text).alias("text"))


def head(t: Column) -> Column:
    """What stands before a turn's text."""
    return F.concat(F.lit(OPEN), t["role"], F.lit(NEXT))


def render(turns: Column) -> Column:
    """The turns in the template, one after the other; no turns: empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE + NEXT))), "")


def mask(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """Spans "start-end" (code points of the rendered turns, end exclusive, comma-joined) that are trained on: texts of `role` with their end mark."""
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t))
        end = start + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(t["role"] == role, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + F.lit(len(NEXT))).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, at, add, lambda acc: F.array_join(acc["spans"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that both conversations start with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def conversations(turns: DataFrame, id_column: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns by number, then role and text; one row per conversation, as it is rendered whole.

    Turns without a number come last; rows with a null id are one conversation;
    repeated rows are turns of their own.
    """
    key = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("n"), turn(F.col(role), F.col(text)).alias("turn"))
    listed = turns.groupBy(F.col(id_column).alias("id")).agg(F.array_sort(F.collect_list(key)).alias("t"))
    return listed.select("id", F.transform("t", lambda k: k["turn"]).alias("turns"))


def worse_replies(convs: DataFrame) -> DataFrame:
    """(id, chosen, rejected): beside each conversation one that ends in a worse last reply.

    The rejected reply repeats the assistant's reply before the last, or, where
    the last is the only one, parrots the turn before it. A conversation without
    a reply is rejected unchanged.
    """
    replies = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"]["role"] == TRAINED_ROLE)
    found = convs.withColumn("replies", replies)
    last = F.try_element_at("replies", F.lit(-1))
    before = F.try_element_at("replies", F.lit(-2))["t"]["text"]
    echo = F.when(last["i"] > 0, F.get("turns", last["i"] - 1)["text"]).otherwise(F.lit(""))
    worse = F.struct(F.lit(TRAINED_ROLE).alias("role"), F.coalesce(before, echo).alias("text"))
    rejected = F.when(last.isNull(), F.col("turns")).otherwise(F.concat(F.slice("turns", F.lit(1), F.coalesce(last["i"], F.lit(0))), F.array(worse)))
    return found.select("id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`pairs` (conversations as arrays of (role, text)) as prompt and completions.

    Adds n_prompt_turns (the longest common prefix), prompt (rendered once),
    chosen_text and rejected_text (what follows it), their masks, and identical.
    A conversation that is the other's prefix has an empty completion, as both
    have if they are identical; null conversations have no turns. Rows are
    independent: repeated rows are formatted alike, other columns stay.
    """
    a, b = (F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)) for c in (chosen, rejected))
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    counted = pairs.withColumn("n_prompt_turns", common_turns(a, b))
    return counted.withColumns(
        {
            "prompt": render(F.slice(a, F.lit(1), n)),
            "chosen_text": render(rest(a)),
            "rejected_text": render(rest(b)),
            "chosen_mask": mask(rest(a)),
            "rejected_mask": mask(rest(b)),
            "identical": (n == F.size(a)) & (n == F.size(b)),
        }
    )
