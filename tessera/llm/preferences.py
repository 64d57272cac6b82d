"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

#: The chat template.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def shared_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays of (role, text) are equal."""

    def count(same):
        first = F.array_position(same, F.lit(False))
        return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")

    def equal(x, y):
        return x.isNotNull() & y.isNotNull() & (x["role"] == y["role"]) & (x["text"] == y["text"])

    return let(F.zip_with(a, b, lambda x, y: F.coalesce(equal(x, y), F.lit(False))), count)


def spans(turns: Column, trained: str = "assistant") -> Column:
    """(begin, end) of what is trained in the rendered turns, in characters: the text of a trained role's turn and its end mark."""

    def step(state, t):
        head = state["at"] + F.char_length(t["role"]) + len(OPEN) + len(MIDDLE)
        tail = head + F.char_length(t["text"]) + len(CLOSE) - 1
        own = F.array(F.struct(head.cast("long").alias("begin"), tail.cast("long").alias("end")))
        return F.struct((tail + 1).cast("long").alias("at"), F.when(t["role"] == trained, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preferences(turns: DataFrame, pair_col: str, side_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(pair_id, n_shared, prompt, chosen, rejected, chosen_spans, rejected_spans), one row per pair.

    turns: one row per turn, with its pair, its side (0 chosen, 1 rejected), its place, role and text. The longest common
    prefix of turns is rendered once as the prompt; the rest of each side is its completion, and spans say which characters
    of it are trained. A side without turns is an empty completion. Turns of equal place are ordered by role and text; a null
    place comes first, a null role or text counts as empty. A turn without a pair belongs to no other turn: each is a row of its own, as
    the only turn of its side. Rows whose side is neither 0 nor 1 don't count. One pair is one row, collected in one task.
    """
    own = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = turns.select(F.col(f"`{pair_col}`").alias("pair_id"), F.col(f"`{side_col}`").cast("int").alias("side"), own.alias("t")).filter("side in (0, 1)")
    both = rows.filter("pair_id is not null").groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(name) for k, name in ((0, "a"), (1, "b"))])
    alone = rows.filter("pair_id is null").select("pair_id", *[F.when(F.col("side") == k, F.array("t")).otherwise(F.slice(F.array("t"), 1, 0)).alias(name) for k, name in ((0, "a"), (1, "b"))])
    both = both.union(alone)
    both = both.withColumn("n_shared", shared_turns(F.col("a"), F.col("b")))
    n = F.col("n_shared")

    def rest(c: str) -> Column:
        return F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))

    def text(x: Column) -> Column:
        return F.array_join(F.transform(x, render), "")

    both = both.select("pair_id", "n_shared", F.slice("a", F.lit(1), n).alias("p"), rest("a").alias("c"), rest("b").alias("r"))
    return both.select("pair_id", "n_shared", text(F.col("p")).alias("prompt"), text(F.col("c")).alias("chosen"), text(F.col("r")).alias("rejected"), spans(F.col("c"), trained).alias("chosen_spans"), spans(F.col("r"), trained).alias("rejected_spans"))


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as pair k, the even one chosen; turns with null ids have no pair and are chosen."""
    return conversations.withColumns({"_pair": F.expr("floor(conv_id / 2)").cast("long"), "_side": F.coalesce(F.expr("pmod(conv_id, 2)"), F.lit(0)).cast("int")})
